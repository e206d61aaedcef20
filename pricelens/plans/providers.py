"""Estimates from single providers and how they are put together; listings matched to seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.robust import cents, counted, hinge_rows, middle, middle_at, narrowed
from ..registry import query
from ..sources.tables import LISTINGS_SQL, listings, sales, table, with_sales


def band(central: Column, low: Column, high: Column, width: float = 0.15) -> tuple[Column, Column]:
    """Given bounds, or a band around the centre."""
    return F.coalesce(low, central * (1 - width)), F.coalesce(high, central * (1 + width))


PROVIDED = """pr as (select listing_id, identity, case when listing_id % 4 = 0 then null else price end as market, price * 1.02::double as mid, case when listing_id % 3 = 0 then null else price * 0.9::double end as low,
  case when listing_id % 6 = 0 then null else price * 0.8::double end as trend, price * 0.95::double as avg7, price * 1.3::double as avg30, listing_id % 5 <> 0 as proven from listings)"""


def provided(spark, sf_dir):
    """Provider payloads of listings: market and middle prices, averages, and whether language and variant are proven."""
    i, p = F.col("listing_id"), F.col("price")
    return listings(spark, sf_dir).select(
        "listing_id", "identity", F.when(i % 4 != 0, p).alias("market"), (p * 1.02).alias("mid"), F.when(i % 3 != 0, p * 0.9).alias("low"),
        F.when(i % 6 != 0, p * 0.8).alias("trend"), (p * 0.95).alias("avg7"), (p * 1.3).alias("avg30"), (i % 5 != 0).alias("proven"),
    )


@query("AGG-29", "AGG-30", "AGG-31", sql=f"with {LISTINGS_SQL.strip()}, {PROVIDED}" + """
select listing_id, case when not proven then 'rejected' when market is null then 'middle' else 'market' end as basis, round(case when proven then coalesce(market, mid) end, 6) as central,
  round(case when proven then coalesce(low, coalesce(market, mid) * 0.85::double) end, 6) as low, round(case when proven then coalesce(market, mid) * 1.15::double end, 6) as high from pr""")
def tier_estimates(spark, sf_dir):
    c = F.when(F.col("proven"), F.coalesce("market", "mid"))
    low, high = c * F.lit(0.85), c * F.lit(1.15)
    basis = F.when(~F.col("proven"), "rejected").when(F.col("market").isNull(), "middle").otherwise("market")
    return provided(spark, sf_dir).select("listing_id", basis.alias("basis"), F.round(c, 6).alias("central"), F.round(F.when(F.col("proven"), F.coalesce("low", low)), 6).alias("low"), F.round(high, 6).alias("high"))


@query("AGG-28", "AGG-54", sql=f"with {LISTINGS_SQL.strip()}, {PROVIDED}" + """
select listing_id, round((x[(len(x) + 1) // 2] + x[len(x) // 2 + 1]) / 2, 6) as central, x[-1] / x[1] > 1.5 as anomalous, len(x)::int as known from (select listing_id, list_sort(list_filter([trend, avg7, avg30, low], lambda v: v is not null)) as x from pr)""")
def averages_estimate(spark, sf_dir):
    x = F.array_sort(F.array_compact(F.array("trend", "avg7", "avg30", "low")))
    return provided(spark, sf_dir).select("listing_id", F.round(middle(x), 6).alias("central"), (F.array_max(x) / F.array_min(x) > 1.5).alias("anomalous"), F.size(x).alias("known"))


@query("AGG-32", "AGG-51", sql=with_sales("""
select part_id, len(k)::int as kept, round((k[(len(k) + 1) // 2] + k[len(k) // 2 + 1]) / 2, 6) as central, k[1] as low, k[-1] as high from (
  select *, list_filter(x, lambda v: v >= greatest(lo - reach, 0.01) and v <= hi + reach) as k from (select *, case when hi - lo > 0 then 1.5 * (hi - lo) else 0.4::double * med end as reach from h))""", """
a as (select part_id, count(*) as n, list_sort(list(floor(price * 100 + 0.5) / 100.0::double)) as x from sales where source = 'F' and age >= 0 group by part_id having count(*) >= 3),
h as (select *, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 as med, case when n >= 4 then (x[(n // 2 + 1) // 2] + x[(n // 2) // 2 + 1]) / 2 else x[1] end as lo,
   case when n >= 4 then (x[n - n // 2 + (n // 2 + 1) // 2] + x[n - n // 2 + (n // 2) // 2 + 1]) / 2 else x[-1] end as hi from a)"""))
def sold_estimates(spark, sf_dir):
    rows = counted(sales(spark, sf_dir).where("source = 'F' and age >= 0"), ["part_id"], cents(F.col("price"))).where("n >= 3")
    fences = hinge_rows(rows, ["part_id"]).select("part_id", "low_fence", "high_fence")
    kept = narrowed(rows.join(fences, "part_id"), ["part_id"], F.col("v").between(F.col("low_fence"), F.col("high_fence")))
    g = kept.groupBy("part_id").agg(F.max("n").cast("int").alias("kept"), F.round(middle_at("0", "n"), 6).alias("central"), F.min("v").alias("low"), F.max("v").alias("high"))
    return g.select("part_id", "kept", "central", "low", "high")


@query("SRC-38", sql="""
select page_id, count(*) as seeds, case when count(*) = 1 then min(s_suppkey) end as seed from pages join supplier on length(url) % 100 = s_suppkey % 100 and (page_id + s_suppkey) % 3 = 0 group by page_id""")
def pages_matched_to_seeds(spark, sf_dir):
    """A page counts for a seed only if exactly one seed fits."""
    p, s = table(spark, sf_dir, "pages").select("page_id", (F.length("url") % 100).alias("k")), table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 100).alias("k"))
    rows = p.join(s, "k").where((F.col("page_id") + F.col("s_suppkey")) % 3 == 0)
    return rows.groupBy("page_id").agg(F.count("s_suppkey").alias("seeds"), F.when(F.count("s_suppkey") == 1, F.min("s_suppkey")).alias("seed"))


@query("JOI-24", sql="select p_partkey, case when p_type = 'SMALL' then 'pinned' when p_size % 4 = 0 then 'ambiguous' else 'resolved' end as state, case when p_type = 'SMALL' then 'sml' when p_size % 4 = 0 then null else lower(substr(p_type, 1, 3)) end as set_id from part")
def pinned_sets(spark, sf_dir):
    """A pinned set overrides what was resolved; without one, a conflict leaves none."""
    pins = spark.createDataFrame([("SMALL", "sml")], "p_type string, pin string")
    rows = table(spark, sf_dir, "part").join(pins, "p_type", "left")
    conflict = F.col("p_size") % 4 == 0
    return rows.select("p_partkey", F.when(F.col("pin").isNotNull(), "pinned").when(conflict, "ambiguous").otherwise("resolved").alias("state"), F.coalesce("pin", F.when(~conflict, F.lower(F.substring("p_type", 1, 3)))).alias("set_id"))


@query("STR-56", sql="select page_id, pass from (select page_id, 0 as pass from pages where url like '%page=%' union all select page_id, 1 from pages where url not like '%page=%' and url like '%/en/%')")
def query_plan(spark, sf_dir):
    """Two ordered passes: narrow pages first, broad ones after; stages are composed, never patched."""
    p = table(spark, sf_dir, "pages")
    narrow = lambda df: df.where("url like '%page=%'").select("page_id", F.lit(0).alias("pass"))
    broad = lambda df: df.where("url not like '%page=%' and url like '%/en/%'").select("page_id", F.lit(1).alias("pass"))
    return p.transform(narrow).unionByName(p.transform(broad))
