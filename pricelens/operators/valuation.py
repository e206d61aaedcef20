"""Market estimates, thresholds, confidence, and decisions on listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import LISTINGS_SQL, listings, sales, with_sales
from .robust import (
    LINEAR_RECENCY_SQL, STEP_RECENCY_SQL, dispersion_label, keep_mad, keep_mad_sql, linear_recency, liquidity_label,
    lower_weighted_median, near, step_recency, weighted_quantiles, weighted_quantiles_sql,
)

LEAST_DISCOUNT, MOST_DISCOUNT = 30, 45


def comparable_weight(age: Column, exact: Column, same_grade: Column, secondary: Column, score: Column) -> Column:
    """Recency, less for inexact identity, another grade, a secondary source and a low match score; at least 0.05."""
    w = linear_recency(age) * F.when(exact, 1.0).otherwise(0.70) * F.when(same_grade, 1.0).otherwise(0.65) * F.when(secondary, 0.90).otherwise(1.0)
    return F.greatest(w * F.least(F.greatest(score / 100.0, F.lit(0.60)), F.lit(1.0)), F.lit(0.05))


#: Sales of an identity as comparables: grade 5 and up counts as the same grade, source F as secondary.
WEIGHTED = f"""w as (select *, greatest({LINEAR_RECENCY_SQL} * case when grade >= 5 then 1::double else 0.65::double end
  * case when source = 'F' then 0.90::double else 1::double end * least(greatest((60 + 8 * grade) / 100.0::double, 0.60::double), 1.0::double), 0.05::double) as weight from kept)"""


def weighted_comparables(rows: DataFrame) -> DataFrame:
    score = F.lit(60) + 8 * F.col("grade")
    return rows.withColumn("weight", comparable_weight(F.col("age"), F.lit(True), F.col("grade") >= 5, F.col("source") == "F", score))


def discount_threshold(n: Column, dispersion: Column, liquidity: Column, recent: Column, dated: Column, exact_share: Column, consistent: Column, foreign: Column) -> Column:
    """Least discount in percent: 40 to 30 by the number of sales, more for each weakness, at most 45."""
    t = F.when(n <= 2, 40).when(n <= 4, 35).otherwise(30)
    t = t + F.when(dispersion == "high", 5).otherwise(0) + F.when(liquidity == "low", 2).otherwise(0)
    t = t + F.when((recent == 0) & (dated > 0), 3).when((dated >= 2) & (2 * recent < dated), 2).otherwise(0)
    t = t + F.when(exact_share < 0.5, 2).otherwise(0) + F.when(consistent == F.lit(False), 3).otherwise(0) + F.when(foreign, 5).otherwise(0)
    return F.greatest(F.lit(LEAST_DISCOUNT), F.least(t, F.lit(MOST_DISCOUNT)))


def confidence(n: Column, exact_share: Column, grade_share: Column, recent: Column, dispersion: Column, liquidity: Column, consistent: Column) -> Column:
    fine = F.coalesce(consistent, F.lit(True))
    high = (n >= 5) & (exact_share >= 0.8) & (grade_share >= 0.6) & (recent / n >= 0.5) & (dispersion != "high") & (liquidity == "high") & fine
    medium = (n >= 3) & (exact_share >= 0.65) & (grade_share >= 0.5) & (dispersion != "high") & (liquidity != "low") & fine
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def market_estimates(rows: DataFrame, by: list[str]) -> DataFrame:
    """low, central, high (weighted quartiles of kept comparables) with their quality, for each group."""
    kept = weighted_comparables(keep_mad(rows, by))
    prices = weighted_quantiles(kept, by, {"low": 0.25, "central": 0.5, "high": 0.75})
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    quality = kept.groupBy(*by).agg(
        F.count("price").alias("n"), q.alias("q"), F.count_if(F.col("age") <= 90).alias("n90"), F.count_if(F.col("age") <= 180).alias("n180"),
        F.avg((F.col("grade") >= 5).cast("double")).alias("grade_share"),
    )
    medians = kept.groupBy(*by, "source").agg(F.median("price").alias("m"), F.count("price").alias("k")).where("k >= 2")
    sources = medians.groupBy(*by).agg(F.when(F.count("m") >= 2, F.max("m") / F.min("m") <= 1.35).alias("consistent"))
    out = prices.join(quality, by).join(sources, by, "left")
    out = out.withColumn("dispersion", dispersion_label(F.col("n"), F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1])))
    out = out.withColumn("liquidity", liquidity_label(F.col("n"), F.col("n90"), F.col("n180")))
    c = F.col
    return out.withColumns({
        "threshold": discount_threshold(c("n"), c("dispersion"), c("liquidity"), c("n90"), c("n"), c("grade_share"), c("consistent"), F.lit(False)),
        "confidence": confidence(c("n"), F.lit(1.0), c("grade_share"), c("n90"), c("dispersion"), c("liquidity"), c("consistent")),
    }).drop("q")


ESTIMATES = [
    "past as (select * from sales where age >= 0)", keep_mad_sql("past", "part_id"), WEIGHTED, weighted_quantiles_sql("w", "part_id", {"low": 0.25, "central": 0.5, "high": 0.75}),
    """qu as (select part_id, count(*) as n, count(*) filter (age <= 90) as n90, count(*) filter (age <= 180) as n180, avg((grade >= 5)::int::double) as grade_share,
        (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) as spread from w group by part_id),
    so as (select part_id, case when count(*) >= 2 then max(m) / min(m) <= 1.35 end as consistent from (select part_id, source, median(price) as m from w group by all having count(*) >= 2) group by part_id),
    lb as (select *, case when n < 2 then 'not measurable' when spread <= 0.15 then 'low' when spread <= 0.35 then 'medium' else 'high' end as dispersion,
        case when n >= 5 and n90 >= 3 then 'high' when (n >= 3 and n180 >= 2) or (n >= 5 and n90 >= 1) then 'medium' else 'low' end as liquidity from qu left join so using (part_id)),
    est as (select *, greatest(30, least(45, case when n <= 2 then 40 when n <= 4 then 35 else 30 end + case when dispersion = 'high' then 5 else 0 end + case when liquidity = 'low' then 2 else 0 end
          + case when n90 = 0 then 3 when n >= 2 and 2 * n90 < n then 2 else 0 end + case when grade_share < 0.5 then 2 else 0 end + case when consistent = false then 3 else 0 end)) as threshold,
        case when n >= 5 and grade_share >= 0.6 and n90 / n >= 0.5 and dispersion <> 'high' and liquidity = 'high' and coalesce(consistent, true) then 'high'
          when n >= 3 and grade_share >= 0.5 and dispersion <> 'high' and liquidity <> 'low' and coalesce(consistent, true) then 'medium' else 'low' end as confidence
      from wq join lb using (part_id))""",
]


@query("NUM-13", "NUM-14", "NUM-15", "AGG-42", "AGG-50", sql=with_sales("\nselect part_id, n, round(low, 4) as low, round(central, 4) as central, round(high, 4) as high, dispersion, liquidity, consistent, threshold, confidence from est", *ESTIMATES))
def market_estimate(spark, sf_dir):
    out = market_estimates(sales(spark, sf_dir).where("age >= 0"), ["part_id"])
    return out.select("part_id", "n", *[F.round(c, 4).alias(c) for c in ("low", "central", "high")], "dispersion", "liquidity", "consistent", "threshold", "confidence")


ROLES = {"same": 0, "lower": 1, "upper": 2}


def bounded_estimates(asks: DataFrame, sold: DataFrame) -> DataFrame:
    """low, central and high of asks (listing_id, g, want, ask: house, grade, price) from sales of their part and house, with arbitrage, reference_grade and reference_value.

    Sales of the same grade are the comparables; those of the next lower and the next higher grade bound them: low is at most the weighted median of the
    lower ones, high at least that of the upper ones. Without a sale of the grade, the next lower grade stands for it if the ask is not above its median (arbitrage).
    Each group loses its outliers on its own. Asks without either have no row.
    """
    c = F.col
    rows = sold.where("price > 0").join(asks, (c("part_id") == c("listing_id")) & (c("grader") == c("g")))
    near = rows.groupBy(c("listing_id").alias("_l")).agg(F.max(F.when(c("grade") < c("want"), c("grade"))).alias("_low"), F.min(F.when(c("grade") > c("want"), c("grade"))).alias("_high"))
    rows = rows.join(near, c("listing_id") == c("_l"))
    role = F.when(c("grade") == c("want"), 0).when(c("grade") == c("_low"), 1).when(c("grade") == c("_high"), 2)
    rows = rows.withColumn("key", c("listing_id") * 4 + role).where("key is not null")
    kept = keep_mad(rows.select("key", "price", "age", "grade", "source"), ["key"])
    quartiles = weighted_quantiles(weighted_comparables(kept), ["key"], {"low": 0.25, "central": 0.5, "high": 0.75})
    plain = kept.groupBy("key").agg(F.percentile("price", 0.5).alias("median"), F.max("grade").alias("grade"), F.count("price").alias("n"))
    each = quartiles.join(plain, "key").withColumn("e", F.struct("low", "central", "high", "median", "grade", "n"))
    of = [F.max(F.when(c("key") % 4 == r, c("e"))).alias(name) for name, r in ROLES.items()]
    g = each.groupBy(F.floor(c("key") / 4).alias("listing_id")).agg(*of).join(asks.select("listing_id", "ask"), "listing_id")
    arbitrage = c("same").isNull() & (c("ask") <= c("lower.median"))
    g = g.withColumn("arbitrage", F.coalesce(arbitrage, F.lit(False))).withColumn("own", F.coalesce(c("same"), F.when(c("arbitrage"), c("lower")))).where("own is not null")
    low = F.least("own.low", "own.central", F.when(~c("arbitrage"), c("lower.central")))  # nulls are passed over
    high = F.greatest("own.high", "own.central", "upper.central")
    return g.select(
        "listing_id", c("own.n").alias("n"), low.alias("low"), c("own.central").alias("central"), high.alias("high"), "arbitrage",
        F.when(c("arbitrage"), c("lower.grade")).alias("reference_grade"), F.when(c("arbitrage"), c("lower.median")).alias("reference_value"),
    )


BOUNDED = [
    LISTINGS_SQL,
    """near as (select s.*, listing_id, l.price as ask, l.grade as want, max(case when s.grade < l.grade then s.grade end) over (partition by listing_id) as lo, min(case when s.grade > l.grade then s.grade end) over (partition by listing_id) as hi
      from sales s join listings l on s.part_id = l.listing_id and s.grader = l.grader where s.age >= 0 and s.price > 0),
    roles as (select *, listing_id * 4 + case when grade = want then 0 when grade = lo then 1 else 2 end as key from near where grade in (want, lo, hi))""",
    keep_mad_sql("roles", "key"), WEIGHTED, weighted_quantiles_sql("w", "key", {"low": 0.25, "central": 0.5, "high": 0.75}),
    """md as (select key, median(price) as med, max(grade) as grade, count(*) as n, max(ask) as ask from kept group by key),
    e as (select key // 4 as listing_id, key % 4 as role, * exclude (key) from wq join md using (key)),
    s as (select coalesce(a.listing_id, b.listing_id) as listing_id, a.central is null as missing, coalesce(a.ask, b.ask) as ask, a.n as n0, a.low as l0, a.central as c0, a.high as h0, b.n as n1, b.low as l1, b.central as c1, b.high as h1, b.med as m1, b.grade as g1
      from (select * from e where role = 0) a full join (select * from e where role = 1) b on a.listing_id = b.listing_id),
    o as (select s.*, u.central as cu, missing as arb from s left join (select * from e where role = 2) u on u.listing_id = s.listing_id where not missing or s.ask <= m1)""",
]


@query("AGG-07", "WIN-02", sql=with_sales("""
select listing_id, case when arb then n1 else n0 end as n, round(1e-9 + case when arb then least(l1, c1) else least(l0, c0, c1) end, 4) as low, round(1e-9 + case when arb then c1 else c0 end, 4) as central,
  round(1e-9 + case when arb then greatest(h1, c1, cu) else greatest(h0, c0, cu) end, 4) as high, arb as arbitrage, case when arb then g1 end as reference_grade, round(1e-9 + case when arb then m1 end, 4) as reference_value from o""", *BOUNDED))
def bounded_market_estimates(spark, sf_dir):
    """Estimates for every ask whose house has sold its grade, or a lower one for no less."""
    asks = listings(spark, sf_dir).select("listing_id", F.col("grader").alias("g"), F.col("grade").alias("want"), F.col("price").alias("ask"))
    out = bounded_estimates(asks, sales(spark, sf_dir).where("age >= 0").select("part_id", "grader", "grade", "price", "age", "source"))
    return out.select("listing_id", "n", *[near(F.col(c), 4).alias(c) for c in ("low", "central", "high")], "arbitrage", "reference_grade", near(F.col("reference_value"), 4).alias("reference_value"))


def rejection(price: Column, central: Column, low: Column, threshold: Column) -> Column:
    """Why a listing is no opportunity; empty if it is one."""
    discount = (central - price) / central * 100
    most = low * (1 - threshold / 100)
    return F.when(central.isNull(), "no estimate").when(discount < threshold, "discount too small").when(price > most, "above the prudent price").otherwise("")


@query("FLT-11", "NUM-22", sql=with_sales("""
select listing_id, round((central - l.price) / central * 100, 4) as discount, round(low * (1 - threshold / 100), 4) as most,
  case when central is null then 'no estimate' when (central - l.price) / central * 100 < threshold then 'discount too small' when l.price > low * (1 - threshold / 100) then 'above the prudent price' else '' end as reason
from listings l left join est on listing_id = part_id""", *ESTIMATES, LISTINGS_SQL))
def opportunities(spark, sf_dir):
    est = market_estimates(sales(spark, sf_dir).where("age >= 0"), ["part_id"])
    rows = listings(spark, sf_dir).join(est, F.col("listing_id") == F.col("part_id"), "left")
    c = F.col
    return rows.select("listing_id", F.round((c("central") - c("price")) / c("central") * 100, 4).alias("discount"), F.round(c("low") * (1 - c("threshold") / 100), 4).alias("most"), rejection(c("price"), c("central"), c("low"), c("threshold")).alias("reason"))


@query("WIN-02", sql=with_sales("""
select l.listing_id, max(s.grade) filter (s.grade < l.grade) as lower_grade, min(s.grade) filter (s.grade > l.grade) as higher_grade, count(*) filter (s.grade = l.grade) as same
from listings l join sales s on s.part_id = l.listing_id and s.grader = l.grader group by l.listing_id""", LISTINGS_SQL))
def nearest_grades(spark, sf_dir):
    s = sales(spark, sf_dir).select("part_id", F.col("grader").alias("g"), F.col("grade").alias("sold_grade"))
    rows = listings(spark, sf_dir).join(s, (F.col("listing_id") == F.col("part_id")) & (F.col("grader") == F.col("g")))
    below, above = F.col("sold_grade") < F.col("grade"), F.col("sold_grade") > F.col("grade")
    return rows.groupBy("listing_id").agg(F.max(F.when(below, F.col("sold_grade"))).alias("lower_grade"), F.min(F.when(above, F.col("sold_grade"))).alias("higher_grade"), F.count_if(F.col("sold_grade") == F.col("grade")).alias("same"))


@query("WIN-03", "AUD-07", sql=with_sales("""
select listing_id, case when same > 0 then 'exact grade' when lower_median is not null and price <= lower_median then 'grade arbitrage' when other > 0 then 'other grader' else 'none' end as tier,
  round(case when same > 0 then same_median when lower_median is not null and price <= lower_median then lower_median end, 6) as reference
from listings left join t using (listing_id)""", LISTINGS_SQL, """
n as (select l.listing_id, max(s.grade) as g from listings l join sales s on s.part_id = l.listing_id and s.grader = l.grader and s.grade < l.grade group by 1),
t as (select l.listing_id, count(*) filter (s.grader = l.grader and s.grade = l.grade) as same, median(s.price) filter (s.grader = l.grader and s.grade = l.grade) as same_median,
        median(s.price) filter (s.grader = l.grader and s.grade = n.g) as lower_median, count(*) filter (s.grader <> l.grader and s.grade = l.grade) as other
      from listings l join sales s on s.part_id = l.listing_id left join n on n.listing_id = l.listing_id group by l.listing_id)"""))
def comparable_tiers(spark, sf_dir):
    ask = listings(spark, sf_dir).select("listing_id", F.col("grader").alias("g"), F.col("grade").alias("want"), F.col("price").alias("ask"))
    rows = sales(spark, sf_dir).join(ask, F.col("part_id") == F.col("listing_id"))
    own = F.col("grader") == F.col("g")
    near = F.max(F.when(own & (F.col("grade") < F.col("want")), F.col("grade"))).over(Window.partitionBy("listing_id"))
    rows = rows.withColumn("near", near)
    same = own & (F.col("grade") == F.col("want"))
    t = rows.groupBy("listing_id").agg(
        F.count_if(same).alias("same"), F.median(F.when(same, F.col("price"))).alias("same_median"),
        F.median(F.when(own & (F.col("grade") == F.col("near")), F.col("price"))).alias("lower_median"), F.count_if(~own & (F.col("grade") == F.col("want"))).alias("other"),
    )
    out = ask.join(t, "listing_id", "left")
    arbitrage = F.col("lower_median").isNotNull() & (F.col("ask") <= F.col("lower_median"))
    tier = F.when(F.col("same") > 0, "exact grade").when(arbitrage, "grade arbitrage").when(F.col("other") > 0, "other grader").otherwise("none")
    value = F.when(F.col("same") > 0, F.col("same_median")).when(arbitrage, F.col("lower_median"))
    return out.select("listing_id", tier.alias("tier"), F.round(value, 6).alias("reference"))


@query("AGG-08", sql=with_sales("""
select s.identity, s.grade, count(*) as n, round(min(s.price * r.ratio), 4) as lowest from sales s join b r on s.identity = r.identity where s.grader <> 'N' and r.grader = s.grader group by all""", """
m as (select identity, grader, median(price) as m, count(*) as n, max(sold_at) as last from sales where age >= 0 group by all),
b as (select a.identity, a.grader, t.m / a.m as ratio from m a join m t on a.identity = t.identity and t.grader = 'N' where a.grader <> 'N' and a.n >= 3 and t.n >= 3)"""))
def converted_prices(spark, sf_dir):
    s = sales(spark, sf_dir)
    m = s.where("age >= 0").groupBy("identity", "grader").agg(F.median("price").alias("m"), F.count("price").alias("n"), F.max("sold_at").alias("last")).where("n >= 3")
    target = m.where("grader = 'N'").select("identity", F.col("m").alias("t"))
    ratio = m.where("grader <> 'N'").join(target, "identity")
    best = ratio.groupBy("identity", "grader").agg(F.max_by(F.try_divide("t", "m"), F.struct("n", "last")).alias("ratio"))
    return s.join(best, ["identity", "grader"]).groupBy("identity", "grade").agg(F.count("price").alias("n"), F.round(F.min(F.col("price") * F.col("ratio")), 4).alias("lowest"))


@query("AGG-20", "AGG-19", "UDF-04", sql=with_sales("""
select identity, grader, grade, n, round(1e-9 + case when n = 1 then mid * 0.75 when n <= 3 and lo < hi then lo when n <= 3 then lo * 0.85 else q1 end, 4) as low, round(1e-9 + mid, 4) as mid,
  round(1e-9 + case when n = 1 then mid * 1.25 when n <= 3 and lo < hi then hi when n <= 3 then hi * 1.15 else q3 end, 4) as high,
  case when n >= 8 and n90 >= 3 and (q3 - q1) / med <= 0.25 then 'high' when n >= 4 and n180 >= 2 and (q3 - q1) / med <= 0.5 then 'medium' else 'low' end as confidence
from g join d using (identity, grader, grade)""", f"""
ws as (select *, {STEP_RECENCY_SQL} as weight from sales where age >= 0),
g as (select identity, grader, grade, count(*) as n, min(price) as lo, max(price) as hi, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3, median(price) as med,
        count(*) filter (age <= 90) as n90, count(*) filter (age <= 180) as n180 from ws group by all),
d as (select identity, grader, grade, min(case when up >= total / 2 then price end) as mid from (select *, sum(weight) over (partition by identity, grader, grade order by price, weight rows unbounded preceding) as up,
        sum(weight) over (partition by identity, grader, grade) as total from ws) group by all)"""))
def direct_values(spark, sf_dir):
    by = ["identity", "grader", "grade"]
    rows = sales(spark, sf_dir).where("age >= 0").withColumn("weight", step_recency(F.col("age")))
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy(*by).agg(F.count("price").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), q.alias("q"), F.count_if(F.col("age") <= 90).alias("n90"), F.count_if(F.col("age") <= 180).alias("n180"))
    out = g.join(lower_weighted_median(rows, by).withColumnRenamed("median", "mid"), by)
    n, spread = F.col("n"), F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1])
    low = F.when(n == 1, F.col("mid") * 0.75).when((n <= 3) & (F.col("lo") < F.col("hi")), F.col("lo")).when(n <= 3, F.col("lo") * 0.85).otherwise(F.col("q")[0])
    high = F.when(n == 1, F.col("mid") * 1.25).when((n <= 3) & (F.col("lo") < F.col("hi")), F.col("hi")).when(n <= 3, F.col("hi") * 1.15).otherwise(F.col("q")[2])
    label = F.when((n >= 8) & (F.col("n90") >= 3) & (spread <= 0.25), "high").when((n >= 4) & (F.col("n180") >= 2) & (spread <= 0.5), "medium").otherwise("low")
    return out.select(*by, "n", near(low, 4).alias("low"), near("mid", 4).alias("mid"), near(high, 4).alias("high"), label.alias("confidence"))


@query("AGG-17", "AGG-23", "SET-08", "SRC-32", sql=with_sales("""
select count(*) as n, round(sum(price), 2) as total from (select distinct order_id, part_id, seller, grader, grade, price from sales)"""))
def deduplicated_sales(spark, sf_dir):
    d = sales(spark, sf_dir).dropDuplicates(["order_id", "part_id", "seller", "grader", "grade", "price"])
    return d.agg(F.count("price").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("AGG-39", "AGG-40", "TOP-05", sql=with_sales("""
select identity, n90, n, round(reference, 6) as reference from r where reference is not null order by n90 desc, n desc, reference desc, identity limit 40""", """
k as (select *, row_number() over (partition by identity order by age, price desc) as k, count(*) filter (age <= 90) over (partition by identity) as n90, count(*) over (partition by identity) as n from sales where age >= 0),
r as (select identity, any_value(n90) as n90, any_value(n) as n, case when any_value(n90) >= 2 then median(price) filter (age <= 90 and k <= 10) when any_value(n) >= 3 then median(price) filter (k <= 10) end as reference from k group by identity)"""))
def seed_panel(spark, sf_dir):
    w = Window.partitionBy("identity")
    rows = sales(spark, sf_dir).where("age >= 0").withColumns({"k": F.row_number().over(w.orderBy("age", F.col("price").desc())), "n90": F.count_if(F.col("age") <= 90).over(w), "n": F.count("price").over(w)})
    recent, late = F.median(F.when((F.col("age") <= 90) & (F.col("k") <= 10), F.col("price"))), F.median(F.when(F.col("k") <= 10, F.col("price")))
    g = rows.groupBy("identity").agg(F.first("n90").alias("n90"), F.first("n").alias("n"), recent.alias("recent"), late.alias("late"))
    value = F.when(F.col("n90") >= 2, F.col("recent")).when(F.col("n") >= 3, F.col("late"))
    out = g.select("identity", "n90", "n", F.round(value, 6).alias("reference"), value.alias("_v")).where("_v is not null")
    return out.orderBy(F.col("n90").desc(), F.col("n").desc(), F.col("_v").desc(), "identity").limit(40).drop("_v")
