"""Cross-grader ratios: spreads of tiers, hierarchical back-off, date-matched pairs, provider consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import sales, with_sales
from .robust import near

TIERS = """t as (select identity, grade, grader, count(*) as n, count(*) filter (age <= 90) as n90, median(price) as m, min(sold_at) as first, max(sold_at) as last from sales where age >= 0 group by all)"""


def tiers(spark, sf_dir) -> DataFrame:
    s = sales(spark, sf_dir).where("age >= 0")
    return s.groupBy("identity", "grade", "grader").agg(F.count("price").alias("n"), F.count_if(F.col("age") <= 90).alias("n90"), F.median("price").alias("m"), F.min("sold_at").alias("first"), F.max("sold_at").alias("last"))


@query("AGG-12", "JOI-10", sql=with_sales("""
select r.identity, r.grade, t2.grader as target, round(t2.m / r.m, 4) as ratio, r.n + t2.n as n from t r join t t2 on r.identity = t2.identity and r.grade = t2.grade and r.grader = 'N' and t2.grader <> 'N'
where r.n >= 2 and t2.n >= 2 and date_diff('day', least(r.first, t2.first), greatest(r.last, t2.last)) <= 1500""", TIERS))
def grader_spreads(spark, sf_dir):
    t = tiers(spark, sf_dir).where("n >= 2")
    ref = t.where("grader = 'N'").select("identity", "grade", F.col("n").alias("rn"), F.col("m").alias("rm"), F.col("first").alias("rf"), F.col("last").alias("rl"))
    rows = t.where("grader <> 'N'").join(ref, ["identity", "grade"])
    rows = rows.where(F.datediff(F.greatest("last", "rl"), F.least("first", "rf")) <= 1500)
    return rows.select("identity", "grade", F.col("grader").alias("target"), F.round(F.try_divide("m", "rm"), 4).alias("ratio"), (F.col("n") + F.col("rn")).alias("n"))


@query("AGG-11", "AGG-13", sql=with_sales("""
select count(*) as tiers, count(*) filter (n >= 2) as two, count(*) filter (n >= 3) as three, count(*) filter (n >= 5) as five, count(*) filter (n >= 3 and n90 >= 2) as ready, min(first) as first, max(last) as last from t""", TIERS))
def depth_summary(spark, sf_dir):
    return tiers(spark, sf_dir).agg(
        F.count("n").alias("tiers"), F.count_if(F.col("n") >= 2).alias("two"), F.count_if(F.col("n") >= 3).alias("three"), F.count_if(F.col("n") >= 5).alias("five"),
        F.count_if((F.col("n") >= 3) & (F.col("n90") >= 2)).alias("ready"), F.min("first").alias("first"), F.max("last").alias("last"),
    )


HIERARCHY = TIERS + """,
o as (select a.identity, split_part(a.identity, '|', 2) as segment, a.m / b.m as ratio from t a join t b on a.identity = b.identity and a.grade = b.grade and a.grader = 'A' and b.grader = 'N' where a.n >= 2 and b.n >= 2),
e1 as (select identity, count(*) as n, quantile_cont(ratio, 0.25) as a, median(ratio) as b, quantile_cont(ratio, 0.75) as c from o group by identity),
e2 as (select segment, count(*) as n, quantile_cont(ratio, 0.25) as a, median(ratio) as b, quantile_cont(ratio, 0.75) as c from o group by segment),
e3 as (select count(*) as n, quantile_cont(ratio, 0.25) as a, median(ratio) as b, quantile_cont(ratio, 0.75) as c from o),
h as (select i.identity, case when e1.n >= 5 then 'exact' when e2.n >= 3 then 'segment' when e3.n >= 5 then 'broad' end as level,
   case when e1.n >= 5 then e1.n when e2.n >= 3 then e2.n else e3.n end as n, case when e1.n >= 5 then e1.a when e2.n >= 3 then e2.a else e3.a end as a,
   case when e1.n >= 5 then e1.b when e2.n >= 3 then e2.b else e3.b end as b, case when e1.n >= 5 then e1.c when e2.n >= 3 then e2.c else e3.c end as c
  from (select distinct identity, split_part(identity, '|', 2) as segment from t) i left join e1 on i.identity = e1.identity left join e2 on i.segment = e2.segment cross join e3)"""


def backed_off(spark, sf_dir, least=(5, 3, 5)) -> DataFrame:
    """Ratio of grader A to N for each identity: its own pairs if there are enough, else its segment's, else all."""
    t = tiers(spark, sf_dir)
    ref = t.where("grader = 'N' and n >= 2").select("identity", "grade", F.col("m").alias("rm"))
    segment = F.split_part("identity", F.lit("|"), F.lit(2)).alias("segment")
    o = t.where("grader = 'A' and n >= 2").join(ref, ["identity", "grade"]).select("identity", segment, F.try_divide("m", "rm").alias("ratio"))
    agg = [F.count("ratio").alias("n"), F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")]
    named = lambda df, k: df.withColumnsRenamed({"n": f"n{k}", "q": f"q{k}"})
    own, near, every = named(o.groupBy("identity").agg(*agg), 1), named(o.groupBy("segment").agg(*agg), 2), named(o.agg(*agg), 3)
    ids = t.select("identity", segment).distinct()
    rows = ids.join(own, "identity", "left").join(near, "segment", "left").join(every, F.lit(True))  # one row
    pick = lambda c: F.when(F.col("n1") >= least[0], F.col(f"{c}1")).when(F.col("n2") >= least[1], F.col(f"{c}2")).otherwise(F.col(f"{c}3"))
    level = F.when(F.col("n1") >= least[0], "exact").when(F.col("n2") >= least[1], "segment").when(F.col("n3") >= least[2], "broad")
    return rows.select("identity", level.alias("level"), pick("n").alias("n"), pick("q").alias("q"))


@query("AGG-21", "JOI-11", sql=with_sales("""
select identity, level, n, round(a, 6) as p25, round(b, 6) as p50, round(c, 6) as p75, case when n >= 8 and c / a <= 1.15 then 'high' when n >= 3 and c / a <= 1.35 then 'medium' else 'low' end as confidence from h""", HIERARCHY))
def hierarchical_ratios(spark, sf_dir):
    r, q = backed_off(spark, sf_dir), F.col("q")
    label = F.when((F.col("n") >= 8) & (q[2] / q[0] <= 1.15), "high").when((F.col("n") >= 3) & (q[2] / q[0] <= 1.35), "medium").otherwise("low")
    return r.select("identity", "level", "n", *[F.round(q[i], 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], label.alias("confidence"))


@query("AGG-22", "TOP-11", sql=with_sales("""
select t.identity, t.grade, round(1e-9 + t.m / h.c, 4) as low, round(1e-9 + t.m / h.b, 4) as mid, round(1e-9 + t.m / h.a, 4) as high from t join h using (identity) where t.grader = 'A'""", HIERARCHY))
def proxy_values(spark, sf_dir):
    rows = tiers(spark, sf_dir).where("grader = 'A'").select("identity", "grade", "m").join(backed_off(spark, sf_dir).select("identity", "q"), "identity")
    return rows.select("identity", "grade", *[near(F.try_divide(F.col("m"), F.col("q")[i]), 4).alias(c) for c, i in (("low", 2), ("mid", 1), ("high", 0))])


@query("JOI-09", "AGG-35", sql=with_sales("""
select identity, count(*) as pairs, round(median(ratio), 6) as ratio, min(delta) as nearest from (
  select a.identity, a.part_id, a.sold_at, a.price, a.price / median(b.price) as ratio, min(abs(date_diff('day', a.sold_at, b.sold_at))) as delta
  from sales a join sales b on a.part_id = b.part_id and a.grade = b.grade and abs(date_diff('day', a.sold_at, b.sold_at)) <= 90 where a.grader = 'A' and b.grader = 'N' group by a.identity, a.part_id, a.sold_at, a.price) group by identity"""))
def date_matched_ratios(spark, sf_dir):
    """Interval join on sale dates within 90 days: the reference side goes into its own and both neighbouring
    90-day buckets, so the join is an equality on part, grade and bucket with the interval as a residual."""
    s = sales(spark, sf_dir)
    day = F.datediff("sold_at", F.lit("1990-01-01"))
    bucket = F.floor(day / 90)
    target = s.where("grader = 'A'").select("identity", "part_id", "grade", "sold_at", "price", day.alias("day"), bucket.alias("bucket"))
    ref = s.where("grader = 'N'").select("part_id", "grade", F.col("price").alias("rp"), day.alias("rd"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    pairs = target.join(ref, ["part_id", "grade", "bucket"]).where("abs(day - rd) <= 90")
    per = pairs.groupBy("identity", "part_id", "sold_at", "price").agg((F.first("price") / F.median("rp")).alias("ratio"), F.min(F.abs(F.col("day") - F.col("rd"))).cast("long").alias("delta"))
    return per.groupBy("identity").agg(F.count("ratio").alias("pairs"), F.round(F.median("ratio"), 6).alias("ratio"), F.min("delta").alias("nearest"))


@query("AGG-24", sql=with_sales("""
select identity, level, count(*) as providers, round(median(m), 6) as central, round(min(m), 6) as low, round(max(m), 6) as high, (max(m) - min(m)) / median(m) > 0.5 as conflict,
  case when count(*) = 1 then 'single' when max(m) / min(m) > 1.25 then 'conflict' else 'agreed' end as decision
from (select identity, grade::int as level, grader, median(price) as m from sales group by all) group by identity, level"""))
def provider_levels(spark, sf_dir):
    p = sales(spark, sf_dir).groupBy("identity", F.col("grade").cast("int").alias("level"), "grader").agg(F.median("price").alias("m"))
    lo, hi, mid, n = F.min("m"), F.max("m"), F.median("m"), F.count("m")
    return p.groupBy("identity", "level").agg(
        n.alias("providers"), F.round(mid, 6).alias("central"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), ((hi - lo) / mid > 0.5).alias("conflict"),
        F.when(n == 1, "single").when(hi / lo > 1.25, "conflict").otherwise("agreed").alias("decision"),
    )


@query("AGG-27", "AGG-33", sql=with_sales("""
select part_id, count(*) as providers, round(1e-9 + median(c), 6) as central, round(1e-9 + min(c) * 0.9, 6) as low, round(1e-9 + max(c) * 1.1, 6) as high,
  case when count(*) < 2 then 'weak' when max(c) / min(c) <= 1.35 and (max(c) - min(c)) / median(c) <= 0.35 then 'strong' when max(c) / min(c) <= 1.75 then 'moderate' else 'weak' end as consensus
from (select p.*, x.clean from p join (select part_id, median(c) as clean from p group by part_id) x using (part_id)) where c between 0.4 * clean and 1.8 * clean group by part_id""", "p as (select part_id, grader || source as provider, median(price) as c from sales group by all having count(*) >= 2)"))
def provider_consensus(spark, sf_dir):
    p = sales(spark, sf_dir).groupBy("part_id", F.concat("grader", "source").alias("provider")).agg(F.median("price").alias("c"), F.count("price").alias("k")).where("k >= 2")
    clean = p.groupBy("part_id").agg(F.median("c").alias("clean"))
    rows = p.join(clean, "part_id").where(F.col("c").between(0.4 * F.col("clean"), 1.8 * F.col("clean")))
    lo, hi, mid = F.min("c"), F.max("c"), F.median("c")
    label = F.when(F.count("c") < 2, "weak").when((hi / lo <= 1.35) & ((hi - lo) / mid <= 0.35), "strong").when(hi / lo <= 1.75, "moderate").otherwise("weak")
    return rows.groupBy("part_id").agg(F.count("c").alias("providers"), near(mid, 6).alias("central"), near(lo * 0.9, 6).alias("low"), near(hi * 1.1, 6).alias("high"), label.alias("consensus"))


@query("AGG-36", "AGG-52", sql=with_sales("""
select part_id, count(*) as anchors, round(sum(c * w) / sum(w), 4) as central, case when (max(c) - min(c)) / (sum(c * w) / sum(w)) <= 0.35 then 'tight' when (max(c) - min(c)) / (sum(c * w) / sum(w)) <= 1 then 'wide' else 'loose' end as spread
from (select part_id, grade, source, median(price) as c, case when source = 'F' then 0.15::double else 1::double end * case when grade < 4 then 0.65::double else 1::double end as w from sales group by all) group by part_id"""))
def weighted_anchors(spark, sf_dir):
    a = sales(spark, sf_dir).groupBy("part_id", "grade", "source").agg(F.median("price").alias("c"))
    w = F.when(F.col("source") == "F", 0.15).otherwise(1.0) * F.when(F.col("grade") < 4, 0.65).otherwise(1.0)
    a = a.withColumn("w", w)
    central = F.sum(F.col("c") * F.col("w")) / F.sum("w")
    gap = (F.max("c") - F.min("c")) / central
    return a.groupBy("part_id").agg(F.count("c").alias("anchors"), F.round(central, 4).alias("central"), F.when(gap <= 0.35, "tight").when(gap <= 1, "wide").otherwise("loose").alias("spread"))


@query("SRC-23", "SRC-24", sql="""
select currency, count(*) as n, count(*) filter (not valid) as invalid, round(sum(price) filter (valid), 2) as total from (
  select *, price > 0 and status = 'sold' and regexp_full_match(currency, '[A-Z]{3}') as valid from (
    select case event_type when 'purchase' then 'sold' when 'signup' then 'sold' else 'open' end as status, value as price, case user_id % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'eur' else 'JPY' end as currency from events)) group by currency""")
def parsed_sale_records(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id") % 4
    r = e.select(F.when(F.col("event_type").isin("purchase", "signup"), "sold").otherwise("open").alias("status"), F.expr("try_cast(cast(value as string) as decimal(18,6))").alias("price"), F.when(u == 0, "EUR").when(u == 1, "USD").when(u == 2, "eur").otherwise("JPY").alias("currency"))
    valid = (F.col("price") > 0) & (F.col("status") == "sold") & F.col("currency").rlike("^[A-Z]{3}$")
    return r.groupBy("currency").agg(F.count("price").alias("n"), F.count_if(~valid).alias("invalid"), F.round(F.sum(F.when(valid, F.col("price"))).cast("double"), 2).alias("total"))
