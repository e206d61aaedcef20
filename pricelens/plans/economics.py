"""Costs, profits, expected value, and audits of coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.robust import near
from ..registry import query
from ..sources.tables import LISTINGS_SQL, listings, sales, table, with_sales

#: Probabilities of the grades 7 or lower, 8, 9, 10 for an assessed grade.
DISTRIBUTION = {7: [0.70, 0.20, 0.08, 0.02], 8: [0.30, 0.45, 0.20, 0.05], 9: [0.10, 0.30, 0.45, 0.15], 10: [0.05, 0.15, 0.40, 0.40]}


def all_costs(*parts: Column) -> Column:
    """Sum of the costs; null if one is unknown."""
    return reduce(lambda a, b: a + b, parts)


@query("NUM-24", "NUM-25", "NUM-26", "NUM-27", sql="with " + LISTINGS_SQL.strip() + """
select listing_id, level, round(value * 0.87::double - 0.3::double - cost, 4) as profit, round((value * 0.87::double - 0.3::double - cost) / cost * 100, 4) as roi, value * 0.87::double - 0.3::double - cost >= 10 as signal
from (select listing_id, level, price * factor as value, price + 20 + case when listing_id % 10 = 0 then null else (listing_id % 5)::double end as cost from listings cross join (values ('7', 0.8::double), ('8', 1.1::double), ('9', 1.6::double), ('10', 3.0::double)) t(level, factor))""")
def grade_profits(spark, sf_dir):
    l = listings(spark, sf_dir)
    cost = all_costs(F.col("price"), F.lit(20), F.when(F.col("listing_id") % 10 != 0, (F.col("listing_id") % 5).cast("double")))
    rows = l.withColumn("cost", cost).selectExpr("listing_id", "cost", "stack(4, '7', price * 0.8D, '8', price * 1.1D, '9', price * 1.6D, '10', price * 3.0D) as (level, value)")
    profit = F.col("value") * 0.87 - 0.3 - F.col("cost")
    return rows.select("listing_id", "level", F.round(profit, 4).alias("profit"), F.round(F.try_divide(profit, F.col("cost")) * 100, 4).alias("roi"), (profit >= 10).alias("signal"))


EV = """v as (select listing_id, price, p, 0.8::double * price * p[1] + 1.1::double * price * p[2] + 1.6::double * price * p[3] + 3.0::double * price * p[4] as gross
  from listings join (values (0, [0.70::double, 0.20, 0.08, 0.02]), (1, [0.30::double, 0.45, 0.20, 0.05]), (2, [0.10::double, 0.30, 0.45, 0.15]), (3, [0.05::double, 0.15, 0.40, 0.40])) d(k, p) on listing_id % 4 = k)"""


@query("NUM-28", "NUM-29", "NUM-30", sql=f"with {LISTINGS_SQL.strip()}, {EV}" + """
select listing_id, round(1e-9 + gross, 4) as gross, round(1e-9 + gross * 0.87::double - 25 - price, 4) as profit, round(1e-9 + (gross * 0.87::double - 25 - price) / (price + 25) * 100, 4) as roi,
  round(1e-9 + greatest(0, least(1, ((price + 25) / 0.87::double - 1.1::double * price) / (1.9::double * price))), 6) as break_even from v""")
def expected_values(spark, sf_dir):
    dist = spark.createDataFrame([(i, p) for i, p in enumerate(DISTRIBUTION.values())], "k int, p array<double>")
    rows = listings(spark, sf_dir).withColumn("k", (F.col("listing_id") % 4).cast("int")).join(dist, "k")
    price, p = F.col("price"), F.col("p")
    gross = 0.8 * price * p[0] + 1.1 * price * p[1] + 1.6 * price * p[2] + 3.0 * price * p[3]
    profit = gross * 0.87 - 25 - price
    need = ((price + 25) / 0.87 - 1.1 * price) / (1.9 * price)
    return rows.select("listing_id", near(gross, 4).alias("gross"), near(profit, 4).alias("profit"), near(profit / (price + 25) * 100, 4).alias("roi"), near(F.greatest(F.lit(0.0), F.least(F.lit(1.0), need)), 6).alias("break_even"))


@query("NUM-09", "NUM-34", "NUM-35", sql="with " + LISTINGS_SQL.strip() + """
select listing_id, round((price * 170 + 500) / 170.0::double * 1.05::double, 6) as landed, (price * 1.5::double - (price * 170 + 500) / 170.0::double * 1.05::double) / (price * 1.5::double) >= 0.3 as good from listings""")
def landed_prices(spark, sf_dir):
    landed = (F.col("price") * 170 + 500) / F.lit(170.0) * 1.05
    value = F.col("price") * 1.5
    return listings(spark, sf_dir).select("listing_id", F.round(landed, 6).alias("landed"), ((value - landed) / value >= 0.3).alias("good"))


@query("SRC-03", sql="""
select page, rows, different, rows - different as repeated, case when rows = 500 then 'complete' when rows > different then 'unknown' else 'incomplete' end as status from (select event_id // 500 as page, count(*) as rows, count(distinct user_id) as different from events group by 1)""")
def page_coverage(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 500").alias("page")).agg(F.count("event_id").alias("rows"), F.count_distinct("user_id").alias("different"))
    status = F.when(F.col("rows") == 500, "complete").when(F.col("rows") > F.col("different"), "unknown").otherwise("incomplete")
    return g.select("page", "rows", "different", (F.col("rows") - F.col("different")).alias("repeated"), status.alias("status"))


@query("AUD-05", "AUD-08", sql=with_sales("""
select count(*) as seen, count(*) filter (age >= 0) as past, count(*) filter (age >= 0 and price > 0) as priced, count(*) filter (age between 0 and 365) as recent, count(*) filter (age >= 0) + count(*) filter (age < 0) = count(*) as coherent from sales"""))
def funnel(spark, sf_dir):
    age = F.col("age")
    return sales(spark, sf_dir).agg(
        F.count("age").alias("seen"), F.count_if(age >= 0).alias("past"), F.count_if((age >= 0) & (F.col("price") > 0)).alias("priced"), F.count_if(age.between(0, 365)).alias("recent"),
        (F.count_if(age >= 0) + F.count_if(age < 0) == F.count("age")).alias("coherent"),
    )


@query("SRC-05", "SRC-06", sql="""
select event_id, in_order from (select event_id, ts, lag(ts) over (order by event_id // 1000, event_id) <= ts + interval 1 second or lag(ts) over (order by event_id // 1000, event_id) is null as in_order from events)""")
def ordered_scan(spark, sf_dir):
    """Whether a page order is the time order, within a second; the order is checked page by page, with the last row before."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.expr("event_id div 1000").alias("page"))
    inner = F.lag("ts").over(Window.partitionBy("page").orderBy("event_id"))
    last = e.groupBy((F.col("page") + 1).alias("page")).agg(F.max_by("ts", "event_id").alias("last"))
    rows = e.withColumn("inner", inner).join(last, "page", "left").withColumn("before", F.coalesce("inner", "last"))
    ok = F.col("before").isNull() | (F.col("before") <= F.col("ts") + F.expr("interval 1 second"))
    return rows.select("event_id", ok.alias("in_order"))


@query("FLT-03", sql=with_sales("""
select l.listing_id, (l.grader <> 'N' or l.grade in (2, 4, 6)) as in_scope, n >= 3 and best < 0.7::double * m as candidate from listings l left join (select part_id, count(*) as n, median(price) as m, min(price) as best from sales group by part_id) s on l.listing_id = s.part_id""", LISTINGS_SQL))
def scope_gates(spark, sf_dir):
    s = sales(spark, sf_dir).groupBy("part_id").agg(F.count("price").alias("n"), F.median("price").alias("m"), F.min("price").alias("best"))
    rows = listings(spark, sf_dir).join(s, F.col("listing_id") == F.col("part_id"), "left")
    return rows.select("listing_id", ((F.col("grader") != "N") | F.col("grade").isin(2, 4, 6)).alias("in_scope"), ((F.col("n") >= 3) & (F.col("best") < 0.7 * F.col("m"))).alias("candidate"))
