"""Structural price signals: momentum, lags between markets and graders, breakouts, inversions, asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import LISTINGS_SQL, SALES_SQL, listings, sales, table, with_sales
from .robust import near


def window_median(lo: float, hi: float, extra=None):
    inside = (F.col("age") > lo) & (F.col("age") <= hi) if lo >= 0 else (F.col("age") <= hi)
    return F.median(F.when(inside if extra is None else inside & extra, F.col("price")))


def window_count(lo: float, hi: float, extra=None):
    inside = (F.col("age") > lo) & (F.col("age") <= hi) if lo >= 0 else (F.col("age") <= hi)
    return F.count_if(inside if extra is None else inside & extra)


@query("WIN-04", "AGG-43", sql=with_sales("""
select part_id, n, b, round((recent / base - 1) * 100, 4) as momentum from (select part_id, count(*) filter (age <= 90) as n, count(*) filter (age > 90 and age <= 365) as b,
  median(price) filter (age <= 90) as recent, median(price) filter (age > 90 and age <= 365) as base from sales where age >= 0 group by part_id) where n >= 2 and b >= 2"""))
def momentum(spark, sf_dir):
    g = sales(spark, sf_dir).where("age >= 0").groupBy("part_id").agg(window_count(-1, 90).alias("n"), window_count(90, 365).alias("b"), window_median(-1, 90).alias("recent"), window_median(90, 365).alias("base"))
    return g.where("n >= 2 and b >= 2").select("part_id", "n", "b", F.round((F.try_divide("recent", "base") - 1) * 100, 4).alias("momentum"))


@query("WIN-05", sql=with_sales("""
select identity, round((f - o) / o * 100, 4) as lag, (f - o) / o >= 0.15 as signal from (select identity, median(price) filter (source = 'F' and age <= 90) as f, median(price) filter (source = 'O' and age <= 90) as o from sales where age >= 0 group by identity) where f is not null and o is not null"""))
def market_lag(spark, sf_dir):
    g = sales(spark, sf_dir).where("age >= 0").groupBy("identity").agg(window_median(-1, 90, F.col("source") == "F").alias("f"), window_median(-1, 90, F.col("source") == "O").alias("o"))
    lag = F.try_divide(F.col("f") - F.col("o"), F.col("o"))
    return g.where("f is not null and o is not null").select("identity", F.round(lag * 100, 4).alias("lag"), (lag >= 0.15).alias("signal"))


@query("WIN-06", sql=with_sales("""
select identity, round(ratio, 6) as ratio, round(implied, 4) as implied, ratio between 0.35 and 1.5 and rise >= 0.15 and coalesce(t_new, 0) < 0.9 * implied as signal from (
  select *, t_old / r_old as ratio, r_new * t_old / r_old as implied, r_new / r_old - 1 as rise from (
    select identity, median(price) filter (grader = 'A' and age > 90) as t_old, median(price) filter (grader = 'A' and age <= 90) as t_new, median(price) filter (grader = 'N' and age > 90) as r_old, median(price) filter (grader = 'N' and age <= 90) as r_new
    from sales where age >= 0 group by identity)) where implied is not null"""))
def grader_lag(spark, sf_dir):
    a, n = F.col("grader") == "A", F.col("grader") == "N"
    g = sales(spark, sf_dir).where("age >= 0").groupBy("identity").agg(window_median(90, 1e9, a).alias("t_old"), window_median(-1, 90, a).alias("t_new"), window_median(90, 1e9, n).alias("r_old"), window_median(-1, 90, n).alias("r_new"))
    g = g.withColumns({"ratio": F.try_divide("t_old", "r_old"), "implied": F.try_divide(F.col("r_new") * F.col("t_old"), F.col("r_old")), "rise": F.try_divide("r_new", "r_old") - 1}).where("implied is not null")
    signal = F.col("ratio").between(0.35, 1.5) & (F.col("rise") >= 0.15) & (F.coalesce("t_new", F.lit(0.0)) < 0.9 * F.col("implied"))
    return g.select("identity", F.round("ratio", 6).alias("ratio"), F.round("implied", 4).alias("implied"), signal.alias("signal"))


@query("WIN-07", sql=with_sales("""
select part_id, n, prior, n >= 3 and prior <= 2 and coalesce(recent >= 1.1::double * base, false) as breakout from (select part_id, count(*) filter (age <= 145) as n, count(*) filter (age > 145 and age <= 290) as prior,
  median(price) filter (age <= 145) as recent, median(price) filter (age > 145) as base from sales where age >= 0 group by part_id)"""))
def liquidity_breakout(spark, sf_dir):
    g = sales(spark, sf_dir).where("age >= 0").groupBy("part_id").agg(window_count(-1, 145).alias("n"), window_count(145, 290).alias("prior"), window_median(-1, 145).alias("recent"), window_median(145, 1e9).alias("base"))
    return g.select("part_id", "n", "prior", ((F.col("n") >= 3) & (F.col("prior") <= 2) & F.coalesce(F.col("recent") >= 1.1 * F.col("base"), F.lit(False))).alias("breakout"))


@query("WIN-08", sql=with_sales("""
select identity, grader, grade, round(1e-9 + m, 4) as price, below_grade, round(1e-9 + (1 - m / below) * 100, 4) as inversion from (
  select *, last_value(grade) over w as below_grade, last_value(m) over w as below from (select identity, grader, grade, median(price) as m from sales group by all having count(*) >= 2) window w as (partition by identity, grader order by grade rows between 1 preceding and 1 preceding))
where m <= 0.9::double * below"""))
def grade_inversions(spark, sf_dir):
    t = sales(spark, sf_dir).groupBy("identity", "grader", "grade").agg(F.median("price").alias("m"), F.count("price").alias("k")).where("k >= 2")
    w = Window.partitionBy("identity", "grader").orderBy("grade")
    t = t.withColumns({"below_grade": F.lag("grade").over(w), "below": F.lag("m").over(w)}).where(F.col("m") <= 0.9 * F.col("below"))
    return t.select("identity", "grader", "grade", near("m", 4).alias("price"), "below_grade", near((1 - F.try_divide("m", "below")) * 100, 4).alias("inversion"))


@query("WIN-09", "WIN-11", "SRC-36", "NUM-23", sql="with " + LISTINGS_SQL.strip() + """
select identity, listing_id, round(price, 4) as price, round((next - price) / next * 100, 4) as gap from (
  select *, row_number() over w as k, lead(price) over w as next from listings window w as (partition by identity order by price, listing_id)) where k = 1 and next is not null""")
def lowest_asks(spark, sf_dir):
    w = Window.partitionBy("identity").orderBy("price", "listing_id")
    rows = listings(spark, sf_dir).withColumns({"k": F.row_number().over(w), "next": F.lead("price").over(w)}).where("k = 1 and next is not null")
    return rows.select("identity", "listing_id", F.round("price", 4).alias("price"), F.round(F.try_divide(F.col("next") - F.col("price"), F.col("next")) * 100, 4).alias("gap"))


def stale_seller_signals(fixed: DataFrame, moves: DataFrame, stale_days: float = 14.0, least: int = 2, momentum: float = 15.0, gap: float = 15.0) -> DataFrame:
    """Fixed asks whose seller has let several asks grow old while their market rose: listing_id, seller, listed, stale, age_days, momentum, gap.

    fixed has listing_id, seller, price and age_days (null: unknown, which is not old); moves has listing_id, recent (median of late
    sales) and momentum (percent over earlier ones). A seller counts with two asks or more of which `least` (2 or more)
    are old; an ask of it signals if it is old itself, its market gained enough and it lies far enough below late sales.
    """
    old = F.col("age_days") >= max(7.0, stale_days)
    portfolio = fixed.where("seller is not null").groupBy(F.col("seller").alias("_seller")).agg(F.count(F.lit(1)).alias("listed"), F.count_if(old).alias("stale"))
    portfolio = portfolio.where((F.col("listed") >= 2) & (F.col("stale") >= max(2, least)))
    below = F.greatest(F.lit(0.0), F.when((F.col("price") > 0) & (F.col("recent") > 0), (F.col("recent") - F.col("price")) / F.col("recent") * 100).otherwise(0.0))
    rows = fixed.where(old).join(moves, "listing_id").withColumn("gap", below).where((F.col("momentum") >= momentum) & (F.col("gap") >= gap))
    return rows.join(portfolio, F.col("seller") == F.col("_seller")).select("listing_id", "seller", "listed", "stale", "age_days", "momentum", "gap")


@query("WIN-10", sql="with " + ", ".join([SALES_SQL, LISTINGS_SQL]) + """
, m as (select part_id, recent, (recent / base - 1) * 100 as momentum from (select part_id, count(*) filter (age <= 90) as n, count(*) filter (age > 90 and age <= 365) as b,
    median(price) filter (age <= 90) as recent, median(price) filter (age > 90 and age <= 365) as base from sales where age >= 0 group by part_id) where n >= 2 and b >= 2 and recent > 0 and base > 0),
f as (select listing_id, listing_id % 97 as seller, price / size as price, case when listing_id % 13 > 0 then minutes_to_end::double end as age_days from listings where grader <> 'R'),
s as (select seller, count(*) as listed, count(*) filter (age_days >= 14) as stale from f group by seller)
select listing_id, f.seller, listed, stale, age_days, round(momentum, 4) as momentum, round(greatest(0, (recent - price) / recent * 100), 4) as gap from f join m on listing_id = part_id join s on s.seller = f.seller
where age_days >= 14 and listed >= 2 and stale >= 2 and momentum >= 15 and (recent - price) / recent * 100 >= 15""")
def stale_sellers(spark, sf_dir):
    g = sales(spark, sf_dir).where("age >= 0").groupBy("part_id").agg(window_count(-1, 90).alias("n"), window_count(90, 365).alias("b"), window_median(-1, 90).alias("recent"), window_median(90, 365).alias("base"))
    moves = g.where("n >= 2 and b >= 2 and recent > 0 and base > 0").select(F.col("part_id").alias("listing_id"), "recent", ((F.try_divide("recent", "base") - 1) * 100).alias("momentum"))
    fixed = listings(spark, sf_dir).where("grader <> 'R'").select("listing_id", F.pmod("listing_id", F.lit(97)).alias("seller"), (F.col("price") / F.col("size")).alias("price"), F.when(F.col("listing_id") % 13 > 0, F.col("minutes_to_end").cast("double")).alias("age_days"))
    rows = stale_seller_signals(fixed, moves)
    return rows.select("listing_id", "seller", "listed", "stale", "age_days", F.round("momentum", 4).alias("momentum"), F.round("gap", 4).alias("gap"))


def price_drop(before: Column, now: Column) -> Column:
    """Percent that a price fell by, 0 to 100; 0 for a rise, an unknown price or one that is not positive."""
    fell = (before > 0) & (now >= 0) & (now < before)
    return F.when(fell, F.least(F.lit(100.0), (before - now) / F.when(before > 0, before) * 100)).otherwise(0.0)


@query("WIN-12", sql="""
select event_id, user_id, round(case when prev > 0 and value >= 0 and value < prev then least(100, (prev - value) / prev * 100) else 0 end, 4) as drop_pct
from (select *, lag(value) over (partition by user_id order by ts, event_id) as prev from events)""")
def price_drops(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("prev", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.select("event_id", "user_id", F.round(price_drop(F.col("prev"), F.col("value")), 4).alias("drop_pct"))


@query("WIN-13", "TOP-03", sql="with " + LISTINGS_SQL.strip() + """
select listing_id, (case when price < 1000 then 30 else 0 end + case when grade >= 5 then 20 else 0 end + case when minutes_to_end <= 15 then 25 else 0 end + case when grader = 'N' then 10 else 0 end)::int as score from listings""")
def priority_scores(spark, sf_dir):
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("price") < 1000, 30) + points(F.col("grade") >= 5, 20) + points(F.col("minutes_to_end") <= 15, 25) + points(F.col("grader") == "N", 10)
    return listings(spark, sf_dir).select("listing_id", score.alias("score"))
