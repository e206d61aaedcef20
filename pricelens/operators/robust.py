"""Robust statistics of prices: quantiles, four outlier rules, weighted and trimmed centres.

The rules differ on purpose and are kept apart. Each works on a frame with group columns and a price column
and is a two-pass aggregate (statistics of the group by grouped aggregation, then a filter), or a window
for weighted statistics, whose running sums need an order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import sales, with_sales


def near(x, places: int) -> Column:
    """Rounded a hair upwards, so that a tie in decimals is no tie in binary."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, places)


def linear_recency(age: Column) -> Column:
    """Weight by age in days: 1 to 30, then lines through 0.70 at 90, 0.40 at 180, 0.20 at 365, then 73 / age, at least 0.10; 0.45 without a date."""
    line = lambda x0, x1, y0, y1: F.lit(y0) + (age - x0) / (x1 - x0) * (y1 - y0)
    a = F.greatest(age, F.lit(0.0))
    return (
        F.when(age.isNull(), 0.45).when(a <= 30, 1.0).when(a <= 90, line(30, 90, 1.0, 0.7)).when(a <= 180, line(90, 180, 0.7, 0.4))
        .when(a <= 365, line(180, 365, 0.4, 0.2)).otherwise(F.greatest(F.lit(0.10), F.lit(0.20) * 365 / age))
    )


LINEAR_RECENCY_SQL = """case when age is null then 0.45::double when greatest(age, 0) <= 30 then 1
  when age <= 90 then 1.0::double + (age - 30) / 60 * (0.7::double - 1.0::double)
  when age <= 180 then 0.7::double + (age - 90) / 90 * (0.4::double - 0.7::double)
  when age <= 365 then 0.4::double + (age - 180) / 185 * (0.2::double - 0.4::double)
  else greatest(0.10::double, 0.20::double * 365 / age) end"""


def step_recency(age: Column) -> Column:
    """Weight by age: 1, 0.85, 0.70, 0.50 up to 30, 90, 180, 365 days, then 0.9 less for each started 90 days, at least 0.10; 0.25 without a date."""
    tail = F.greatest(F.lit(0.10), F.lit(0.50) * F.pow(F.lit(0.9), F.greatest(F.ceil((age - 365) / 90.0), F.lit(1)).cast("double")))
    return F.when(age.isNull(), 0.25).when(age <= 30, 1.0).when(age <= 90, 0.85).when(age <= 180, 0.70).when(age <= 365, 0.50).otherwise(tail)


STEP_RECENCY_SQL = """case when age is null then 0.25::double when age <= 30 then 1 when age <= 90 then 0.85 when age <= 180 then 0.70
  when age <= 365 then 0.50 else greatest(0.10::double, 0.50::double * pow(0.9::double, greatest(ceil((age - 365) / 90.0), 1))) end"""


def quartiles(df: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    q = F.percentile(price, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(price).alias("n"), q.alias("_q"))
    return out.select(*by, "n", *[F.col("_q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))])


def joined(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """df with the statistics of its groups; null keys match null keys."""
    s = stats.withColumnsRenamed({c: f"_{c}" for c in by})
    return df.join(s, reduce(lambda x, y: x & y, (df[c].eqNullSafe(s[f"_{c}"]) for c in by))).drop(*[f"_{c}" for c in by])


def keep_mad(df: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """Rule A. Positive prices; from 4 on those within 3.5 robust deviations of the median; without deviations the
    1.5 interquartile fences, or half to twice the median. Groups that would keep under 3 keep all."""
    rows = df.where(F.col(price) > 0)
    rows = joined(rows, quartiles(rows, by, price), by)
    rows = joined(rows, rows.groupBy(*by).agg(F.percentile(F.abs(F.col(price) - F.col("p50")), 0.5).alias("mad")), by)
    x, iqr = F.col(price), F.col("p75") - F.col("p25")
    fence = F.when(iqr > 0, x.between(F.col("p25") - 1.5 * iqr, F.col("p75") + 1.5 * iqr)).otherwise(x.between(0.5 * F.col("p50"), 2 * F.col("p50")))
    fine = F.when(F.col("n") < 4, True).when(F.col("mad") > 0, 0.6745 * F.abs(x - F.col("p50")) / F.col("mad") <= 3.5).otherwise(fence)
    rows = rows.withColumn("_fine", fine)
    rows = joined(rows, rows.groupBy(*by).agg(F.count_if("_fine").alias("_left")), by)
    return rows.where(F.col("_fine") | (F.col("_left") < 3)).drop("p25", "p50", "p75", "n", "mad", "_fine", "_left")


KEEP_MAD_SQL = """
q_ as (select {by}, count(*) as n, quantile_cont(price, 0.25) as p25, quantile_cont(price, 0.5) as p50, quantile_cont(price, 0.75) as p75
      from {rows} where price > 0 group by {by}),
m_ as (select {by}, mad(price) as mad from {rows} where price > 0 group by {by}),
f_ as (select r.*, case when n < 4 then true when mad > 0 then 0.6745::double * abs(price - p50) / mad <= 3.5
          when p75 > p25 then price between p25 - 1.5 * (p75 - p25) and p75 + 1.5 * (p75 - p25)
          else price between 0.5 * p50 and 2 * p50 end as fine
      from {rows} r join q_ using ({by}) join m_ using ({by}) where price > 0),
kept as (select * exclude (fine, left_) from (select *, count(*) filter (fine) over (partition by {by}) as left_ from f_) where fine or left_ < 3)"""


def keep_mad_sql(rows: str, by: str) -> str:
    return KEEP_MAD_SQL.format(rows=rows, by=by)


def weighted_quantiles(df: DataFrame, by: list[str], qs: dict[str, float], price: str = "price", weight: str = "weight") -> DataFrame:
    """Quantiles at mid-point positions (sum up to a row less half its weight, over the total), linear between rows."""
    order = Window.partitionBy(*by).orderBy(price, weight)
    rows = df.withColumn("_w", F.greatest(F.col(weight), F.lit(0.001)))
    rows = rows.withColumn("_up", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_at", (F.col("_up") - F.col("_w") / 2) / F.sum("_w").over(Window.partitionBy(*by)))
    rows = rows.withColumns({"_next": F.lead("_at").over(order), "_next_price": F.lead(price).over(order)})

    def at(q: float) -> Column:
        inside = (F.col("_at") <= q) & (F.col("_next") > q)
        between = F.col(price) + (q - F.col("_at")) / (F.col("_next") - F.col("_at")) * (F.col("_next_price") - F.col(price))
        return F.coalesce(F.max(F.when(inside, between)), F.when(F.min("_at") > q, F.min(price)).otherwise(F.max(price)))

    return rows.groupBy(*by).agg(*[at(q).alias(name) for name, q in qs.items()])


def weighted_quantiles_sql(rows: str, by: str, qs: dict[str, float], name: str = "wq") -> str:
    cols = ", ".join(
        f"coalesce(max(case when at_ <= {q} and next_ > {q} then price + ({q} - at_) / (next_ - at_) * (next_price - price) end), case when min(at_) > {q} then min(price) else max(price) end) as {n}"
        for n, q in qs.items()
    )
    return f"""
{name}_u as (select *, greatest(weight, 0.001::double) as w_ from {rows}),
{name}_c as (select *, (sum(w_) over (partition by {by} order by price, weight rows unbounded preceding) - w_ / 2) / sum(w_) over (partition by {by}) as at_ from {name}_u),
{name}_n as (select *, lead(at_) over (partition by {by} order by price, weight) as next_, lead(price) over (partition by {by} order by price, weight) as next_price from {name}_c),
{name} as (select {by}, {cols} from {name}_n group by {by})"""


@query("AGG-01", "AGG-14", sql=with_sales("""
select identity, count(*) as n, round(quantile_cont(price, 0.25), 6) as p25, round(quantile_cont(price, 0.5), 6) as p50, round(quantile_cont(price, 0.75), 6) as p75
from sales group by identity"""))
def linear_percentiles(spark, sf_dir):
    q = quartiles(sales(spark, sf_dir), ["identity"])
    return q.select("identity", "n", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")])


@query("AGG-02", "UDF-11", "DAT-03", sql=with_sales("\nselect identity, round(low, 4) as low, round(central, 4) as central, round(high, 4) as high from wq", f"w as (select identity, price, {LINEAR_RECENCY_SQL} as weight from sales where age >= 0)", weighted_quantiles_sql("w", "identity", {"low": 0.25, "central": 0.5, "high": 0.75})))
def weighted_price_quantiles(spark, sf_dir):
    rows = sales(spark, sf_dir).where("age >= 0").select("identity", "price", linear_recency(F.col("age")).alias("weight"))
    out = weighted_quantiles(rows, ["identity"], {"low": 0.25, "central": 0.5, "high": 0.75})
    return out.select("identity", *[F.round(c, 4).alias(c) for c in ("low", "central", "high")])


@query("AGG-03", sql=with_sales("\nselect identity, grader, count(*) as kept, round(max(price), 6) as highest, round(min(price), 6) as lowest from kept group by all", keep_mad_sql("sales", "identity, grader")))
def outliers_by_deviation(spark, sf_dir):
    kept = keep_mad(sales(spark, sf_dir), ["identity", "grader"])
    return kept.groupBy("identity", "grader").agg(F.count("price").alias("kept"), F.round(F.max("price"), 6).alias("highest"), F.round(F.min("price"), 6).alias("lowest"))


def flag_agreeing(df: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """Rule B: from 5 rows on, flagged are prices that both tests reject - over 3.5 robust deviations, outside three
    interquartile ranges - or the one test that can be made. If all would be flagged, none is."""
    rows = joined(df, quartiles(df, by, price), by)
    rows = joined(rows, rows.groupBy(*by).agg(F.percentile(F.abs(F.col(price) - F.col("p50")), 0.5).alias("mad")), by)
    x, iqr = F.col(price), F.col("p75") - F.col("p25")
    far = F.when(F.col("mad") > 0, 0.6745 * F.abs(x - F.col("p50")) / F.col("mad") > 3.5)
    out = F.when(iqr > 0, (x < F.col("p25") - 3 * iqr) | (x > F.col("p75") + 3 * iqr))
    both = F.when(far.isNotNull() & out.isNotNull(), far & out).otherwise(F.coalesce(far, out, F.lit(False)))
    rows = rows.withColumn("outlier", (F.col("n") >= 5) & both)
    every = F.min("outlier").over(Window.partitionBy(*by))
    return rows.withColumn("outlier", F.col("outlier") & ~every).drop("p25", "p50", "p75", "n", "mad")


@query("AGG-18", sql=with_sales("""
select part_id, count(*) as n, count(*) filter (o and not every) as outliers from (select *, min(o::int) over (partition by part_id) = 1 as every from t) group by part_id""", """
q as (select part_id, count(*) as n, quantile_cont(price, 0.25) as p25, quantile_cont(price, 0.5) as p50, quantile_cont(price, 0.75) as p75, mad(price) as mad from sales group by part_id),
t as (select part_id, n >= 5 and case when mad > 0 and p75 > p25 then 0.6745::double * abs(price - p50) / mad > 3.5 and (price < p25 - 3 * (p75 - p25) or price > p75 + 3 * (p75 - p25))
        when mad > 0 then 0.6745::double * abs(price - p50) / mad > 3.5 when p75 > p25 then price < p25 - 3 * (p75 - p25) or price > p75 + 3 * (p75 - p25) else false end as o
      from sales join q using (part_id))"""))
def outliers_by_agreement(spark, sf_dir):
    return flag_agreeing(sales(spark, sf_dir), ["part_id"]).groupBy("part_id").agg(F.count("price").alias("n"), F.count_if("outlier").alias("outliers"))


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100.0


def middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return F.when(n > 0, (F.element_at(values, ((n + 1) / 2).cast("int")) + F.element_at(values, (n / 2).cast("int") + 1)) / 2.0)


def hinge_statistics(prices: Column) -> dict[str, Column]:
    """Rule C on an array of prices in cents: hinges (medians of the halves without a middle value; ends under 4),
    1.5 interquartile fences (0.4 of the median where that is 0), dispersion over all prices."""
    x = F.array_sort(prices)
    n = F.size(x)
    half = (n / 2).cast("int")
    lower = F.when(n >= 4, middle(F.slice(x, F.lit(1), half))).otherwise(F.array_min(x))
    upper = F.when(n >= 4, middle(F.slice(x, n - half + 1, half))).otherwise(F.array_max(x))
    iqr = upper - lower
    reach = F.when(iqr > 0, 1.5 * iqr).otherwise(0.4 * middle(x))
    return {
        "median": middle(x), "lower": lower, "upper": upper, "low_fence": F.greatest(lower - reach, F.lit(0.01)), "high_fence": upper + reach,
        "dispersion": (F.array_max(x) - F.array_min(x)) / middle(x),
    }


def running(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, v, c: how many) with up (rows of the group up to v) and n (all of its rows); no group becomes one value."""
    w = Window.partitionBy(*by)
    up = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"up": up, "n": F.sum("c").over(w)})


def counted(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    return running(rows.select(*by, value.alias("v")).groupBy(*by, "v").agg(F.count("v").alias("c")), by)


def narrowed(rows: DataFrame, by: list[str], inside: Column) -> DataFrame:
    """running rows again, those outside counted as none."""
    left = rows.select(*by, F.when(inside, F.col("v")).alias("k"), "v", F.when(inside, F.col("c")).otherwise(0).alias("c"))
    return running(left, by).drop("v").withColumnRenamed("k", "v")


def middle_at(skip: str, n: str) -> Column:
    """Aggregate over running rows: the median of the n places after the first `skip`."""
    place = lambda k: F.min(F.when(F.col("up") >= F.expr(k), F.col("v")))
    return (place(f"{skip} + ({n} + 1) div 2") + place(f"{skip} + {n} div 2 + 1")) / 2.0


def hinge_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """What hinge_statistics gives, for each group of running rows."""
    ends = {"median": middle_at("0", "n"), "least": F.min("v"), "most": F.max("v"), "low": middle_at("0", "(n div 2)"), "high": middle_at("n - n div 2", "(n div 2)")}
    g = rows.groupBy(*by).agg(F.max("n").alias("n"), *[c.alias(k) for k, c in ends.items()])
    g = g.withColumns({"lower": F.when(F.col("n") >= 4, F.col("low")).otherwise(F.col("least")), "upper": F.when(F.col("n") >= 4, F.col("high")).otherwise(F.col("most"))})
    iqr = F.col("upper") - F.col("lower")
    g = g.withColumn("reach", F.when(iqr > 0, 1.5 * iqr).otherwise(0.4 * F.col("median")))
    return g.select(
        *by, "n", "median", "lower", "upper", F.greatest(F.col("lower") - F.col("reach"), F.lit(0.01)).alias("low_fence"), (F.col("upper") + F.col("reach")).alias("high_fence"),
        F.try_divide(F.col("most") - F.col("least"), F.col("median")).alias("dispersion"),
    )


@query("AGG-26", sql=with_sales("""
select part_id, grader, n, median, lo as lower, hi as upper, round(greatest(lo - reach, 0.01), 6) as low_fence, round(hi + reach, 6) as high_fence, round((x[-1] - x[1]) / median, 6) as dispersion
from (select *, case when hi - lo > 0 then 1.5 * (hi - lo) else 0.4::double * median end as reach from h)""", """
a as (select part_id, grader, count(*) as n, list_sort(list(floor(price * 100 + 0.5) / 100.0::double)) as x from sales group by all),
h as (select *, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 as median,
        case when n >= 4 then (x[(n // 2 + 1) // 2] + x[(n // 2) // 2 + 1]) / 2 else x[1] end as lo,
        case when n >= 4 then (x[n - n // 2 + (n // 2 + 1) // 2] + x[n - n // 2 + (n // 2) // 2 + 1]) / 2 else x[-1] end as hi from a)"""))
def hinge_fences(spark, sf_dir):
    s = hinge_rows(counted(sales(spark, sf_dir), ["part_id", "grader"], cents(F.col("price"))), ["part_id", "grader"])
    return s.select("part_id", "grader", "n", "median", "lower", "upper", *[F.round(c, 6).alias(c) for c in ("low_fence", "high_fence", "dispersion")])


def reference_value(prices: Column) -> Column:
    """Rule D: one price as it is, two by their mean, more by the median of those within 0.4 to 2 times the upper median."""
    x = F.array_sort(prices)
    pivot = F.element_at(x, (F.size(x) / 2).cast("int") + 1)
    return F.when(F.size(x) <= 2, middle(x)).otherwise(middle(F.filter(x, lambda p: p.between(0.4 * pivot, 2.0 * pivot))))


@query("AGG-34", sql=with_sales("""
select part_id, source, round(case when n <= 2 then (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 else (k[(len(k) + 1) // 2] + k[len(k) // 2 + 1]) / 2 end, 6) as reference
from (select *, list_filter(x, lambda p: p >= 0.4::double * x[n // 2 + 1] and p <= 2.0::double * x[n // 2 + 1]) as k from a)""", "a as (select part_id, source, count(*) as n, list_sort(list(price)) as x from sales group by all)"))
def upper_median_reference(spark, sf_dir):
    by = ["part_id", "source"]
    rows = counted(sales(spark, sf_dir), by, F.col("price"))
    pivot = F.min(F.when(F.col("up") >= F.expr("n div 2 + 1"), F.col("v"))).over(Window.partitionBy(*by))
    rows = rows.withColumn("pivot", pivot)
    kept = narrowed(rows, by, (F.col("n") <= 2) | F.col("v").between(0.4 * F.col("pivot"), 2.0 * F.col("pivot")))
    return kept.groupBy(*by).agg(F.round(middle_at("0", "n"), 6).alias("reference"))


def lower_weighted_median(df: DataFrame, by: list[str], price: str = "price", weight: str = "weight") -> DataFrame:
    """First price whose running weight reaches half of the total."""
    order = Window.partitionBy(*by).orderBy(price, weight).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"_up": F.sum(weight).over(order), "_all": F.sum(weight).over(Window.partitionBy(*by))})
    return rows.groupBy(*by).agg(F.min(F.when(F.col("_up") >= F.col("_all") / 2, F.col(price))).alias("median"))


@query("AGG-15", "DAT-04", "UDF-03", sql=with_sales("""
select identity, round(min(case when up >= total / 2 then price end), 6) as median from (
  select identity, price, sum(weight) over (partition by identity order by price, weight rows unbounded preceding) as up, sum(weight) over (partition by identity) as total from w) group by identity""", f"w as (select identity, price, {STEP_RECENCY_SQL} as weight from sales where age >= 0)"))
def lower_weighted_medians(spark, sf_dir):
    rows = sales(spark, sf_dir).where("age >= 0").select("identity", "price", step_recency(F.col("age")).alias("weight"))
    return lower_weighted_median(rows, ["identity"]).select("identity", F.round("median", 6).alias("median"))


@query("AGG-16", sql=with_sales("""
select part_id, round(avg(price), 4) as trimmed from (
  select part_id, price, row_number() over (partition by part_id order by price) as k, count(*) over (partition by part_id) as n from sales)
where n < 10 or (k > n // 10 and k <= n - n // 10) group by part_id"""))
def trimmed_means(spark, sf_dir):
    w = Window.partitionBy("part_id")
    rows = sales(spark, sf_dir).select("part_id", "price", F.row_number().over(w.orderBy("price")).alias("k"), F.count("price").over(w).alias("n"))
    cut = F.expr("n div 10")
    kept = rows.where((F.col("n") < 10) | ((F.col("k") > cut) & (F.col("k") <= F.col("n") - cut)))
    return kept.groupBy("part_id").agg(F.round(F.avg("price"), 4).alias("trimmed"))


@query("AGG-04", "AGG-05", "AGG-06", "WIN-15", sql=with_sales("""
select q.*, s.consistent from q left join (select part_id, case when count(*) >= 2 then max(m) / min(m) <= 1.35 end as consistent from (select part_id, source, median(price) as m from sales where age >= 0 group by all having count(*) >= 2) group by part_id) s using (part_id)""", """
q as (select part_id, case when count(*) < 2 then 'not measurable' when (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) <= 0.15 then 'low'
               when (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) <= 0.35 then 'medium' else 'high' end as dispersion,
             case when count(*) >= 5 and count(*) filter (age <= 90) >= 3 then 'high'
               when (count(*) >= 3 and count(*) filter (age <= 180) >= 2) or (count(*) >= 5 and count(*) filter (age <= 90) >= 1) then 'medium' else 'low' end as liquidity
      from sales where age >= 0 group by part_id)"""))
def quality_labels(spark, sf_dir):
    rows = sales(spark, sf_dir).where("age >= 0")
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy("part_id").agg(F.count("price").alias("n"), q.alias("q"), F.count_if(F.col("age") <= 90).alias("n90"), F.count_if(F.col("age") <= 180).alias("n180"))
    medians = rows.groupBy("part_id", "source").agg(F.median("price").alias("m"), F.count("price").alias("k")).where("k >= 2")
    sources = medians.groupBy("part_id").agg(F.when(F.count("m") >= 2, F.max("m") / F.min("m") <= 1.35).alias("consistent"))
    return g.join(sources, "part_id", "left").select("part_id", dispersion_label(F.col("n"), F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1])).alias("dispersion"), liquidity_label(F.col("n"), F.col("n90"), F.col("n180")).alias("liquidity"), "consistent")


def dispersion_label(n: Column, spread: Column) -> Column:
    return F.when(n < 2, "not measurable").when(spread <= 0.15, "low").when(spread <= 0.35, "medium").otherwise("high")


def liquidity_label(n: Column, recent90: Column, recent180: Column) -> Column:
    medium = ((n >= 3) & (recent180 >= 2)) | ((n >= 5) & (recent90 >= 1))
    return F.when((n >= 5) & (recent90 >= 3), "high").when(medium, "medium").otherwise("low")


@query("AGG-25", sql="""
select o_orderpriority as segment, count(*) as n, round(median(o_totalprice), 4) as median, round(min(o_totalprice) filter (o_totalprice >= lo), 4) as robust_min, round(any_value((q3 - q1) / m), 6) as dispersion
from orders join (select o_orderpriority, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3, median(o_totalprice) as m, q1 - 1.5 * (q3 - q1) as lo from orders group by all) using (o_orderpriority)
group by o_orderpriority""")
def asking_statistics(spark, sf_dir):
    asks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("segment"), F.col("o_totalprice").alias("price"))
    rows = joined(asks, quartiles(asks, ["segment"]), ["segment"])
    low = F.col("p25") - 1.5 * (F.col("p75") - F.col("p25"))
    return rows.groupBy("segment").agg(F.count("price").alias("n"), F.round(F.first("p50"), 4).alias("median"), F.round(F.min(F.when(F.col("price") >= low, F.col("price"))), 4).alias("robust_min"), F.round(F.first((F.col("p75") - F.col("p25")) / F.col("p50")), 6).alias("dispersion"))


@query("AGG-09", sql=with_sales("\nselect part_id, len(list_sort(list(price))) as n, round(list_sort(list(price))[1], 6) as first, round(list_sort(list(price))[-1], 6) as last from kept group by part_id", keep_mad_sql("sales", "part_id")))
def kept_prices(spark, sf_dir):
    g = keep_mad(sales(spark, sf_dir), ["part_id"]).groupBy("part_id")
    return g.agg(F.count("price").alias("n"), F.round(F.min("price"), 6).alias("first"), F.round(F.max("price"), 6).alias("last"))
