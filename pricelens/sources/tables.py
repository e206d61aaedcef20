"""Market evidence from the driver's tables, as lazy frames.

sales: completed sales of identities (brand and type of a part) by grader, grade, source and seller.
listings: current asks, one for each part. All times are UTC; NOW is an argument of every age, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all shuffle partitions (by keys, if given): what costs time a row is then not bound to the few tasks in which a small table is read, nor put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def age_days(at: str, now: str = NOW):
    """Days between a timestamp column and now, with fractions; negative for the future."""
    return (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)) / F.lit(86400.0)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("identity"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_id"), F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("seller"),
        F.col("l_returnflag").alias("grader"), F.col("l_linenumber").cast("double").alias("grade"), F.col("l_linestatus").alias("source"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("sold_at"),
    )
    return lines.join(part, F.col("part_id") == F.col("p_partkey")).drop("p_partkey").withColumn("age", age_days("sold_at"))


SALES_SQL = """
sales as (
  select l_partkey as part_id, l_orderkey as order_id, l_suppkey as seller, p_brand || '|' || p_type as identity,
         l_returnflag as grader, l_linenumber::double as grade, l_linestatus as source,
         l_extendedprice / l_quantity as price, l_shipdate as sold_at,
         date_diff('second', l_shipdate, timestamp '2001-01-01') / 86400.0::double as age
  from lineitem join part on l_partkey = p_partkey)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ask for each part; the price scale is that of sales (retail price times size)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("listing_id"), F.concat_ws("|", "p_brand", "p_type").alias("identity"), F.col("p_name").alias("title"),
        (F.col("p_retailprice") * F.col("p_size") / 10).alias("price"), F.col("p_size").alias("size"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int")).alias("grader"),
        (F.pmod("p_partkey", F.lit(7)) + 1).cast("double").alias("grade"),
        F.pmod("p_partkey", F.lit(11)).alias("seller"),
        F.pmod(F.col("p_partkey") * 37, F.lit(60)).cast("int").alias("minutes_to_end"),
    )


LISTINGS_SQL = """
listings as (
  select p_partkey as listing_id, p_brand || '|' || p_type as identity, p_name as title, p_retailprice * p_size / 10 as price, p_size as size,
         ['A', 'N', 'R'][p_partkey % 3 + 1] as grader, (p_partkey % 7 + 1)::double as grade, p_partkey % 11 as seller,
         ((p_partkey * 37) % 60)::int as minutes_to_end
  from part)"""


def with_sales(rest: str, *more: str) -> str:
    return "with " + ", ".join([SALES_SQL, *more]) + rest
