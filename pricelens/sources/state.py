"""State tables: versions in one folder, the newest complete one counts; keyed upserts and delivery."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from .tables import table


def upsert(state: DataFrame | None, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, by order; rows of changes win ties."""
    rows = changes.withColumn("_new", F.lit(1))
    if state is not None:
        rows = rows.unionByName(state.withColumn("_new", F.lit(0)))
    first = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc())
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_new")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pricelens-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to a shared folder and read back: what is read several times is made once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions in a folder, oldest first; a version without Spark's _SUCCESS file is not complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in (found or []))


def save(df: DataFrame, folder: str, version: int | None = None, form: str = "parquet") -> int:
    """Write the next version (or the given one, replacing a broken attempt) and return its number.

    Readers go by the _SUCCESS file that Spark writes last, so they never see half of one.
    """
    if version is None:
        version = max(versions(df.sparkSession, folder), default=0) + 1
    df.write.mode("overwrite").format(form).save(f"{folder}/version={version}")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None, form: str = "parquet", schema=None) -> DataFrame:
    """A version, or the newest complete one."""
    version = max(versions(spark, folder)) if version is None else version
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(f"{folder}/version={version}")


def deliver(stream: DataFrame, send, folder: str):
    """Send rows of a stream batch by batch with send(batch frame, batch id).

    A batch is sent at least once: after a failure between sending and its checkpoint it comes again with the
    same id, so send must write under that id (as a version, say) or ignore ids that it has seen.
    """
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", folder).trigger(availableNow=True).start()


@query("SNK-01", "SNK-04", sql="""
select o_orderstatus as status, count(*) as orders, round(sum(o_totalprice), 2) as total, max(o_orderdate)::date::varchar as newest from orders group by all""")
def written_report(spark, sf_dir):
    """A report, written as JSON under a version that appears whole or not at all, and read back."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"))
    report = o.agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))
    folder = shared_folder(spark)
    save(report, folder, form="json")
    return load(spark, folder, form="json", schema=report.schema)


@query("SNK-02", "SNK-07", sql="""
select c_custkey as id, case when c_custkey % 3 = 0 then 2 else 1 end as seen, c_acctbal + case when c_custkey % 3 = 0 then 100 else 0 end as balance from customer
union all select -s_suppkey - 1, 2, s_acctbal from supplier""")
def saved_state(spark, sf_dir):
    """Two versions of a state table: the second holds newer rows of every third key and keys of its own; the newest is loaded."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    old = c.select(F.col("c_custkey").alias("id"), F.lit(1).alias("seen"), F.col("c_acctbal").alias("balance"))
    changes = old.where("id % 3 = 0").select("id", F.lit(2).alias("seen"), (F.col("balance") + 100).alias("balance")).unionByName(s.select((-F.col("s_suppkey") - 1).alias("id"), F.lit(2).alias("seen"), F.col("s_acctbal").alias("balance")))
    folder = shared_folder(spark)
    save(old, folder)
    save(upsert(load(spark, folder), changes, "id", "seen"), folder)
    return load(spark, folder)
