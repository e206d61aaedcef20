"""Incremental state: watermarks, keyset backfills, budgets, cooldowns; and their Structured Streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import table


def catch_up(feed: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """New rows of a feed (id, ts, final) beyond a watermark, oldest first, at most cap.

    state has one row: base (timestamp) and seen (id and ts of the rows taken at base or later). A row that is not
    final is put off, and its time then limits how far the watermark may go.
    """
    fresh = feed.join(state, F.lit(True)).where((F.col("ts") >= F.col("base")) & ~F.exists("seen", lambda s: s["id"] == F.col("id")))
    return fresh.where("final").drop("base", "seen").orderBy("ts", "id").limit(cap)


def next_state(taken: DataFrame, feed: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a batch is stored. The base moves to its last time, but not past a row that was put off and never
    back; an empty batch leaves it where it was. What was taken at the new base or later stays known."""
    held = feed.join(state, F.lit(True)).where((F.col("ts") >= F.col("base")) & ~F.col("final")).agg(F.min("ts").alias("held"))
    batch = taken.agg(F.max("ts").alias("last"), F.collect_list(F.struct("id", "ts")).alias("more"))  # at most cap rows
    rows = state.join(batch, F.lit(True)).join(held, F.lit(True))
    base = F.when(F.col("last").isNull(), F.col("base")).otherwise(F.greatest("base", F.least("last", "held")))
    return rows.withColumn("base", base).select("base", F.filter(F.concat("seen", "more"), lambda s: s["ts"] >= F.col("base")).alias("seen"))


def start_at(spark, feed: DataFrame, at: str) -> DataFrame:
    """A state that has taken nothing yet."""
    kind = dict(feed.dtypes)["ts"]
    return spark.range(1).select(F.lit(at).cast(kind).alias("base"), F.expr(f"cast(array() as array<struct<id: bigint, ts: {kind}>>)").alias("seen"))


FEED_SQL = "feed as (select event_id as id, ts, event_type <> 'error' as final from events)"


def feed_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", (F.col("event_type") != "error").alias("final"))


@query("STM-01", sql=f"with {FEED_SQL} select id, ts from feed where final and ts > timestamp '2024-01-10' order by ts, id limit 400")
def watermark_batch(spark, sf_dir):
    feed = feed_of(spark, sf_dir)
    return catch_up(feed, start_at(spark, feed, "2024-01-10"), 400).select("id", "ts")


@query(sql=f"""
with {FEED_SQL} select id, ts, ((k - 1) // 100 + 1)::int as round from (select *, row_number() over (order by ts, id) as k from feed where final and ts >= timestamp '2024-01-10') where k <= 300""")
def watermark_rounds(spark, sf_dir):
    """Three rounds of 100: rows that are not final hold the watermark, and no row is taken twice for it."""
    feed = feed_of(spark, sf_dir)
    state, out = start_at(spark, feed, "2024-01-10"), None
    for k in range(1, 4):
        taken = catch_up(feed, state, 100)
        rows = taken.select("id", "ts", F.lit(k).alias("round"))
        out = rows if out is None else out.unionByName(rows)
        state = next_state(taken, feed, state)
    return out


@query("STM-03", "STM-04", sql=f"with {FEED_SQL} select id, ts from feed where ts < timestamp '2024-01-20' or (ts = timestamp '2024-01-20' and id < 5000) order by ts desc, id desc limit 300")
def keyset_backfill(spark, sf_dir):
    """The next page backwards from a (time, id) cursor."""
    feed = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    at = F.lit("2024-01-20").cast(dict(feed.dtypes)["ts"])
    return feed.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") < 5000))).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(300)


@query(sql="select user_id, event_type, count(*) as n, max(value) as best from events group by all")
def grouped_once(spark, sf_dir):
    """One evaluation for each key, joined back by whoever needs it."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("event_id").alias("n"), F.max("value").alias("best"))


def streamed(spark, source: DataFrame, folder: str, transform) -> DataFrame:
    """Run a streaming twin over a folder of Parquet to its end and return what it put out."""
    name = f"stream_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    run = transform(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def stream_first_seen(events: DataFrame) -> DataFrame:
    """First event of each kind of a user, by event time, with late rows let in for two hours."""
    return events.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["user_id", "event_type"])


def stream_counts(events: DataFrame) -> DataFrame:
    """Events by hour and kind, put out when the hour is past."""
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("event_id").alias("n"))
