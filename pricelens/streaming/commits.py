"""State that moves only after what it stands for has arrived.

A batch is fetched against the committed state and proposes new versions of one or more state tables. The proposal is
written but nobody sees it. When the rows of the batch have been delivered, a manifest that names all the new
versions is committed: it becomes visible as a whole, by the _SUCCESS file of one small write. A batch that fails before that
leaves every state as it was and is fetched again; a batch that was committed before changes nothing. One
committer at a time writes to a root.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.state import load, save, shared_folder, versions
from ..sources.tables import table
from .incremental import FEED_SQL, catch_up, feed_of, next_state, start_at

MANIFEST = "batch string, tables map<string,int>"


class CommitError(RuntimeError):
    """A commit without a whole proposal."""


def _path(root: str, name: str, batch: str | None = None) -> str:
    for part in (name, batch):
        if part is not None and not re.fullmatch(r"[A-Za-z0-9_.-]+", part):
            raise ValueError(f"not a name: {part!r}")
    return f"{root}/{name}" if batch is None else f"{root}/{name}/{batch}"


def committed(spark: SparkSession, root: str) -> dict[str, int]:
    """The version of each state table that counts."""
    found = versions(spark, f"{root}/manifest")
    return dict(load(spark, f"{root}/manifest", max(found), "json", MANIFEST).first()["tables"]) if found else {}


def load_committed(spark: SparkSession, root: str, name: str, otherwise: DataFrame | None = None) -> DataFrame:
    """A state table as it was committed last; `otherwise` before the first commit."""
    version = committed(spark, root).get(name)
    if version is None:
        if otherwise is None:
            raise CommitError(f"{name} was never committed")
        return otherwise
    return load(spark, _path(root, name), version)


def propose(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Write new versions of state tables for a batch, without committing them; a later proposal of the batch takes its place."""
    made = {name: save(df, _path(root, name)) for name, df in tables.items()}
    save(spark.createDataFrame([(batch, made)], MANIFEST).coalesce(1), _path(root, "proposals", batch), form="json")


def is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    if not versions(spark, f"{root}/manifest"):
        return False
    return not spark.read.schema(MANIFEST).json(f"{root}/manifest/version=*").where(F.col("batch") == batch).isEmpty()


def commit(spark: SparkSession, root: str, batch: str) -> bool:
    """Make a batch's proposal count, all its tables at once; False, and no change, if the batch was committed before."""
    if is_committed(spark, root, batch):
        return False
    path = _path(root, "proposals", batch)
    if not versions(spark, path):
        raise CommitError(f"batch {batch} has no whole proposal")
    proposed = load(spark, path, form="json", schema=MANIFEST).first()
    whole = committed(spark, root) | dict(proposed["tables"])
    save(spark.createDataFrame([(batch, whole)], MANIFEST).coalesce(1), f"{root}/manifest", form="json")
    return True


def run_batch(spark: SparkSession, root: str, batch: str, fetch: Callable[[], tuple[DataFrame, dict[str, DataFrame]]], deliver: Callable[[DataFrame], None]) -> bool:
    """Fetch, propose, deliver, commit; False if the batch was committed before. What deliver raises leaves the state alone.

    deliver may see the rows of a batch again after a failure, so it must write under the batch's name.
    """
    if is_committed(spark, root, batch):
        return False
    rows, tables = fetch()
    propose(spark, root, batch, tables)
    deliver(rows)
    return commit(spark, root, batch)


def delivered_to(root: str, number: int, fail: bool = False) -> Callable[[DataFrame], None]:
    """Delivery of a batch into its own version of <root>/out; fail breaks off after the rows are written and before the commit."""

    def deliver(rows: DataFrame) -> None:
        save(rows, f"{root}/out", number)
        if fail:
            raise ConnectionError("the other side hung up")

    return deliver


def with_retries(spark: SparkSession, root: str, numbers: list[int], fetch, failing: set[int]) -> DataFrame:
    """Run batches in order, those in `failing` once in vain before they succeed; what was delivered, with round."""
    for n in numbers:
        for fail in (True, False) if n in failing else (False,):
            try:
                run_batch(spark, root, f"batch-{n}", fetch, delivered_to(root, n, fail))
            except ConnectionError:
                pass
    return spark.read.parquet(f"{root}/out").withColumnRenamed("version", "round")


@query("STM-02", sql=f"""
with {FEED_SQL} select id, ts, ((k - 1) // 100 + 1)::int as round from (select *, row_number() over (order by ts, id) as k from feed where final and ts >= timestamp '2024-01-12') where k <= 300""")
def committed_rounds(spark, sf_dir):
    """Three rounds of 100 whose watermark is committed after delivery; the second is delivered, fails before its commit, and comes again as it was."""
    feed, root = feed_of(spark, sf_dir), shared_folder(spark)

    def fetch():
        state = load_committed(spark, root, "watermark", start_at(spark, feed, "2024-01-12"))
        taken = catch_up(feed, state, 100)
        return taken.select("id", "ts"), {"watermark": next_state(taken, feed, state)}

    return with_retries(spark, root, [1, 2, 3], fetch, {2})


def backfill(feed: DataFrame, cursor: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The page of at most cap final rows before a (ts, id) cursor, newest first, and the cursor after it (with done once a page is short)."""
    at = cursor.select(F.col("ts").alias("_ts"), F.col("id").alias("_id"), "done")  # one row
    older = feed.where("final").join(at, (F.col("ts") < F.col("_ts")) | ((F.col("ts") == F.col("_ts")) & (F.col("id") < F.col("_id")))).where("not done")
    page = older.select("id", "ts").orderBy(F.col("ts").desc(), F.col("id").desc()).limit(cap)
    last = page.agg(F.min(F.struct("ts", "id")).alias("l"), F.count("id").alias("n"))
    moved = cursor.join(last, F.lit(True)).select(F.coalesce("l.ts", "ts").alias("ts"), F.coalesce("l.id", "id").alias("id"), (F.col("done") | (F.col("n") < cap)).alias("done"))
    return page, moved


@query("STM-05", sql=f"""
with {FEED_SQL} select id, ts, ((k - 1) // 150 + 1)::int as round from (select *, row_number() over (order by ts desc, id desc) as k from feed where final and ts < timestamp '2024-01-05') where k <= 450""")
def committed_backfill(spark, sf_dir):
    """Pages of 150 backwards in time, the cursor committed after each; the first comes twice after a failure, the second is asked for again when it is committed."""
    feed, root = feed_of(spark, sf_dir), shared_folder(spark)
    start = feed.limit(0).select("ts", "id").unionByName(spark.range(1).select(F.lit("2024-01-05").cast(dict(feed.dtypes)["ts"]).alias("ts"), F.lit(-1).cast("long").alias("id"))).select("ts", "id", F.lit(False).alias("done"))

    def fetch():
        page, cursor = backfill(feed, load_committed(spark, root, "cursor", start), 150)
        return page, {"cursor": cursor}

    return with_retries(spark, root, [1, 2, 2, 3], fetch, {1})


#: Values of the targeted search, in the order in which it goes through them.
TARGETS = ["view", "click", "purchase", "error", "signup"]


def hybrid_batch(items: DataFrame, rotation: DataFrame, targets: DataFrame, pages: int, recent: int, target: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The newest items, the next pages of the rotation (from the first again after the last) and the newest of the segment that was
    searched least often, each item once by the first of these; and both states after it.

    items have id, ts, page (from 0) and segment; rotation has one row: next_page and total_pages; targets have a row for each segment: runs and records.
    """
    by_time = [F.col("ts").desc(), F.col("id").desc()]
    place = F.pmod(F.col("page") - F.col("next_page"), F.col("total_pages"))
    seen = items.join(rotation, F.lit(True)).where(place < pages).select("id", F.lit(2).alias("_by"))
    chosen = targets.orderBy("runs", "place").limit(1).select(F.col("segment").alias("_segment"))
    found = items.join(chosen, F.col("segment") == F.col("_segment")).orderBy(*by_time).limit(target).select("id", F.lit(3).alias("_by"))
    newest = items.orderBy(*by_time).limit(recent).select("id", F.lit(1).alias("_by"))
    rows = newest.unionByName(seen).unionByName(found).groupBy("id").agg(F.min("_by").alias("_by"))
    origin = F.element_at(F.array(F.lit("recent"), F.lit("rotation"), F.lit("target")), F.col("_by")).alias("origin")
    more = found.agg(F.count("id").alias("_n"))
    moved = targets.join(chosen, F.col("segment") == F.col("_segment"), "left").join(more, F.lit(True))
    hit = F.col("_segment").isNotNull()
    states = {
        "rotation": rotation.select(F.pmod(F.col("next_page") + pages, F.col("total_pages")).alias("next_page"), "total_pages"),
        "targets": moved.select("segment", "place", (F.col("runs") + hit.cast("int")).alias("runs"), (F.col("records") + F.when(hit, F.col("_n")).otherwise(0)).alias("records")),
    }
    return rows.select("id", origin), states


@query("STM-07", "STM-09", sql="""
with i as (select event_id as id, ts, event_id // 40 as page, event_type as segment from events), t as (select max(page) + 1 as total from i),
seg as (select s, p from (values ('view', 0), ('click', 1), ('purchase', 2), ('error', 3), ('signup', 4)) v(s, p)),
r as (select n as round, (n - 1) * 3 as step, s from (values (1), (2), (3), (4)) x(n) join seg on p = (n - 1) % 5),
newest as (select id from i order by ts desc, id desc limit 30),
found as (select round, id from (select round, i.id, row_number() over (partition by round order by ts desc, i.id desc) as k from r join i on segment = s) where k <= 25),
all_ as (select round, id, 1 as b from r, newest union all select round, id, 2 from r, t, i where (page - (total - 5 + step) % total + total) % total < 3 union all select round, id, 3 from found)
select round::int as round, id, ['recent', 'rotation', 'target'][min(b)] as origin from all_ group by round, id""")
def committed_hybrid_rounds(spark, sf_dir):
    """Four rounds with two states, which one manifest commits together: the rotation starts five pages before the end and wraps; the third round fails once."""
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.floor(F.col("event_id") / 40).alias("page"), F.col("event_type").alias("segment"))
    root = shared_folder(spark)
    total = (F.max("page") + 1).cast("long")
    rotation = items.agg(F.pmod(total - 5, total).alias("next_page"), total.alias("total_pages"))
    targets = spark.createDataFrame([(s, i, 0, 0) for i, s in enumerate(TARGETS)], "segment string, place int, runs int, records long")

    def fetch():
        return hybrid_batch(items, load_committed(spark, root, "rotation", rotation), load_committed(spark, root, "targets", targets), 3, 30, 25)

    return with_retries(spark, root, [1, 2, 3, 4], fetch, {3})
