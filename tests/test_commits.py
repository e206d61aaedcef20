"""State in two phases."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricelens.sources.state import load, shared_folder
from pricelens.streaming import commits
from pricelens.streaming.incremental import catch_up, next_state, start_at

START = datetime.datetime(2026, 8, 15, 3)


def feed(spark, *blocks):
    rows = [(h * 10_000 + i, START + datetime.timedelta(hours=h), True) for h, n in blocks for i in range(n)]
    return spark.createDataFrame(rows, "id long, ts timestamp, final boolean")


def fetching(spark, root, items, cap):
    def fetch():
        state = commits.load_committed(spark, root, "watermark", start_at(spark, items, str(START)))
        taken = catch_up(items, state, cap)
        return taken.select("id", "ts"), {"watermark": next_state(taken, items, state)}

    return fetch


def test_a_spike_is_drained_by_committed_batches(spark):
    root, items = shared_folder(spark), feed(spark, (1, 1000), (0, 1))
    for n in (1, 2, 3):
        assert commits.run_batch(spark, root, f"b{n}", fetching(spark, root, items, 400), commits.delivered_to(root, n))
    out = spark.read.parquet(f"{root}/out")
    assert sorted(r["count"] for r in out.groupBy("version").count().collect()) == [201, 400, 400]
    assert out.select("id").distinct().count() == 1001
    assert commits.load_committed(spark, root, "watermark").first().base == START + datetime.timedelta(hours=1)


def test_rows_that_arrive_while_a_backlog_drains_are_kept(spark):
    root, old = shared_folder(spark), feed(spark, (1, 50), (0, 1))
    more = old.unionByName(feed(spark, (2, 10)))
    for n, items in enumerate((old, more, more, more)):
        commits.run_batch(spark, root, f"b{n}", fetching(spark, root, items, 20), commits.delivered_to(root, n))
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == out.select("id").distinct().count() == 61


def test_a_failed_delivery_leaves_every_state_and_is_fetched_again(spark):
    root, items = shared_folder(spark), feed(spark, (1, 30))
    fetch = fetching(spark, root, items, 10)
    commits.run_batch(spark, root, "b1", fetch, commits.delivered_to(root, 1))
    before = commits.committed(spark, root)
    with pytest.raises(ConnectionError):
        commits.run_batch(spark, root, "b2", fetch, commits.delivered_to(root, 2, fail=True))
    assert commits.committed(spark, root) == before
    first = sorted(r.id for r in load(spark, f"{root}/out", 2).collect())
    assert commits.run_batch(spark, root, "b2", fetch, commits.delivered_to(root, 2))
    assert sorted(r.id for r in load(spark, f"{root}/out", 2).collect()) == first


def test_a_committed_batch_changes_nothing_again(spark):
    root, items = shared_folder(spark), feed(spark, (1, 30))
    fetch = fetching(spark, root, items, 10)
    commits.run_batch(spark, root, "b1", fetch, commits.delivered_to(root, 1))
    before = commits.committed(spark, root)
    assert not commits.run_batch(spark, root, "b1", fetch, lambda rows: pytest.fail("delivered again"))
    assert not commits.commit(spark, root, "b1") and commits.committed(spark, root) == before


def test_no_commit_without_a_proposal(spark):
    root = shared_folder(spark)
    with pytest.raises(commits.CommitError):
        commits.commit(spark, root, "b1")
    with pytest.raises(commits.CommitError):
        commits.load_committed(spark, root, "watermark")
    with pytest.raises(ValueError):
        commits.propose(spark, root, "../b", {})


def test_two_states_are_committed_together(spark):
    root = shared_folder(spark)
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    commits.propose(spark, root, "a", {"x": one(1), "y": one(1)})
    commits.commit(spark, root, "a")
    commits.propose(spark, root, "b", {"x": one(2), "y": one(2)})
    seen = lambda: [commits.load_committed(spark, root, t).first().n for t in "xy"]
    assert seen() == [1, 1]
    commits.commit(spark, root, "b")
    assert seen() == [2, 2]
    commits.propose(spark, root, "c", {"y": one(3)})
    commits.commit(spark, root, "c")
    assert seen() == [2, 3]


def test_a_backfill_ends_with_a_short_page(spark):
    items = feed(spark, (1, 25))
    cursor = items.limit(1).select(F.lit(START + datetime.timedelta(hours=9)).alias("ts"), F.lit(0).cast("long").alias("id"), F.lit(False).alias("done"))
    taken = []
    for _ in range(4):
        page, moved = commits.backfill(items, cursor, 10)
        taken.append(sorted(r.id for r in page.collect()))
        cursor = spark.createDataFrame(moved.collect(), moved.schema)
    assert [len(t) for t in taken] == [10, 10, 5, 0] and sorted(sum(taken, [])) == list(range(10_000, 10_025)) and cursor.first().done


def test_hybrid_batches_take_each_item_once_and_wrap(spark):
    items = spark.createDataFrame([(i, START + datetime.timedelta(hours=i % 7), i // 4, "en" if i % 3 else "fr") for i in range(20)], "id long, ts timestamp, page long, segment string")
    rotation = spark.createDataFrame([(4, 5)], "next_page long, total_pages long")
    targets = spark.createDataFrame([("en", 0, 1, 9), ("fr", 1, 0, 0)], "segment string, place int, runs int, records long")
    rows, states = commits.hybrid_batch(items, rotation, targets, 2, 3, 3)
    got = {r.id: r.origin for r in rows.collect()}
    newest = sorted(range(20), key=lambda i: (i % 7, i))[-3:]
    assert [i for i, o in got.items() if o == "recent"] and {i for i, o in got.items() if o == "recent"} == set(newest)
    assert {i for i, o in got.items() if o == "rotation"} == {0, 1, 2, 3, 16, 17, 18, 19} - set(newest)
    assert all(i % 3 == 0 for i, o in got.items() if o == "target") and len(got) <= 3 + 8 + 3
    assert states["rotation"].first().next_page == 1
    assert sorted(tuple(r) for r in states["targets"].collect()) == [("en", 0, 1, 9), ("fr", 1, 1, 3)]
