"""Streams of alerts against the fold over the same ticks, and what their timers let go of."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.sources.state import shared_folder
from pricelens.streaming import alerts, twins

DAY = datetime.datetime(2024, 1, 1)


def ticks(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        at = DAY + datetime.timedelta(minutes=r.randrange(60 * 24 * 40))
        rows.append((i, r.choice(["a", "b", "c"]), at, r.choice([None, 10.0, 9.0, 8.0, 100.0]), float(r.randrange(12))))
    return spark.createDataFrame(rows, "event_id long, k string, ts timestamp, price double, gap double")


@pytest.mark.parametrize("rule,step,fields", [(twins.Delivery(), alerts.delivery_step(), "delivery string"), (twins.Cooldown(24), alerts.cooldown_step(24), "sent boolean")])
def test_a_stream_decides_as_the_fold(spark, rule, step, fields):
    df = ticks(spark)
    name = fields.split()[0]
    want = {r.event_id: r[name] for r in alerts.folded(df, ["k"], ["ts", "event_id"], step, fields).collect()}
    got = twins.in_slices(df, "ts", ["2024-01-12", "2024-01-25"], lambda s: twins.kept(s, ["k"], "ts", ["ts", "event_id"], rule)).collect()
    assert {r.event_id: r[name] for r in got} == want and len(got) == 150 and len(set(want.values())) > 1


def test_a_timer_forgets_what_has_cooled_down(spark):
    root = shared_folder(spark)
    schema = "event_id long, k string, ts timestamp, price double, gap double"
    for n, rows in enumerate(([(1, "a", DAY, 1.0, 0.0), (2, "b", DAY, 1.0, 0.0)], [(3, "c", DAY + datetime.timedelta(days=3), 1.0, 0.0)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        stream = twins.kept(spark.readStream.schema(schema).parquet(f"{root}/in"), ["k"], "ts", ["ts"], twins.Cooldown(24))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{root}/cp").option("stateVarName", "last").load()
        assert sorted(r.k for r in state.select(F.col("key.k").alias("k")).collect()) == [["a", "b"], ["c"]][n]
    assert spark.read.parquet(f"{root}/out").where("sent").count() == 3


@pytest.mark.parametrize("rule,step,fields", [(twins.Delivery(), alerts.delivery_step(), "delivery string"), (twins.Cooldown(24), alerts.cooldown_step(24), "sent boolean")])
def test_bundles_of_keys_decide_as_the_fold(spark, rule, step, fields):
    df = ticks(spark).withColumn("k", F.when(F.col("k") != "c", F.col("k"))).withColumn("m", F.col("event_id") % 5)
    name = fields.split()[0]
    want = {r.event_id: r[name] for r in alerts.folded(df, ["k", "m"], ["ts", "event_id"], step, fields).collect()}
    got = twins.in_slices(df, "ts", ["2024-01-12", "2024-01-25"], lambda s: twins.kept(s, ["k", "m"], "ts", ["ts", "event_id"], rule, bundles=3)).collect()
    assert {r.event_id: r[name] for r in got} == want and len(got) == 150 and len(set(want.values())) > 1


def test_a_bundle_forgets_what_has_cooled_down_and_keeps_the_rest(spark):
    root = shared_folder(spark)
    schema = "event_id long, k string, ts timestamp, price double, gap double"
    for n, rows in enumerate(([(1, "a", 0, 1.0), (2, "b", 30, 1.0)], [(3, "a", 31, 1.0), (4, "c", 52, 1.0)], [(5, "d", 200, 1.0)])):
        made = [(i, k, DAY + datetime.timedelta(hours=h), p, 0.0) for i, k, h, p in rows]
        spark.createDataFrame(made, schema).write.mode("append").parquet(f"{root}/in")
        stream = twins.kept(spark.readStream.schema(schema).parquet(f"{root}/in"), ["k"], "ts", ["ts"], twins.Cooldown(24), bundles=1)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{root}/cp").option("stateVarName", "last").load()
        assert sorted(r.k for r in state.select(F.col("list_element.key").alias("k")).collect()) == [['{"k":"b"}'], ['{"k":"a"}', '{"k":"b"}', '{"k":"c"}'], ['{"k":"d"}']][n]
    assert spark.read.parquet(f"{root}/out").where("sent").count() == 5


def test_states_of_a_bundle_cost_a_few_calls():
    """However many keys have rows: the list is read once and written once, and there is one timer for all."""

    class Handle:
        calls = []

        def getListState(self, *a):
            return self

        def __getattr__(self, name):
            return lambda *a: self.calls.append(name) or []

    made = twins.Together(twins.Cooldown(24), ["ts", "event_id"], ["sent"])
    made.init(Handle())
    rows = pd.DataFrame({"event_id": range(600), "bundle_key": [f"{i % 200}" for i in range(600)], "bundle": 0, "ts": pd.Timestamp(DAY), "price": 1.0, "gap": 0.0})
    out = pd.concat(made.handleInputRows((0,), iter([rows]), None))
    assert out["sent"].sum() == 200 and Handle.calls == ["get", "put", "registerTimer"]
