"""Alert rules as streams: the steps of alerts.py over state that a stream keeps, with timers that let go of it.

A micro-batch's rows of a key are taken by time, so that a stream whose batches follow each other in time makes exactly the
decisions of folded(). Timers run on the watermark: rows before it are late and do not come, so what an expired
rule would decide for any later row is known, and only that is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..registry import SQL, query
from ..sources.state import shared_folder
from ..sources.tables import table
from .alerts import cooldown_step, delivery_step, lots, notification_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1)


def millis(at: datetime) -> int:
    return (at - EPOCH) // timedelta(milliseconds=1)


class Rule:
    """A step of alerts.py with what a stream needs: how its state is stored, when it expires, and what is left of it then."""

    fields: str
    stored: str

    def step(self, state, row: dict):
        raise NotImplementedError

    def pack(self, state) -> tuple:
        return tuple(state)

    def unpack(self, row: tuple):
        return tuple(row)

    def expires(self, state) -> int | None:
        """Milliseconds of event time from which on the state holds no more; None for never."""
        return None

    def expired(self, state):
        """What is kept of an expired state; None for nothing."""
        return None


class Notification(Rule):
    fields, stored = "decision string, final boolean", "price double, discount double, minutes long, quarter boolean, final boolean"
    names = ("price", "discount", "minutes", "quarter", "final")

    def step(self, state, row):
        return notification_step(state, row)

    def pack(self, state):
        return tuple(state[n] for n in self.names)

    def unpack(self, row):
        return dict(zip(self.names, row))


class Delivery(Rule):
    """After `days` it matters only that the key was delivered once."""

    fields, stored = "delivery string", "at timestamp, price double"

    def __init__(self, days: float = 14.0, drop: float = 5.0):
        self.days, self.decide = days, delivery_step(days, drop)

    def step(self, state, row):
        return self.decide(state, row)

    def expires(self, state):
        return None if state[0] == EPOCH else millis(state[0]) + int(max(1.0, self.days) * 86_400_000)

    def expired(self, state):
        return EPOCH, None


class Cooldown(Rule):
    """After `hours` a key is as if it had never been seen."""

    fields, stored = "sent boolean", "at timestamp, price double, gap double"

    def __init__(self, hours: float, gap: float = 5.0):
        self.hours, self.decide = hours, cooldown_step(hours, gap)

    def step(self, state, row):
        return self.decide(state, row)

    def expires(self, state):
        return millis(state[0]) + int(self.hours * 3_600_000)


class Kept(StatefulProcessor):
    """A rule over the rows of each key; one value of state a key, and one timer at most."""

    def __init__(self, rule: Rule, order: list[str], names: list[str]):
        self.rule, self.order, self.names = rule, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("last", self.rule.stored)

    def _state(self):
        if not self.value.exists():
            return None
        return self.rule.unpack(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in self.value.get()))

    def _keep(self, state) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.value.clear()
            return
        self.value.update(self.rule.pack(state))
        at = self.rule.expires(state)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        before = state = self._state()
        made, columns = [], list(pdf.columns)
        for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
            state, values = self.rule.step(state, {c: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for c, v in zip(columns, row)})
            made.append(values)
        if state != before:
            self._keep(state)
        yield pd.concat([pdf, pd.DataFrame(made, columns=self.names)], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        at = None if state is None else self.rule.expires(state)
        if at is not None and at <= expiredTimerInfo.getExpiryTimeInMs():
            self._keep(self.rule.expired(state))
        return iter(())

    def close(self) -> None:
        pass


class Together(StatefulProcessor):
    """A rule over many keys at a time: the states of a bundle of keys are one list, with one timer, for the first that expires.

    A frame and a call to the state cost far more than a row. A bundle has them once for all of its keys, but its list is
    read and written whole: for streams whose batches hold most of the keys, with a few rows each.
    """

    def __init__(self, rule: Rule, order: list[str], names: list[str]):
        self.rule, self.order, self.names = rule, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.list = handle, handle.getListState("last", f"key string, {self.rule.stored}")

    def _states(self) -> dict:
        rows = (tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row) for row in self.list.get())
        return {row[0]: self.rule.unpack(row[1:]) for row in rows}

    def _keep(self, states: dict) -> None:
        if states:
            self.list.put([(key, *self.rule.pack(state)) for key, state in states.items()])
        else:
            self.list.clear()

    def _first(self, states: dict) -> int | None:
        return min((at for at in map(self.rule.expires, states.values()) if at is not None), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        states = self._states()
        first, changed = self._first(states), False
        made, columns = [], list(pdf.columns)
        for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
            tick = {c: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for c, v in zip(columns, row)}
            before = states.get(tick["bundle_key"])
            state, values = self.rule.step(before, tick)
            if state != before:
                states[tick["bundle_key"]], changed = state, True
            made.append(values)
        if changed:
            self._keep(states)
            new = self._first(states)
            if new is not None and (first is None or new < first):  # else a timer is there that comes no later
                self.handle.registerTimer(new)
        yield pd.concat([pdf.drop(columns=["bundle_key", "bundle"]), pd.DataFrame(made, columns=self.names)], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        states, left = self._states(), {}
        for own, state in states.items():
            at = self.rule.expires(state)
            state = self.rule.expired(state) if at is not None and at <= now else state
            if state is not None:
                left[own] = state
        if left != states:
            self._keep(left)
        new = self._first(left)
        if new is not None:
            self.handle.registerTimer(new)
        return iter(())

    def close(self) -> None:
        pass


def kept(ticks: DataFrame, keys: list[str], time: str, order: list[str], rule: Rule, late: str = "1 hour", bundles: int = 0) -> DataFrame:
    """A stream of ticks with the fields of a rule; rows may be late by `late`. bundles: a number of lists that hold the states of all keys together; 0: a state for each key."""
    spark = ticks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    more = spark.createDataFrame([], rule.fields).schema
    out = StructType([*ticks.schema, *more])
    ticks = ticks.withWatermark(time, late)
    if bundles:
        key = F.to_json(F.struct(*keys), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        dealt = ticks.withColumns({"bundle_key": key, "bundle": F.pmod(F.xxhash64(*keys), F.lit(bundles))})
        return dealt.groupBy("bundle").transformWithStateInPandas(Together(rule, order, more.fieldNames()), out, "Append", "EventTime")
    return ticks.groupBy(*keys).transformWithStateInPandas(Kept(rule, order, more.fieldNames()), out, "Append", "EventTime")


def in_slices(ticks: DataFrame, time: str, borders: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream puts out over ticks that arrive in slices of time, each one after the stream was stopped and started again from its checkpoint."""
    spark: SparkSession = ticks.sparkSession
    root = shared_folder(spark)
    edges = [None, *borders, None]
    for lo, hi in zip(edges, edges[1:]):
        part = ticks if lo is None else ticks.where(F.col(time) >= F.lit(lo).cast("timestamp"))
        part = part if hi is None else part.where(F.col(time) < F.lit(hi).cast("timestamp"))
        part.write.mode("append").parquet(f"{root}/ticks")
        stream = run(spark.readStream.schema(ticks.schema).parquet(f"{root}/ticks"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


SLICES = ["2024-01-10", "2024-01-20"]
BUNDLES = 1024


@query("STM-17", "STM-18", sql=SQL["alert_decisions"])
def streamed_alerts(spark, sf_dir):
    """alert_decisions as a stream over three slices of time."""
    ticks = lots(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return in_slices(ticks, "ts", SLICES, lambda s: kept(s, ["user_id"], "ts", ["ts", "event_id"], Notification())).select("event_id", "user_id", "decision", "final")


@query("STM-19", sql=SQL["delivery_decisions"])
def streamed_deliveries(spark, sf_dir):
    """delivery_decisions as a stream; a timer drops what was delivered once it has expired."""
    ticks = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 50 > 0, F.col("value")).alias("price"))
    return in_slices(ticks, "ts", SLICES, lambda s: kept(s, ["user_id"], "ts", ["ts", "event_id"], Delivery())).select("event_id", "user_id", "delivery")


@query("STM-20", "STM-23", sql=SQL["cooled_down_alerts"])
def streamed_cooldowns(spark, sf_dir):
    """cooled_down_alerts as a stream; a timer forgets a key when its cooldown is over."""
    ticks = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("event_id") % 17).cast("double").alias("gap"))
    rows = in_slices(ticks, "ts", SLICES, lambda s: kept(s, ["user_id", "event_type"], "ts", ["ts", "event_id"], Cooldown(24), bundles=BUNDLES))
    return rows.where("sent").select("event_id", "user_id")
