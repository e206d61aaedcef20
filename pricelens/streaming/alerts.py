"""Alerts as state: what is sent depends on the alert that was last sent for a key, not on the tick before.

folded() runs such a rule over ordered ticks. Keys are dealt by a shuffle and sorted inside each task; a task
reads its rows in batches and holds the state of one key at a time, so a hot key needs time, not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..registry import query
from ..sources.tables import table


def folded(ticks: DataFrame, keys: list[str], order: list[str], step: Callable, fields: str) -> DataFrame:
    """ticks with more columns (fields, a DDL list): step(state or None, row) gives (next state, values) for every tick.

    Rows of a key are taken by `order`; ties beyond it are taken in any order. A null key is a key of its own.
    """
    more = ticks.sparkSession.createDataFrame([], fields).schema
    out = StructType([*ticks.schema, *more])
    names, columns = more.fieldNames(), ticks.columns
    at = [columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for pdf in batches:
            values = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                own = tuple(row[i] for i in at)
                if own != key:
                    key, state = own, None
                state, made = step(state, dict(zip(columns, row)))
                values.append(made)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1)

    return ticks.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out)


def notification_step(last: dict | None, tick: dict) -> tuple[dict | None, tuple]:
    """Whether a priced lot is announced (again): (next state, (decision, final)).

    First seen: yes. Later: the price fell by a tenth, the discount grew by 5 points, an auction is below its
    limit in the last 5 minutes (once), or passed under 15 minutes (once). The state changes with what is sent. A tick without a price or a discount is
    unknown and changes nothing.
    """
    auction, minutes, price = tick["auction"], tick["minutes"], tick["price"]
    if price is None or tick["discount"] is None:  # nothing is known that could be announced
        return last, ("unknown", False)
    due = bool(auction and minutes is not None and minutes <= 5 and price <= tick["limit"])
    final = due and not (last and last["final"])
    if last is None:
        why = ["new"]
    else:
        why = []
        if last["price"] > 0 and price <= last["price"] * 0.90:
            why.append("price")
        if tick["discount"] >= last["discount"] + 5:
            why.append("discount")
        if final:
            why.append("final")
        elif auction and minutes is not None and minutes <= 15 and not last["quarter"] and (last["minutes"] is None or last["minutes"] > 15):
            why.append("quarter")
    if not why:
        return last, ("quiet", False)
    quarter = bool(last and last["quarter"]) or bool(auction and minutes is not None and minutes <= 15)
    return {"price": price, "discount": tick["discount"], "minutes": minutes, "quarter": quarter, "final": final or bool(last and last["final"])}, ("+".join(why), final)


LOTS_SQL = """lots as (select event_id, user_id, ts, value as price, 60.0::double as "limit", 100 - value as discount, user_id % 2 = 0 as auction,
  case when event_id % 9 = 0 then null else (event_id * 37) % 60 end as minutes, row_number() over (partition by user_id order by ts, event_id) as n from events)"""


def lots(spark, sf_dir) -> DataFrame:
    """Events as ticks of a user's lot: price, limit, discount, minutes to the end (unknown for every ninth)."""
    minutes = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") * 37) % 60)
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("value").alias("price"), F.lit(60.0).alias("limit"), (100 - F.col("value")).alias("discount"),
        (F.col("user_id") % 2 == 0).alias("auction"), minutes.alias("minutes"),
    )


@query("STM-17", "STM-18", sql=f"""
with recursive {LOTS_SQL},
d as (select l.*, 'new' as decision, auction and coalesce(minutes <= 5, false) and price <= "limit" as final, price as p, discount as di, minutes as mi,
        auction and coalesce(minutes <= 15, false) as q, auction and coalesce(minutes <= 5, false) and price <= "limit" as fi from lots l where n = 1
  union all
  select l.*, case when w.why = '' then 'quiet' else w.why end, w.final and w.why <> '', case when w.why = '' then d.p else l.price end, case when w.why = '' then d.di else l.discount end,
    case when w.why = '' then d.mi else l.minutes end, d.q or (w.why <> '' and l.auction and coalesce(l.minutes <= 15, false)), d.fi or w.final
  from d join lots l on l.user_id = d.user_id and l.n = d.n + 1,
  lateral (select l.auction and coalesce(l.minutes <= 5, false) and l.price <= l."limit" and not d.fi as final) f,
  lateral (select f.final, array_to_string(list_filter([case when d.p > 0 and l.price <= d.p * 0.90::double then 'price' end, case when l.discount >= d.di + 5 then 'discount' end, case when f.final then 'final' end,
    case when not f.final and l.auction and coalesce(l.minutes <= 15, false) and not d.q and coalesce(d.mi > 15, true) then 'quarter' end], lambda x: x is not null), '+') as why) w)
select event_id, user_id, decision, final from d""")
def alert_decisions(spark, sf_dir):
    ticks = lots(spark, sf_dir)
    return folded(ticks, ["user_id"], ["ts", "event_id"], notification_step, "decision string, final boolean").select("event_id", "user_id", "decision", "final")


def guarded(decisions: DataFrame, fast: DataFrame, key: str) -> DataFrame:
    """Decisions of the slow lane where a fast lane sends final alerts: final reasons go, and a decision with no other is quiet.

    fast has the keys that the fast lane announced (each once); they are marked final_sent.
    """
    why = F.array_join(F.filter(F.split("decision", r"\+"), lambda r: r != "final"), "+")
    sent = fast.select(F.col(key).alias("_fast")).distinct()
    out = decisions.join(sent, F.col(key) == F.col("_fast"), "left")
    return out.select(*[c for c in decisions.columns if c not in ("decision", "final")], F.when(why == "", "quiet").otherwise(why).alias("decision"), F.col("_fast").isNotNull().alias("final_sent"))


@query("STM-21", sql="""
with d as (select o_orderkey, case o_orderkey % 4 when 0 then 'final' when 1 then 'price+final' when 2 then 'new' else 'quiet' end as decision from orders),
f as (select distinct l_orderkey from lineitem where l_quantity >= 49)
select o_orderkey, case when decision = 'final' then 'quiet' when decision = 'price+final' then 'price' else decision end as decision, l_orderkey is not null as final_sent from d left join f on o_orderkey = l_orderkey""")
def guarded_decisions(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "final").when(k == 1, "price+final").when(k == 2, "new").otherwise("quiet").alias("decision"))
    fast = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return guarded(d, fast, "o_orderkey")


def final_checks(armed: DataFrame, fresh: DataFrame, sent: DataFrame, key: str, window: float = 5.0) -> DataFrame:
    """Armed auctions to announce now: not announced before, read again with a price and a time, inside the window, and at or below the limit they were armed with."""
    due = armed.join(sent.select(key), key, "left_anti").join(fresh.select(key, "price", "minutes"), key)
    return due.where((F.col("minutes") > 0) & (F.col("minutes") <= window) & (F.col("price") <= F.col("limit"))).select(key, "price", "minutes", "limit")


@query("STM-22", "WIN-16", sql="""
select o_orderkey, p.price, p.minutes, p."limit" from (
  select o_orderkey, floor(o_totalprice / 1000)::double as "limit", case when o_orderkey % 11 > 0 then floor(o_totalprice * (0.9 + (o_orderkey % 3) / 10.0) / 1000)::double end as price, (o_orderkey % 13 - 2)::double as minutes, o_orderstatus from orders) p
where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F') and minutes > 0 and minutes <= 5 and price <= "limit" """)
def final_lane(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    armed = o.where("o_orderstatus = 'O'").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("limit"))
    price = F.expr("if(o_orderkey % 11 > 0, cast(floor(o_totalprice * (0.9D + (o_orderkey % 3) / 10.0D) / 1000) as double), null)")
    fresh = o.select("o_orderkey", price.alias("price"), (F.col("o_orderkey") % 13 - 2).cast("double").alias("minutes"))
    sent = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return final_checks(armed, fresh, sent, "o_orderkey")


def delivery_step(days: float = 14.0, drop: float = 5.0):
    """Steps of a delivery filter: first seen, expired after `days` since the last delivery, or `drop` percent cheaper than it."""

    def step(last: tuple | None, tick: dict) -> tuple[tuple, tuple]:
        if last is None:
            why = "first seen"
        elif (tick["ts"] - last[0]).total_seconds() >= max(1.0, days) * 86400:
            why = "expired"
        elif last[1] is None:
            why = "price unknown"
        elif tick["price"] is not None and tick["price"] <= last[1] * (1 - max(0.0, drop) / 100) + 1e-9:
            why = "improved"
        else:
            return last, ("seen",)
        return (tick["ts"], tick["price"]), (why,)

    return step


@query("STM-19", sql="""
with recursive t as (select event_id, user_id, ts, case when event_id % 50 > 0 then value end as price, row_number() over (partition by user_id order by ts, event_id) as n from events),
d as (select t.*, 'first seen' as delivery, ts as at, price as p from t where n = 1
  union all select t.*, w.why, case when w.why = 'seen' then d.at else t.ts end, case when w.why = 'seen' then d.p else t.price end
  from d join t on t.user_id = d.user_id and t.n = d.n + 1,
  lateral (select case when epoch_us(t.ts) - epoch_us(d.at) >= 14 * 86400000000 then 'expired' when d.p is null then 'price unknown' when t.price <= d.p * (1 - 5 / 100.0::double) + 1e-9 then 'improved' else 'seen' end as why) w)
select event_id, user_id, delivery from d""")
def delivery_decisions(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 50 > 0, F.col("value")).alias("price"))
    return folded(ticks, ["user_id"], ["ts", "event_id"], delivery_step(), "delivery string").select("event_id", "user_id", "delivery")


def cooldown_step(hours: float, gap: float = 5.0):
    """Steps of a cooldown: sent at first, after `hours` since the last sent one, or sooner for a tenth off its price or `gap` points more."""

    def step(last: tuple | None, tick: dict) -> tuple[tuple, tuple]:
        if last is not None and (tick["ts"] - last[0]).total_seconds() < hours * 3600:
            cheaper = last[1] is not None and last[1] > 0 and tick["price"] is not None and tick["price"] <= last[1] * 0.90
            wider = (tick["gap"] or 0.0) >= (last[2] or 0.0) + gap
            if not (cheaper or wider):
                return last, (False,)
        return (tick["ts"], tick["price"], tick["gap"]), (True,)

    return step


@query("STM-20", "STM-23", sql="""
with recursive t as (select event_id, user_id, event_type, ts, value as price, (event_id % 17)::double as gap, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
d as (select t.*, true as sent, ts as at, price as p, gap as g from t where n = 1
  union all select t.*, w.sent, case when w.sent then t.ts else d.at end, case when w.sent then t.price else d.p end, case when w.sent then t.gap else d.g end
  from d join t on t.user_id = d.user_id and t.event_type = d.event_type and t.n = d.n + 1,
  lateral (select epoch_us(t.ts) - epoch_us(d.at) >= 24 * 3600000000 or (d.p > 0 and t.price <= d.p * 0.90::double) or t.gap >= d.g + 5 as sent) w)
select event_id, user_id from d where sent""")
def cooled_down_alerts(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.col("value").alias("price"), (F.col("event_id") % 17).cast("double").alias("gap"))
    return folded(ticks, ["user_id", "event_type"], ["ts", "event_id"], cooldown_step(24), "sent boolean").where("sent").select("event_id", "user_id")
