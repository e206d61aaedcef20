"""Calls under budgets, retries, and evidence as it was known: what a run may ask for, and what it still knows.

Nothing here loops over rows: reasons stay because the first one of a key is carried on by a window, retries count
from the last status that was no failure, and the evidence known at a time is the last one before it, looked for
inside slices of time and carried from slice to slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import table


def call_budget(calls: DataFrame, key: str, order: list[str], max_calls: int = 12, max_credits: int = 60, floor: int = 15_000, known_left: Column | None = None) -> DataFrame:
    """calls with allowed, reason (why a call was refused, null if it was allowed) and credits (spent before it).

    What a call costs (consumed) and what is left of the day (remaining) is known only from its answer, null where the
    answer did not say. A call is refused once max_calls were made, max_credits are spent or the rest of the day is at
    the floor; the call that crosses a limit is still made. An answer that does not say what it cost or what is left,
    or that went past the credits, ends the run. The first reason stays: nothing is asked for after it.
    known_left is the rest of the day before the first call, if known. order must tell the calls of a key apart.
    """
    past = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumns({"_n": F.count(F.lit(1)).over(past), "_spent": F.coalesce(F.sum("consumed").over(past), F.lit(0)).cast("long"), "_left": F.lag("remaining").over(Window.partitionBy(key).orderBy(*order))})
    left = F.when((F.col("_n") == 0), known_left if known_left is not None else F.lit(None).cast("long")).otherwise(F.col("_left"))
    before = F.when(F.col("_n") >= max_calls, "HTTP_CALL_CAP").when(F.col("_spent") >= max_credits, "CREDIT_CAP").when(left <= floor, "DAILY_REMAINING_SAFETY_FLOOR")
    after = (
        F.when(F.col("consumed").isNull(), "CREDIT_HEADER_REQUIRED").when(F.col("remaining").isNull(), "DAILY_REMAINING_HEADER_REQUIRED")
        .when(F.col("_spent") + F.col("consumed") > max_credits, "CREDIT_CAP_EXCEEDED").when(F.col("remaining") <= floor, "DAILY_REMAINING_SAFETY_FLOOR")
    )
    rows = rows.withColumns({"_before": before, "_after": after})
    earlier = F.first(F.coalesce("_before", "_after"), ignorenulls=True).over(past)
    rows = rows.withColumn("reason", F.coalesce(earlier, F.col("_before"))).withColumn("allowed", F.col("reason").isNull())
    made = F.when(F.col("allowed"), F.col("consumed")).otherwise(0)
    rows = rows.withColumn("credits", (F.coalesce(F.sum(made).over(upto), F.lit(0)) - F.coalesce(made, F.lit(0))).cast("long"))
    return rows.drop("_n", "_spent", "_left", "_before", "_after")


def within_reserve(candidates: DataFrame, key: str, order: list[str], reserved: str, total: int, reserve: int) -> DataFrame:
    """candidates with cap (what they may bring the count to) and taken: others may not use the reserve, those with `reserved` may.

    Calls are taken in order. All take part until only the reserve is left; from there on only the reserved ones do.
    """
    total = max(0, total)
    free = total - max(0, min(total, reserve))
    at = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = candidates.withColumn("_n", F.count(F.lit(1)).over(at))
    late = F.sum(F.when((F.col("_n") > free) & F.col(reserved), 1).otherwise(0)).over(at)
    taken = (F.col("_n") <= free) | (F.col(reserved) & (late + free <= total))
    return rows.withColumns({"cap": F.when(F.col(reserved), total).otherwise(free), "taken": taken}).drop("_n")


def retries(statuses: DataFrame, key: str, order: list[str], base: int = 15, most: int = 360, cooldown: int = 5) -> DataFrame:
    """key, retry_count and wait_minutes after the last status of each key.

    status is RETRY (the provider failed), PENDING (no budget was left) or anything else. Failures in a row wait base minutes,
    doubled each time, up to most; a lack of budget is no failure: the count starts anew and the next try comes
    after the short cooldown (at once if that is 0). Any other status clears both.
    """
    at = F.struct(*order)
    last = statuses.groupBy(key).agg(F.max_by("status", at).alias("_status"), F.max(F.when(~F.col("status").eqNullSafe("RETRY"), at)).alias("_clear"))
    failed = statuses.where("status = 'RETRY'").select(F.col(key).alias("_key"), at.alias("_at"))
    rows = last.join(failed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_clear").isNull() | (F.col("_at") > F.col("_clear"))), "left")
    n = rows.groupBy(key).agg(F.count("_at").alias("retry_count"), F.any_value("_status").alias("_status"))
    wait = F.least(base * F.pow(F.lit(2.0), F.least(F.col("retry_count"), F.lit(30)) - 1), F.lit(float(most))).cast("int")
    short = max(0, min(30, cooldown))
    return n.select(key, "retry_count", F.when(F.col("_status") == "RETRY", wait).when(F.col("_status") == "PENDING", F.lit(short if short else None).cast("int")).alias("wait_minutes"))


def known_at(ticks: DataFrame, evidence: DataFrame, keys: list[str], time: str, found: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """ticks with the columns `found` of the latest evidence of their key at or before their time; null where there is none.

    evidence has keys, time and found; ties in time go to the largest found. Rows meet inside slices of time, so that a
    key of many rows is many groups; what was known when a slice began comes from the last evidence of earlier slices, of which
    there is one row for each key and slice. No row of one side is compared with a row of the other.
    """
    part = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(slice_seconds * 1_000_000)).alias("_slice")
    what = F.struct(F.col(time).alias("_at"), *found)
    tick = ticks.select(F.struct(*[F.col(f"`{c}`") for c in ticks.columns]).alias("_row"), *keys, time, part, F.lit(1).alias("_kind"))
    kind = evidence.select(what.alias("_what")).schema["_what"].dataType
    rows = tick.withColumn("_what", F.lit(None).cast(kind)).unionByName(evidence.select(*keys, time, part, F.lit(0).alias("_kind"), what.alias("_what")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_slice").orderBy(time, "_kind", "_what").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_what", ignorenulls=True).over(inside)).where("_kind = 1")
    slices = rows.select(*keys, "_slice").distinct().withColumn("_end", F.lit(None).cast(kind)).unionByName(evidence.select(*keys, part, what.alias("_end")))
    ends = slices.groupBy(*keys, "_slice").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    began = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), F.last("_end", ignorenulls=True).over(earlier).alias("_began"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = rows.join(began, same & (F.col("_slice") == F.col("_s")), "left").withColumn("_known", F.coalesce("_last", "_began"))
    return out.select("_row.*", *[F.col(f"_known.{c}").alias(c) for c in found])


def adaptive_ttl(price: Column, central: Column, low: Column, required: Column, default: int = 24, arbitrage: Column | None = None) -> Column:
    """Hours for which evidence holds: the nearer a price is to being a bargain, the fewer. Gaps of up to 3, 6, 10 and 15 points
    hold 1, 2, 3 and 6 hours; the gap is what the smaller of the discounts from central and low lacks to the required one,
    or for a converted estimate the percentage that the price lies over low."""
    below = lambda x: (x - price) / F.when(x > 0, x) * 100
    discount = F.when(low > 0, F.least(below(central), below(low))).otherwise(below(central))
    gap = F.greatest(F.lit(0.0), required - discount)
    if arbitrage is not None:
        gap = F.when(arbitrage, F.when(low > 0, F.greatest(F.lit(0.0), -below(low)))).otherwise(gap)
    tiers = F.when(gap <= 3, 1).when(gap <= 6, 2).when(gap <= 10, 3).when(gap <= 15, 6).otherwise(default)
    return F.when((price > 0) & (central > 0), tiers).otherwise(default)


def cache_state(age_hours: Column, ttl: Column) -> Column:
    """MISS without evidence, STALE from the ttl (an hour at least) on, else HIT."""
    return F.when(age_hours.isNull(), "MISS").when(age_hours >= F.greatest(ttl, F.lit(1)), "STALE").otherwise("HIT")


def evaluated_once(candidates: DataFrame, run: str, identity: str, order: list[str], budget: int) -> DataFrame:
    """One row for each identity of a run: n, cache, representative (id), place in the queue and status.

    candidates have id, fixed, price, age_hours of the evidence known to the run (null: none) and ttl. The evidence of an identity
    is as good as its most demanding fixed candidate allows. An identity with a HIT is not asked for; the others queue, each
    by its first candidate in order, STALE after MISS, and the first `budget` of a run are fetched. The rest stays pending.
    """
    asked = F.when(F.col("fixed") & (F.col("price") > 0), F.col("ttl"))
    first = F.struct(*order, "id")
    g = candidates.groupBy(run, identity).agg(F.count("id").alias("n"), F.min("age_hours").alias("_age"), F.coalesce(F.min(asked), F.lit(24)).alias("_ttl"), F.min(first).alias("_first"))
    g = g.withColumn("cache", cache_state(F.col("_age"), F.col("_ttl")))
    queue = Window.partitionBy(run).orderBy(F.col("cache") == "STALE", "_first")
    queued = g.where("cache <> 'HIT'").withColumn("place", F.row_number().over(queue))
    rows = queued.unionByName(g.where("cache = 'HIT'").withColumn("place", F.lit(None).cast("int")))
    status = F.when(F.col("cache") == "HIT", "cached").when(F.col("place") <= budget, "fetched").otherwise("pending")
    return rows.select(run, identity, "n", "cache", F.col("_first.id").alias("representative"), "place", status.alias("status"))


CALLS_SQL = """calls as (select event_id, user_id, case when event_id % 211 = 0 then null when event_type = 'purchase' then 9 else 4 end as consumed,
  case when event_id % 197 = 0 then null else 15070 - (event_id * 7) % 71 end as remaining, row_number() over (partition by user_id order by ts, event_id) as n from events)"""


@query("STM-16", sql=f"""
with recursive {CALLS_SQL}, r as (
  select 0::bigint as n, u.user_id, 0::bigint as calls, 0::bigint as credits, null::bigint as remaining, '' as blocked, null::bigint as event_id, null::varchar as reason, 0::bigint as before from (select distinct user_id from events) u
  union all select c.n, c.user_id, case when d.why = '' then r.calls + 1 else r.calls end, case when d.why = '' then r.credits + coalesce(c.consumed, 0) else r.credits end, case when d.why = '' then coalesce(c.remaining, r.remaining) else r.remaining end,
    case when d.why <> '' then d.why when c.consumed is null then 'CREDIT_HEADER_REQUIRED' when c.remaining is null then 'DAILY_REMAINING_HEADER_REQUIRED' when r.credits + c.consumed > 60 then 'CREDIT_CAP_EXCEEDED' when c.remaining <= 15000 then 'DAILY_REMAINING_SAFETY_FLOOR' else '' end,
    c.event_id, nullif(d.why, ''), r.credits
  from r join calls c on c.user_id = r.user_id and c.n = r.n + 1,
  lateral (select case when r.blocked <> '' then r.blocked when r.calls >= 12 then 'HTTP_CALL_CAP' when r.credits >= 60 then 'CREDIT_CAP' when r.remaining <= 15000 then 'DAILY_REMAINING_SAFETY_FLOOR' else '' end as why) d)
select event_id, user_id, reason is null as allowed, reason, before as credits from r where n > 0""")
def budgeted_calls(spark, sf_dir):
    """Calls of each user until the first reason to stop."""
    consumed = F.when(F.col("event_id") % 211 != 0, F.when(F.col("event_type") == "purchase", 9).otherwise(4)).cast("long")
    remaining = F.when(F.col("event_id") % 197 != 0, 15070 - F.col("event_id") * 7 % 71)
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", consumed.alias("consumed"), remaining.alias("remaining"))
    return call_budget(calls, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "allowed", "reason", "credits")


@query("STM-15", sql="""
with recursive c as (select event_id, user_id, event_type <> 'click' as fixed, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select 0::bigint as n, user_id, 0 as used, null::bigint as event_id, 0 as cap, false as taken from (select distinct user_id from events)
  union all select c.n, c.user_id, case when r.used < k.cap then r.used + 1 else r.used end, c.event_id, k.cap, r.used < k.cap from r join c on c.user_id = r.user_id and c.n = r.n + 1, lateral (select case when c.fixed then 8 else 5 end as cap) k)
select event_id, user_id, cap, taken from r where n > 0""")
def reserved_calls(spark, sf_dir):
    """Eight look-ups a user, three of them kept for fixed offers."""
    c = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "click").alias("fixed"))
    return within_reserve(c, "user_id", ["ts", "event_id"], "fixed", 8, 3).select("event_id", "user_id", "cap", "taken")


@query("STM-14", "STM-24", sql="""
with s as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events),
l as (select user_id, arg_max(event_type, k) as last_kind, coalesce(max(k) filter (event_type <> 'error'), 0) as clear, max(k) as total from s group by user_id)
select user_id, (total - clear)::bigint as retry_count, case when last_kind = 'error' then least(15 * pow(2, least(total - clear, 30) - 1), 360)::int when last_kind = 'view' then 5 end as wait_minutes from l""")
def retry_backoff(spark, sf_dir):
    """Errors are failures, views lack budget, everything else is a success."""
    status = F.when(F.col("event_type") == "error", "RETRY").when(F.col("event_type") == "view", "PENDING").otherwise("DONE")
    return retries(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", status.alias("status")), "user_id", ["ts", "event_id"])


KNOWN_SQL = """ticks as (select event_id, user_id, ts, value as price from events where event_type <> 'purchase'),
ev as (select event_id, user_id, ts, value as central, value * 0.9::double as low, lead(ts) over (partition by user_id order by ts, event_id) as until from events where event_type = 'purchase'),
known as (select t.event_id, t.user_id, t.ts, t.price, e.ts as evidence_ts, e.central, e.low from ticks t left join ev e on e.user_id = t.user_id and e.ts <= t.ts and (e.until is null or e.until > t.ts)),
gaps as (select *, greatest(0, 20 - least((central - price) / central * 100, (low - price) / low * 100)) as gap, (epoch_us(ts) - epoch_us(evidence_ts)) / 3600e6::double as age from known),
states as (select *, case when price > 0 and central > 0 then case when gap <= 3 then 1 when gap <= 6 then 2 when gap <= 10 then 3 when gap <= 15 then 6 else 24 end else 24 end as ttl from gaps)"""


def known_ticks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    evidence = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("evidence_ts"), F.col("value").alias("central"), (F.col("value") * 0.9).alias("low"))
    ticks = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts", "event_type", F.col("value").alias("price"))
    rows = known_at(ticks, evidence, ["user_id"], "ts", ["evidence_ts", "central", "low"])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.withColumns({"ttl": adaptive_ttl(F.col("price"), F.col("central"), F.col("low"), F.lit(20.0)), "age_hours": (micros("ts") - micros("evidence_ts")) / F.lit(3600e6)})


@query("STM-11", sql=f"""
with {KNOWN_SQL} select event_id, user_id, round(central, 4) as central, round(age, 6) as age_hours, ttl::int as ttl, case when age is null then 'MISS' when age >= ttl then 'STALE' else 'HIT' end as cache from states""")
def cached_evidence(spark, sf_dir):
    """At each tick of a user the latest purchase at or before it, how old it is, how long it holds, and whether it does."""
    rows = known_ticks(spark, sf_dir)
    return rows.select("event_id", "user_id", F.round("central", 4).alias("central"), F.round("age_hours", 6).alias("age_hours"), "ttl", cache_state(F.col("age_hours"), F.col("ttl")).alias("cache"))


@query("STM-12", sql=f"""
with {KNOWN_SQL}, runs as (select ts::date as run, *, event_id % 3 > 0 as fixed, (event_id * 37) % 60 as minutes from states),
g as (select run, user_id, count(*) as n, min(age) as age, coalesce(min(ttl) filter (fixed and price > 0), 24) as ttl, arg_min(event_id, minutes * 1000000000 + event_id) as representative, min(minutes * 1000000000 + event_id) as o from runs group by all),
s as (select *, case when age is null then 'MISS' when age >= ttl then 'STALE' else 'HIT' end as cache from g),
q as (select *, case when cache <> 'HIT' then row_number() over (partition by run, cache = 'HIT' order by cache = 'STALE', o)::int end as place from s)
select run::varchar as run, user_id, n, cache, representative, place, case when cache = 'HIT' then 'cached' when place <= 5 then 'fetched' else 'pending' end as status from q""")
def candidates_evaluated_once(spark, sf_dir):
    """A run a day: candidates of a user share one look-up, and five look-ups are made."""
    rows = known_ticks(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("run"), "user_id", F.col("event_id").alias("id"), "price", "ttl", "age_hours", (F.col("event_id") % 3 > 0).alias("fixed"), (F.col("event_id") * 37 % 60).alias("minutes"))
    return evaluated_once(rows, "run", "user_id", ["minutes"], 5)
