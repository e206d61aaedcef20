"""Whether other markets confirm a price, what becomes of a card after that, and which decisions are announced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import table
from .offers import ACTIONABLE

#: Ratios beyond which centres contradict each other, and states of providers.
CONFIRM_RATIO, GLOBAL_RATIO, SAME_FAMILY_RATIO = 1.25, 1.35, 1.35
RETRY = ["PROVIDER_ERROR", "TRANSIENT_UNAVAILABLE", "RATE_LIMIT", "PENDING_BUDGET", "UNAVAILABLE"]
TERMINAL = ["MATCHED", "CLEAN_NO_MATCH", "CLEAN_INSUFFICIENT", "STALE_OR_UNDATED", "BLOCKED_IDENTITY", "BLOCKED_LANGUAGE", "BLOCKED_GRADE", "PROVIDER_DISABLED", "MICROVARIANT_UNPROVEN", "AMBIGUOUS", "FX_UNAVAILABLE"]


def apart(a: Column, b: Column) -> Column:
    """How many times the smaller of two centres the larger is; null if either is not above zero."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def cents(x: Column) -> Column:
    """x to two decimals by its hundredths, as the SQL rounds: 2.135 is 2.13 if a hundred of it make 213.49999999999997. round(x, 2) goes by the digits shown."""
    return F.round(x * 100) / 100


def external_of_family(first: Column, second: Column) -> dict[str, Column]:
    """The aggregate that speaks for two providers of one family (structs of provider, center and sales; null: not usable): the first, if they do
    not contradict each other; and whether they do."""
    both = first.isNotNull() & second.isNotNull()
    conflict = both & (apart(first["center"], second["center"]) > SAME_FAMILY_RATIO)
    return {"external": F.when(~F.coalesce(conflict, F.lit(False)), F.coalesce(first, second)), "conflict": F.coalesce(conflict, F.lit(False))}


def confirmed(cards: DataFrame, needs_home: bool, least: float = 30.0) -> DataFrame:
    """cards with status, announce, confirmed, discount, ratio and basis.

    cards have identity_ok, offer (cost of its best actionable offer, null without one), home (fair value of the home market, null if unknown),
    external (center; null without a usable aggregate), sales and family_conflict. With needs_home a card without a home value is blocked; else a strong external
    centre may stand alone. Two centres confirm each other up to a ratio of 1.25, and the lower one counts.
    """
    home, ext, offer = F.when(F.col("home") > 0, F.col("home")), F.col("external"), F.col("offer")
    ratio = apart(home, ext)
    fair = F.when(ext.isNotNull(), F.least(home, ext))  # least() passes over nulls
    discount = (fair - offer) / fair * 100
    enough = discount + 1e-9 >= max(0.0, least)
    status = F.when(~F.col("identity_ok"), "BLOCKED_IDENTITY")
    if needs_home:
        status = status.when(home.isNull(), "BLOCKED_FAIR_VALUE")
    status = (
        status.when(offer.isNull(), "NO_ACTIONABLE_ALL_IN_OFFER").when(ext.isNull(), F.when(F.col("family_conflict"), "MARKET_CONFLICT_BLOCKED").otherwise("NO_EXTERNAL_CONFIRMATION"))
        .when(ratio > CONFIRM_RATIO, "MARKET_CONFLICT_BLOCKED").when(enough, "MULTIMARKET_CONFIRMED").otherwise("NO_GLOBAL_EDGE")
    )
    rows = cards.withColumn("status", status)
    priced = F.col("status").isin("MULTIMARKET_CONFIRMED", "NO_GLOBAL_EDGE")
    basis = F.when(home.isNull(), "EXTERNAL_ONLY").otherwise("HOME_PLUS_EXTERNAL")
    compared = priced | ((F.col("status") == "MARKET_CONFLICT_BLOCKED") & ext.isNotNull())
    return rows.select(
        *cards.columns, "status", (F.col("status") == "MULTIMARKET_CONFIRMED").alias("announce"), F.when(priced, F.round(fair, 2)).alias("confirmed"), F.when(priced, F.round(discount, 1)).alias("discount"), F.when(compared, F.round(ratio, 3)).alias("ratio"), F.when(compared, basis).alias("basis")
    )


def global_market(home: Column, external: Column, landed: Column, least: float) -> dict[str, Column]:
    """status, announce and the three discounts of a landed price: to the home value, to the external one and to their mean (the median of two)."""
    home_off = F.when(home > 0, (home - landed) / F.when(home > 0, home) * 100).otherwise(0.0)
    known = F.coalesce(external > 0, F.lit(False))
    off = lambda x: F.when(x > 0, (x - landed) / F.when(x > 0, x) * 100).otherwise(0.0)
    both = (home + external) / 2
    conflict = F.coalesce(apart(home, external) > GLOBAL_RATIO, F.lit(False))
    agreed = (off(external) + 1e-9 >= least) & (off(both) + 1e-9 >= least)
    status = F.when(~known, "HOME_ONLY_UNCONFIRMED").when(conflict, "MARKET_CONFLICT_BLOCKED").when(agreed, "MULTIMARKET_CONFIRMED").otherwise("HOME_EDGE_NOT_GLOBAL")
    return {
        "status": status, "announce": F.when(known, ~conflict & agreed).otherwise(home_off + 1e-9 >= least), "off_home": F.round(home_off, 1), "off_external": F.when(known, F.round(off(external), 1)),
        "off_global": F.round(F.when(known, off(both)).otherwise(home_off), 1), "priority": F.when(known & ~conflict & agreed, "high").otherwise("default"),
    }


def evaluation_done(canonical: Column, first: Column, second: Column) -> Column:
    """Whether a card need not be evaluated again: its catalogue answer is final, a provider matched, or both answered for good. An error, a lack of budget or a
    provider that may answer later leaves it open; a null state is UNAVAILABLE, a card without a confirmation (all null) is open."""
    a, b = F.coalesce(first, F.lit("UNAVAILABLE")), F.coalesce(second, F.lit("UNAVAILABLE"))
    state = F.coalesce(canonical, F.lit(""))
    return (
        F.when(state.isin("ERROR", "BUDGET"), False).when(state.isin("NO_MATCH", "AMBIGUOUS"), True).when((a == "MATCHED") | (b == "MATCHED"), True).when(a.isin(RETRY) | b.isin(RETRY), False).otherwise(a.isin(TERMINAL) & b.isin(TERMINAL))
    )


def announced(decisions: DataFrame, offers: DataFrame, needs_home: bool) -> DataFrame:
    """The decisions that may be announced: confirmed, not said to be sold, with positive prices, a discount, three sales or more, a provider and an address, and an offer that is still there.

    offers have key, market, url (as decisions name them), evidence and all_in. needs_home asks for a home value, else for a known basis.
    """
    good = (F.col("status") == "MULTIMARKET_CONFIRMED") & F.col("announce") & ~F.coalesce(F.col("is_sold"), F.lit(True)) & (F.least("offer", "external", "confirmed") > 0) & (F.col("discount") >= 0) & (F.col("sales") >= 3)
    if needs_home:
        good = good & (F.col("home") > 0) & (F.trim("provider") != "") & F.col("url").rlike("^https?://")
    else:
        good = good & F.col("basis").isin("EXTERNAL_ONLY", "HOME_PLUS_EXTERNAL")
    there = offers.where(F.col("evidence").isin(ACTIONABLE) & (F.col("all_in") > 0)).select(F.col("key").alias("_k"), F.lower(F.trim("market")).alias("_m"), F.trim("url").alias("_u")).distinct()
    return decisions.where(good).join(there, (F.col("key") == F.col("_k")) & (F.lower(F.trim("market")) == F.col("_m")) & (F.trim("url") == F.col("_u")), "left_semi")


def confirmation_order(actionable: Column, reviewed: Column, place: Column) -> list[Column]:
    """Sort keys by which bounded look-ups are spent: cards with an actionable offer, then those of a reviewed set, then as they come."""
    return [F.when(actionable, 0).otherwise(1), F.when(reviewed, 0).otherwise(1), place]


CARDS_SQL = """c as (select o_orderkey as k, o_orderkey % 17 > 0 as identity_ok, case when o_orderkey % 13 > 0 then round(o_totalprice / 1000, 2) end as offer, case o_orderkey % 5 when 0 then null when 1 then 0 else round(o_totalprice / 1000 * (1 + (o_custkey % 9) / 10.0::double), 2) end as home,
  case when o_orderkey % 7 > 0 then round(o_totalprice / 1000 * (1 + (o_custkey % 11) / 10.0::double), 2) end as e1, case when o_orderkey % 3 > 0 then round(o_totalprice / 1000 * (1 + (o_custkey % 8) / 10.0::double), 2) end as e2, o_custkey % 6 as sales from orders),
d as (select *, coalesce(greatest(e1, e2) / least(e1, e2) > 1.35 and e1 is not null and e2 is not null, false) as family_conflict from c),
x as (select *, case when not family_conflict then coalesce(e1, e2) end as external, case when home > 0 then home end as h from d)"""


def priced_cards(spark, sf_dir) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    unit = F.col("o_totalprice") / 1000
    times = lambda n: cents(unit * (1 + (F.col("o_custkey") % n) / F.lit(10.0)))
    side = lambda name, c, when: F.when(when, F.struct(F.lit(name).alias("provider"), c.alias("center"), (F.col("o_custkey") % 6).alias("sales")))
    family = external_of_family(side("first", times(11), k % 7 > 0), side("second", times(8), k % 3 > 0))
    home = F.when(k % 5 == 1, 0.0).when(k % 5 > 1, times(9))
    rows = o.select(k.alias("k"), (k % 17 > 0).alias("identity_ok"), F.when(k % 13 > 0, cents(unit)).alias("offer"), home.alias("home"), family["external"].alias("_e"), family["conflict"].alias("family_conflict"))
    return rows.select("k", "identity_ok", "offer", "home", F.col("_e.center").alias("external"), F.col("_e.sales").alias("sales"), F.col("_e.provider").alias("provider"), "family_conflict")


def _gate(blocked: str, name: str) -> str:
    return f"""{name} as (select *, case when not identity_ok then 'BLOCKED_IDENTITY' {blocked} when offer is null then 'NO_ACTIONABLE_ALL_IN_OFFER' when external is null then case when family_conflict then 'MARKET_CONFLICT_BLOCKED' else 'NO_EXTERNAL_CONFIRMATION' end
  when greatest(h, external) / least(h, external) > 1.25 and h is not null then 'MARKET_CONFLICT_BLOCKED' when (least(h, external) - offer) / least(h, external) * 100 + 1e-9 >= 30 then 'MULTIMARKET_CONFIRMED' else 'NO_GLOBAL_EDGE' end as status from x)"""


@query("NUM-31", sql=f"""
with {CARDS_SQL}, {_gate("when h is null then 'BLOCKED_FAIR_VALUE'", "g")} select k, status, status = 'MULTIMARKET_CONFIRMED' as announce, case when status in ('MULTIMARKET_CONFIRMED', 'NO_GLOBAL_EDGE') then least(h, external) end as confirmed from g""")
def confirmed_cards(spark, sf_dir):
    return confirmed(priced_cards(spark, sf_dir), True).select("k", "status", "announce", "confirmed")


@query("NUM-32", sql=f"""
with {CARDS_SQL}, {_gate("", "g")} select k, status, status = 'MULTIMARKET_CONFIRMED' as announce, case when status in ('MULTIMARKET_CONFIRMED', 'NO_GLOBAL_EDGE') then least(coalesce(h, external), external) end as confirmed,
  case when status in ('MULTIMARKET_CONFIRMED', 'NO_GLOBAL_EDGE') or (status = 'MARKET_CONFLICT_BLOCKED' and external is not null) then case when h is null then 'EXTERNAL_ONLY' else 'HOME_PLUS_EXTERNAL' end end as basis from g""")
def confirmed_marketplace_cards(spark, sf_dir):
    return confirmed(priced_cards(spark, sf_dir), False).select("k", "status", "announce", "confirmed", "basis")


@query("NUM-33", sql=f"""
with {CARDS_SQL}, s as (select k, home, external, round(offer * 1.1, 2) as landed from x where home is not null and offer is not null),
o as (select *, external > 0 as known, case when home > 0 then (home - landed) / home * 100 else 0 end as oh, (external - landed) / external * 100 as oe, ((home + external) / 2 - landed) / ((home + external) / 2) * 100 as og, home > 0 and greatest(home, external) / least(home, external) > 1.35 as conflict from s)
select k, case when external is null then 'HOME_ONLY_UNCONFIRMED' when conflict then 'MARKET_CONFLICT_BLOCKED' when oe + 1e-9 >= 20 and og + 1e-9 >= 20 then 'MULTIMARKET_CONFIRMED' else 'HOME_EDGE_NOT_GLOBAL' end as status,
  case when external is null then oh + 1e-9 >= 20 else not conflict and oe + 1e-9 >= 20 and og + 1e-9 >= 20 end as announce from o""")
def global_market_classes(spark, sf_dir):
    rows = priced_cards(spark, sf_dir).where("home is not null and offer is not null")
    made = global_market(F.col("home"), F.col("external"), cents(F.col("offer") * 1.1), 20.0)
    return rows.select("k", made["status"].alias("status"), made["announce"].alias("announce"))


@query("FLT-16", "FLT-17", sql=f"""
with {CARDS_SQL}, {_gate("", "g")}, o as (select distinct l_orderkey from lineitem where l_linestatus = 'O' and l_quantity > 10)
select k, coalesce(h > 0, false) and k % 3 > 0 and k % 19 > 0 as confirmed_too from g where status = 'MULTIMARKET_CONFIRMED' and k % 23 > 0 and sales >= 3 and k in (select l_orderkey from o)""")
def announced_cards(spark, sf_dir):
    """Confirmed cards whose offer is still there, and whether the stricter filter of the home market passes them too."""
    k = F.col("k")
    d = confirmed(priced_cards(spark, sf_dir).withColumn("provider", F.when(k % 3 > 0, F.col("provider")).otherwise(" ")), False)
    d = d.select("*", k.cast("string").alias("key"), F.lit("Ebay ").alias("market"), F.concat(F.when(k % 19 > 0, "https://x/").otherwise("ftp://x/"), k.cast("string")).alias("url"), F.when(k % 23 > 0, False).alias("is_sold"))
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    o = F.col("l_orderkey")
    there = line.select(o.cast("string").alias("key"), F.lit("ebay").alias("market"), F.concat(F.when(o % 19 > 0, "https://x/").otherwise("ftp://x/"), o.cast("string"), F.lit(" ")).alias("url"), F.when(F.col("l_linestatus") == "O", "FIXED_ASK").otherwise("AUCTION_SNAPSHOT").alias("evidence"), F.lit(1.0).alias("all_in"))
    both = announced(d, there, True).select(k.alias("_k"))
    return announced(d, there, False).join(both, k == F.col("_k"), "left").select("k", F.col("_k").isNotNull().alias("confirmed_too"))


@query("FLT-22", "FLT-23", sql="""
with s as (select event_id, ['ERROR', 'NO_MATCH', 'EXACT', null][event_id % 4 + 1] as c, ['MATCHED', 'RATE_LIMIT', 'AMBIGUOUS', null, 'CLEAN_NO_MATCH'][user_id % 5 + 1] as a, ['STALE_OR_UNDATED', 'odd', 'PROVIDER_ERROR'][event_id % 3 + 1] as b, event_type = 'purchase' as actionable, user_id % 2 = 0 as reviewed, ts::date as day from events)
select event_id, case when c = 'ERROR' then false when c = 'NO_MATCH' then true when a = 'MATCHED' then true when a = 'RATE_LIMIT' or a is null or b = 'PROVIDER_ERROR' then false else b = 'STALE_OR_UNDATED' end as done,
  (row_number() over (partition by day order by actionable desc, reviewed desc, event_id))::int as place from s""")
def evaluation_states(spark, sf_dir):
    """Whether candidates are done with, and the order in which a day's look-ups are spent on them."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    of = lambda n, *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (n % len(xs) + 1).cast("int"))
    done = evaluation_done(of(i, "ERROR", "NO_MATCH", "EXACT", None), of(u, "MATCHED", "RATE_LIMIT", "AMBIGUOUS", None, "CLEAN_NO_MATCH"), of(i, "STALE_OR_UNDATED", "odd", "PROVIDER_ERROR"))
    w = Window.partitionBy(F.to_date("ts")).orderBy(*confirmation_order(F.col("event_type") == "purchase", u % 2 == 0, i))
    return e.select("event_id", done.alias("done"), F.row_number().over(w).alias("place"))
