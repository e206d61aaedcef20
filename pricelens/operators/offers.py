"""Cards with their offers in a bound, the offer that a decision meant, and proof of what identifies a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import table

#: Evidence that can be bought: a fixed ask, or an auction in its last minutes.
ACTIONABLE = ["FIXED_ASK", "AUCTION_SNAPSHOT_LE5"]


def bounded_offers(listings: DataFrame, key: str, order: list[Column], fields: list[str], most: int) -> DataFrame:
    """key, offers (structs of fields, the first `most` in order), n and n_more (offers beyond).

    Ranks are cut to `most` in each task before the shuffle, counts are summed there too: no task holds all offers of a card.
    Rows without a key are no card's. order must tell the offers of a card apart.
    """
    rows = listings.where(F.col(key).isNotNull())
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most)
    kept = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_k", *fields))).alias("_o"))
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    shown = F.transform("_o", lambda o: F.struct(*[o[c].alias(c) for c in fields]))
    return kept.join(counts, F.col(key) == F.col("_key")).select(key, shown.alias("offers"), "n", (F.col("n") - F.size("_o")).alias("n_more"))


def cards_of(listings: DataFrame, fair: DataFrame, most: int = 50) -> DataFrame:
    """A card for each key of proven and complete listings: key, offers, n, n_more and fair_value (null if unknown or not above zero).

    listings have key, proven, complete, place (their order), market, evidence, url, price and all_in (null: its cost is unknown); fair has key and value.
    """
    offers = bounded_offers(listings.where("proven and complete"), "key", [F.col("place")], ["market", "evidence", "url", "price", "all_in"], most)
    value = fair.where("value > 0").groupBy(F.col("key").alias("_key")).agg(F.max("value").alias("_value"))
    return offers.join(value, F.col("key") == F.col("_key"), "left").select("key", "offers", "n", "n_more", F.round("_value", 2).alias("fair_value"))


def offers_meant(decisions: DataFrame, listings: DataFrame) -> DataFrame:
    """decisions (key, market, url, ...) with offer: the place of the first actionable listing of that card, market and address that has a cost.

    Markets are compared without case and outer spaces, addresses without outer spaces. All listings are searched, not only
    those that a card shows; the first of equal ones is found by a sum of the listings before they meet the decisions.
    """
    market, url = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))), lambda c: F.trim(F.coalesce(c, F.lit("")))
    can = listings.where("proven and complete").where(F.col("evidence").isin(ACTIONABLE) & (F.col("all_in") > 0))
    first = can.groupBy(F.col("key").alias("_k"), market(F.col("market")).alias("_m"), url(F.col("url")).alias("_u")).agg(F.min("place").alias("offer"))
    same = (F.col("key") == F.col("_k")) & (market(F.col("market")) == F.col("_m")) & (url(F.col("url")) == F.col("_u"))
    return decisions.join(first, same, "left").drop("_k", "_m", "_u")


#: What identifies a card, and what of it every card must have.
DIMENSIONS = ["set", "collector_number", "language", "condition", "edition", "finish", "special_finish", "printing", "variant"]
REQUIRED = ["set", "collector_number", "language", "condition", "finish"]
OPTIONAL = ["edition", "special_finish", "printing", "variant"]


def provenance(provider: Column, catalogue: Column) -> Column:
    """Who proves each dimension: PROVIDER before CATALOG, else UNKNOWN. Maps may be null or lack keys; an empty value proves nothing."""
    empty = F.create_map().cast("map<string,string>")
    all_keys = F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*[F.lit("UNKNOWN")] * len(DIMENSIONS)))
    has = lambda v: F.coalesce(v, F.lit("")) != ""
    proven = F.map_zip_with(F.coalesce(provider, empty), F.coalesce(catalogue, empty), lambda k, p, c: F.when(has(p), "PROVIDER").when(has(c), "CATALOG").otherwise("UNKNOWN"))
    return F.map_filter(F.map_zip_with(all_keys, proven, lambda k, none, who: F.coalesce(who, none)), lambda k, v: k.isin(DIMENSIONS))


def required_dimensions(listing: Column) -> Column:
    """What must be proven for a listing: the base, and each optional dimension that it names (edition also where an edition applies)."""
    named = lambda k: F.coalesce(F.try_element_at(listing, F.lit(k)), F.lit("")) != ""
    applies = F.lower(F.coalesce(F.try_element_at(listing, F.lit("edition_applicable")), F.lit(""))).isin("", "false")
    more = [F.when(named(k) | (~applies if k == "edition" else F.lit(False)), F.lit(k)) for k in OPTIONAL]
    return F.concat(F.array(*map(F.lit, REQUIRED)), F.filter(F.array(*more), lambda k: k.isNotNull()))


def unproven(who: Column, required: Column) -> Column:
    """The required dimensions that nobody proves, in their order; no requirements mean the base."""
    needed = F.when(F.coalesce(F.size(required), F.lit(0)) > 0, required).otherwise(F.array(*map(F.lit, REQUIRED)))
    return F.filter(needed, lambda k: ~F.coalesce(F.try_element_at(who, k), F.lit("UNKNOWN")).isin("PROVIDER", "CATALOG"))


def strong_enough(who: Column, required: Column) -> Column:
    """Whether an estimate may count for a strong consensus: every required dimension is proven."""
    needed = F.when(F.coalesce(F.size(required), F.lit(0)) > 0, required).otherwise(F.array(*map(F.lit, REQUIRED)))
    return F.forall(needed, lambda k: F.coalesce(F.try_element_at(who, k), F.lit("UNKNOWN")).isin("PROVIDER", "CATALOG"))


OFFER_SQL = """offers as (select l_partkey, l_orderkey * 8 + l_linenumber as place, l_suppkey, l_extendedprice, p_brand || '|' || p_type as key, ['Ebay ', 'COMC', 'magi'][l_suppkey % 3 + 1] as market,
  ['FIXED_ASK', 'AUCTION_SNAPSHOT', 'AUCTION_SNAPSHOT_LE5'][l_linenumber % 3 + 1] as evidence, 'https://x/' || l_partkey as url, round(l_extendedprice, 2) as price, case when l_linenumber % 5 > 0 then round(l_extendedprice * 1.1::double, 2) end as all_in from lineitem join part on l_partkey = p_partkey where l_tax < 0.07 and l_quantity > 2)"""


def offer_rows(spark, sf_dir) -> DataFrame:
    """Lines as offers of a brand and type, some without proof, some incomplete, some of unknown cost. Places repeat where lines do."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("key"))
    of = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "key", (F.col("l_tax") < 0.07).alias("proven"), (F.col("l_quantity") > 2).alias("complete"), (F.col("l_orderkey") * 8 + line).alias("place"), of(F.col("l_suppkey"), "Ebay ", "COMC", "magi").alias("market"),
        of(line, "FIXED_ASK", "AUCTION_SNAPSHOT", "AUCTION_SNAPSHOT_LE5").alias("evidence"), F.concat(F.lit("https://x/"), F.col("l_partkey").cast("string")).alias("url"), F.round("l_extendedprice", 2).alias("price"), F.when(line % 5 > 0, F.round(F.col("l_extendedprice") * 1.1, 2)).alias("all_in"),
    )


@query("NST-06", "JOI-32", sql=f"""
with {OFFER_SQL}, r as (select *, row_number() over (partition by key order by place, price, url) as k, count(*) over (partition by key) as n from offers),
f as (select p_brand || '|' || p_type as key, max(p_retailprice) as value from part where p_size < 30 group by 1)
select r.key, string_agg(k || ':' || place || ':' || evidence || ':' || url || ':' || coalesce((all_in > 0)::varchar, 'unknown'), ';' order by k) as offers, max(n) as n, max(n) - count(*) as n_more, round(max(value), 2) as fair_value from r left join f on f.key = r.key where k <= 10 group by r.key""")
def cards_with_offers(spark, sf_dir):
    """Cards with ten offers at most, the count of the others, and a fair value where one is known."""
    rows = offer_rows(spark, sf_dir).where("proven and complete")
    offers = bounded_offers(rows, "key", [F.col("place"), F.col("price"), F.col("url")], ["place", "market", "evidence", "url", "price", "all_in"], 10)
    fair = table(spark, sf_dir, "part").where("p_size < 30").select(F.concat_ws("|", "p_brand", "p_type").alias("_key"), F.col("p_retailprice").alias("value")).groupBy("_key").agg(F.max("value").alias("value"))
    cost = lambda o: F.coalesce((o["all_in"] > 0).cast("string"), F.lit("unknown"))
    shown = F.transform("offers", lambda o, i: F.concat_ws(":", (i + 1).cast("string"), o["place"].cast("string"), o["evidence"], o["url"], cost(o)))
    return offers.join(fair, F.col("key") == F.col("_key"), "left").select("key", F.array_join(shown, ";").alias("offers"), "n", F.col("n_more").cast("long").alias("n_more"), F.round("value", 2).alias("fair_value"))


@query("JOI-33", sql=f"""
with {OFFER_SQL}, d as (select p_partkey, p_brand || '|' || p_type as key, ['EBAY', ' comc', 'magi', 'other'][p_partkey % 4 + 1] as market, ' https://x/' || p_partkey as url from part)
select p_partkey, min(place) as offer from d left join offers o on o.key = d.key and lower(trim(o.market)) = lower(trim(d.market)) and o.url = trim(d.url) and evidence <> 'AUCTION_SNAPSHOT' and all_in > 0 group by p_partkey""")
def matching_offers(spark, sf_dir):
    """For a decision on each part the offer that it meant."""
    k = F.col("p_partkey")
    of = F.element_at(F.array(F.lit("EBAY"), F.lit(" comc"), F.lit("magi"), F.lit("other")), (k % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select(k, F.concat_ws("|", "p_brand", "p_type").alias("key"), of.alias("market"), F.concat(F.lit(" https://x/"), k.cast("string")).alias("url"))
    return offers_meant(d, offer_rows(spark, sf_dir)).select("p_partkey", "offer")


@query("FLT-15", "NST-10", "NST-11", sql="""
with p as (select p_partkey as k, p_size as s from part),
w as (select k, [x for x in ['set', 'collector_number', 'language', 'condition', 'finish', case when k % 4 = 0 or k % 6 = 1 then 'edition' end, case when k % 9 = 0 then 'variant' end] if x is not null] as needed,
  [x for x in ['set', case when s % 3 > 0 then 'collector_number' end, case when s % 5 > 0 then 'finish' end] if x is not null] as by_provider,
  [x for x in ['set', case when k % 7 > 0 then 'language' end, 'condition', case when k % 8 > 0 then 'edition' end, case when s % 2 = 0 then 'collector_number' end] if x is not null] as by_catalogue from p)
select k as p_partkey, array_to_string([x for x in needed if not list_contains(by_provider, x) and not list_contains(by_catalogue, x)], ',') as unproven, list_has_all(list_concat(by_provider, by_catalogue), needed) as strong,
  len(by_provider)::int as from_provider, len([x for x in by_catalogue if not list_contains(by_provider, x)])::int as from_catalogue from w""")
def dimension_provenance(spark, sf_dir):
    """Proof of a part's dimensions by provider and catalogue, what a listing requires, and what nobody proves."""
    k, s = F.col("p_partkey"), F.col("p_size")
    one = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in kv.values()]))
    provider = one(set="Base", collector_number=F.when(s % 3 > 0, s), finish=F.when(s % 5 > 0, "holo").otherwise(""), colour="red")
    catalogue = one(set="Base", language=F.when(k % 7 > 0, "en"), condition="NM", edition=F.when(k % 8 > 0, "1st"), collector_number=F.when(s % 2 == 0, s))
    listing = one(edition=F.when(k % 4 == 0, "1st").otherwise(""), edition_applicable=F.when(k % 6 == 1, "true").when(k % 6 == 2, "False"), variant=F.when(k % 9 == 0, "glow"))
    p = table(spark, sf_dir, "part").select(k, provenance(provider, catalogue).alias("who"), required_dimensions(listing).alias("needed"))
    n = lambda name: F.size(F.map_filter("who", lambda k, v: v == name))
    return p.select("p_partkey", F.array_join(unproven(F.col("who"), F.col("needed")), ",").alias("unproven"), strong_enough(F.col("who"), F.col("needed")).alias("strong"), n("PROVIDER").alias("from_provider"), n("CATALOG").alias("from_catalogue"))
