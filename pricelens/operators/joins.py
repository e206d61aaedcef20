"""Joins: latest row per key, existence, null-aware identity matching, unique lookups, pivots of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import LISTINGS_SQL, listings, sales, table, with_sales


def latest(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


@query("JOI-02", "JOI-05", sql="""
select c_custkey, c_name, o.o_orderkey, round(o.o_totalprice, 2) as o_totalprice, n_name from customer join nation on c_nationkey = n_nationkey
left join lateral (select * from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) o on true""")
def latest_order_of_customer(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    last = latest(o.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "c_name", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "n_name")


@query("JOI-03", sql="""
select p_partkey, p_name, p_brand, coalesce(n, 0) as n from part left join (select l_partkey, count(*) as n from lineitem group by l_partkey) on p_partkey = l_partkey
where p_name ilike '%ring%' or exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50 and l_discount >= 0.1)""")
def search_parts(spark, sf_dir):
    p, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    agg = line.groupBy("l_partkey").agg(F.count("l_partkey").alias("n"), F.max((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1)).alias("big"))
    rows = p.join(agg, F.col("p_partkey") == F.col("l_partkey"), "left").where(F.col("p_name").ilike("%ring%") | F.coalesce("big", F.lit(False)))
    return rows.select("p_partkey", "p_name", "p_brand", F.coalesce("n", F.lit(0)).alias("n"))


@query("JOI-04", sql="""
select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 and event_type <> 'purchase'""")
def unresolved_latest(spark, sf_dir):
    e = latest(table(spark, sf_dir, "events"), ["user_id"], F.col("ts").desc(), F.col("event_id").desc())
    return e.where("event_type <> 'purchase'").select("user_id", "event_id", "event_type")


@query("JOI-06", "SRC-29", sql="select event_id, user_id, event_type from events where event_type = 'view' order by ts desc, event_id limit 50 offset 100")
def paged_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id", "event_type", "ts")
    return e.orderBy(F.col("ts").desc(), "event_id").offset(100).limit(50).drop("ts")


def match_score(core: list[tuple[Column, Column, int]], others: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Score and label of a candidate against a target. Null is missing, not unequal: only known values conflict."""
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    hits = sum((F.when(both(a, b) & (a == b), w).otherwise(0) for a, b, w in core), F.lit(0))
    same = sum((F.when(both(a, b) & (a == b), 5).otherwise(0) for a, b in others), F.lit(0))
    against = sum((F.when(both(a, b) & (a != b), 1).otherwise(0) for a, b, *_ in [*core, *others]), F.lit(0))
    extra = sum((F.when(a.isNull() & b.isNotNull(), 1).otherwise(0) for a, b in others), F.lit(0))
    full = sum(w for _, _, w in core)
    score = hits + same - 20 * against
    label = F.when(against > 0, "rejected").when((hits == full) & (extra == 0), "exact").when(hits == full, "strong").when((hits >= 60) & (same > 0), "strong").otherwise("ambiguous")
    cap = F.when(label == "exact", F.least(score, F.lit(100))).when(label == "strong", F.least(score, F.lit(94))).otherwise(F.least(score, F.lit(79)))
    return F.greatest(cap, F.lit(0)).cast("int"), label


MATCHED = """
t as (select p_partkey as id, p_name as name, p_brand as brand, case when p_size % 5 = 0 then null else p_size % 10 end as size, case when p_partkey % 7 = 0 then null else p_type end as kind, case when p_partkey % 3 = 0 then null else p_size % 4 end as finish from part),
m as (select a.id as a, b.id as b, (case when a.name = b.name then 35 else 0 end + case when a.brand = b.brand then 30 else 0 end + case when a.size = b.size then 30 else 0 end) as hits,
   (case when a.kind = b.kind then 5 else 0 end + case when a.finish = b.finish then 5 else 0 end) as same,
   (case when a.name <> b.name then 1 else 0 end + case when a.brand <> b.brand then 1 else 0 end + case when a.size <> b.size then 1 else 0 end + case when a.kind <> b.kind then 1 else 0 end + case when a.finish <> b.finish then 1 else 0 end) as against,
   (case when a.kind is null and b.kind is not null then 1 else 0 end + case when a.finish is null and b.finish is not null then 1 else 0 end) as extra
  from t a join t b on a.name = b.name and a.brand = b.brand and a.id <> b.id),
lab as (select *, case when against > 0 then 'rejected' when hits = 95 and extra = 0 then 'exact' when hits = 95 then 'strong' when hits >= 60 and same > 0 then 'strong' else 'ambiguous' end as label from m)"""


@query("JOI-12", "JOI-13", "STR-47", "UDF-06", sql="with " + MATCHED.strip() + """
select a, b, greatest(0, least(hits + same - 20 * against, case label when 'exact' then 100 when 'strong' then 94 else 79 end))::int as score, label from lab""")
def identity_matches(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 10).alias("size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 4).alias("finish"),
    )
    x, y = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for s in "ab")
    rows = x.join(y, (F.col("a_name") == F.col("b_name")) & (F.col("a_brand") == F.col("b_brand")) & (F.col("a_id") != F.col("b_id")))
    pair = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    score, label = match_score([(*pair("name"), 35), (*pair("brand"), 30), (*pair("size"), 30)], [pair("kind"), pair("finish")])
    return rows.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), score.alias("score"), label.alias("label"))


@query("JOI-15", "FLT-18", sql="with " + MATCHED.strip() + """
select a, case when top < 75 then null when second is not null and top - second < 5 then null else b end as chosen from (
  select a, b, hits + same - 20 * against as top, lead(hits + same - 20 * against) over w as second, row_number() over w as k from lab window w as (partition by a order by hits + same - 20 * against desc, b)) where k = 1""")
def best_match(spark, sf_dir):
    """The best candidate, if it scores 75 and the next is not within 5."""
    p = table(spark, sf_dir, "part")
    t = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 10).alias("size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 4).alias("finish"),
    )
    x, y = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for s in "ab")
    rows = x.join(y, (F.col("a_name") == F.col("b_name")) & (F.col("a_brand") == F.col("b_brand")) & (F.col("a_id") != F.col("b_id")))
    known = lambda c: F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull()
    points = lambda c, w: F.when(known(c) & (F.col(f"a_{c}") == F.col(f"b_{c}")), w).when(known(c), -20).otherwise(0)
    rows = rows.withColumn("s", points("name", 35) + points("brand", 30) + points("size", 30) + points("kind", 5) + points("finish", 5))
    w = Window.partitionBy("a_id").orderBy(F.col("s").desc(), "b_id")
    rows = rows.withColumns({"second": F.lead("s").over(w), "k": F.row_number().over(w)}).where("k = 1")
    return rows.select(F.col("a_id").alias("a"), F.when((F.col("s") >= 75) & (F.col("second").isNull() | (F.col("s") - F.col("second") >= 5)), F.col("b_id")).alias("chosen"))


@query("JOI-16", sql="with " + LISTINGS_SQL.strip() + """
select listing_id, case when n is null then 'none' when n = 1 then 'exact' when m = 1 then 'by size' else 'ambiguous' end as resolution, case when n = 1 then one when m = 1 then two end as card
from listings l left join (select p_name, p_brand, count(*) as n, min(p_partkey) as one from part group by all) a on l.title = a.p_name and split_part(l.identity, '|', 1) = a.p_brand
left join (select p_name, p_brand, p_size, count(*) as m, min(p_partkey) as two from part group by all) b on l.title = b.p_name and split_part(l.identity, '|', 1) = b.p_brand and l.size = b.p_size""")
def unique_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = p.groupBy("p_name", "p_brand").agg(F.count("p_partkey").alias("n"), F.min("p_partkey").alias("one"))
    two = p.groupBy("p_name", "p_brand", "p_size").agg(F.count("p_partkey").alias("m"), F.min("p_partkey").alias("two")).withColumnsRenamed({"p_name": "n2", "p_brand": "b2"})
    l = listings(spark, sf_dir).withColumn("brand", F.split_part("identity", F.lit("|"), F.lit(1)))
    rows = l.join(one, (F.col("title") == F.col("p_name")) & (F.col("brand") == F.col("p_brand")), "left").join(two, (F.col("title") == F.col("n2")) & (F.col("brand") == F.col("b2")) & (F.col("size") == F.col("p_size")), "left")
    how = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "exact").when(F.col("m") == 1, "by size").otherwise("ambiguous")
    return rows.select("listing_id", how.alias("resolution"), F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("two")).alias("card"))


def recovered_two_of_three(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows with card and recovery: name and number find a card whose set is missing, set and name one whose number is missing.

    rows and catalogue have name, set and number (the catalogue also card). A row without a name, with both or with neither of the others
    is not for this rule: one coordinate alone never finds a card. More than one card for the pair is ambiguous. The
    catalogue is counted by pair before it meets the rows, so that a common pair is one row.
    """
    one = lambda *by: catalogue.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count_distinct("card").alias("_n"), F.min("card").alias("_card"))
    how = F.when(F.col("name").isNull(), None).when(F.col("set").isNull() & F.col("number").isNotNull(), "by number").when(F.col("set").isNotNull() & F.col("number").isNull(), "by set")
    r = rows.withColumn("_how", how)
    numbered = r.join(one("name", "number"), (F.col("_how") == "by number") & (F.col("name") == F.col("_name")) & (F.col("number") == F.col("_number")), "left").drop("_name", "_number").withColumnsRenamed({"_n": "_n1", "_card": "_c1"})
    both = numbered.join(one("set", "name"), (F.col("_how") == "by set") & (F.col("name") == F.col("_name")) & (F.col("set") == F.col("_set")), "left").drop("_name", "_set")
    n = F.coalesce("_n1", "_n", F.lit(0))
    state = F.when(F.col("_how").isNull(), "not applicable").when(n == 0, "none").when(n > 1, "ambiguous").otherwise(F.col("_how"))
    return both.select(*rows.columns, F.when(n == 1, F.coalesce("_c1", "_card")).alias("card"), state.alias("recovery"))


@query("JOI-22", sql="""
with c as (select p_partkey as card, p_name as name, p_brand as set, p_size::varchar || '/' || (p_partkey % 400)::varchar as number from part),
l as (select l_orderkey, l_linenumber, case when l_suppkey % 10 > 0 then name end as name, case when l_linenumber % 4 in (1, 2) then set end as set, case when l_linenumber % 4 in (0, 2) then number end as number from lineitem join c on card = l_partkey),
w as (select *, case when name is null then null when set is null and number is not null then 'by number' when set is not null and number is null then 'by set' end as how from l),
n as (select name, number, count(distinct card) as n, min(card) as card from c group by all), s as (select name, set, count(distinct card) as n, min(card) as card from c group by all),
j as (select l_orderkey, l_linenumber, how, coalesce(n.n, s.n, 0) as k, coalesce(n.card, s.card) as card from w left join n on how = 'by number' and n.name = w.name and n.number = w.number left join s on how = 'by set' and s.name = w.name and s.set = w.set)
select l_orderkey, l_linenumber, case when k = 1 then card end as card, case when how is null then 'not applicable' when k = 0 then 'none' when k > 1 then 'ambiguous' else how end as recovery from j""")
def two_of_three(spark, sf_dir):
    """Lines as rows that name a part by two of name, brand and number, by one of them, or by all."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card"), F.col("p_name").alias("name"), F.col("p_brand").alias("set"), F.concat_ws("/", F.col("p_size").cast("string"), (F.col("p_partkey") % 400).cast("string")).alias("number"))
    k = F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").join(c, F.col("l_partkey") == F.col("card")).select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 10 > 0, F.col("name")).alias("name"), F.when(k.isin(1, 2), F.col("set")).alias("set"), F.when(k.isin(0, 2), F.col("number")).alias("number")
    )
    return recovered_two_of_three(rows, c).select("l_orderkey", "l_linenumber", "card", "recovery")


#: Aliases of the part types used as set names.
ALIASES = [("std", ["STANDARD", "STD"]), ("eco", ["ECONOMY", "ECON"]), ("sml", ["SMALL", "S"]), ("big", ["LARGE", "BIG"])]


@query("JOI-25", "JOI-20", "STR-06", sql="""
select p_partkey, s.id as set_id from part left join (values ('std', ['STANDARD', 'STD']), ('eco', ['ECONOMY', 'ECON']), ('sml', ['SMALL', 'S']), ('big', ['LARGE', 'BIG'])) s(id, aliases) on list_contains(s.aliases, p_type)""")
def alias_lookup(spark, sf_dir):
    sets = spark.createDataFrame(ALIASES, "set_id string, aliases array<string>").select("set_id", F.explode("aliases").alias("alias"))
    return table(spark, sf_dir, "part").join(sets, F.col("p_type") == F.col("alias"), "left").select("p_partkey", "set_id")


@query("JOI-31", "JOI-30", sql="""
select a.p_name, a.p_brand as first_brand, b.p_brand as second_brand, count(*) as n from part a join part b on a.p_name = b.p_name and a.p_type = b.p_type and a.p_brand < b.p_brand and a.p_size = b.p_size group by all""")
def cross_locale_cards(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select(F.col("p_name").alias("n2"), F.col("p_type").alias("t2"), F.col("p_size").alias("s2"), F.col("p_brand").alias("second_brand"))
    rows = p.join(other, (F.col("p_name") == F.col("n2")) & (F.col("p_type") == F.col("t2")) & (F.col("p_size") == F.col("s2")) & (F.col("p_brand") < F.col("second_brand")))
    return rows.groupBy("p_name", F.col("p_brand").alias("first_brand"), "second_brand").agg(F.count("n2").alias("n"))


@query("JOI-14", "JOI-35", "SET-02", "SET-06", sql="""
select c_mktsegment, count(*) filter (with_order) as active, count(*) filter (not with_order) as idle from (select *, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as with_order from customer) group by c_mktsegment""")
def semi_and_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    active = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("c_custkey").alias("active"))
    idle = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("c_custkey").alias("idle"))
    return active.join(idle, "c_mktsegment", "full_outer").select("c_mktsegment", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("active", "idle")])


@query("JOI-01", "AGG-10", "NST-01", sql="""
select user_id, max(value) filter (event_type = 'view') as view, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'purchase') as purchase, max((props::json->>'k')::int) as k from events group by user_id""")
def claim_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    v = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value"))).alias(kind)
    return e.groupBy("user_id").agg(v("view"), v("click"), v("purchase"), F.max("k").alias("k"))


@query("AGG-49", "AGG-48", sql="""
select (select count(*) from lineitem) as sales, (select count(*) from part) as cards, (select count(*) from orders where o_orderstatus = 'O') as open_orders, (select count(distinct user_id) from events) as users, (select count(*) from supplier) as sellers, (select max(l_shipdate) from lineitem) as newest""")
def dashboard(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = t("lineitem").agg(F.count("l_orderkey").alias("sales"), F.max("l_shipdate").alias("newest"))
    for df in (t("part").agg(F.count("p_partkey").alias("cards")), t("orders").where("o_orderstatus = 'O'").agg(F.count("o_orderkey").alias("open_orders")), t("events").agg(F.count_distinct("user_id").alias("users")), t("supplier").agg(F.count("s_suppkey").alias("sellers"))):
        out = out.join(df, F.lit(True))  # one row each
    return out


@query("AGG-44", sql="""
select user_id, case when n >= 2 and (second is null or n > second) then event_type end as winner from (
  select user_id, event_type, n, row_number() over w as k, lead(n) over w as second from (select user_id, event_type, count(*) as n from events group by all) window w as (partition by user_id order by n desc, event_type)) where k = 1""")
def plurality_vote(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("event_id").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type")
    v = v.withColumns({"k": F.row_number().over(w), "second": F.lead("n").over(w)}).where("k = 1")
    return v.select("user_id", F.when((F.col("n") >= 2) & (F.col("second").isNull() | (F.col("n") > F.col("second"))), F.col("event_type")).alias("winner"))


@query("AGG-45", "AGG-46", "AGG-47", "AUD-09", sql="""
select bucket, o_orderstatus as market, count(*) as n from (select *, case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'identity' when o_orderpriority like '3%' then 'price' else 'other' end as bucket from orders) group by all""")
def rejection_buckets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    bucket = F.when(F.col("o_orderpriority").rlike("^[12]"), "identity").when(F.col("o_orderpriority").rlike("^3"), "price").otherwise("other")
    return o.groupBy(bucket.alias("bucket"), F.col("o_orderstatus").alias("market")).agg(F.count("o_orderkey").alias("n"))


@query(sql=with_sales("""
select l.listing_id, l.identity, round(f.m, 6) as fair, s.seller_price is not null as has_own from listings l left join (select identity, median(price) as m from sales group by identity) f using (identity)
left join (select part_id, min(price) as seller_price from sales where grader = 'N' group by part_id) s on l.listing_id = s.part_id""", LISTINGS_SQL))
def cards_with_fair_value(spark, sf_dir):
    s = sales(spark, sf_dir)
    fair = s.groupBy("identity").agg(F.median("price").alias("m"))
    own = s.where("grader = 'N'").groupBy("part_id").agg(F.min("price").alias("own"))
    rows = listings(spark, sf_dir).join(fair, "identity", "left").join(own, F.col("listing_id") == F.col("part_id"), "left")
    return rows.select("listing_id", "identity", F.round("m", 6).alias("fair"), F.col("own").isNotNull().alias("has_own"))
