"""Gates that say why they do not open, confirmations of prices, and what is announced."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pricelens import queries
from pricelens.functions import proofs
from pricelens.operators import confirmations


def test_items_end_in_a_state(spark):
    good = "Category: Pokémon\nRéférence: #4/102"
    rows = [("Pikachu", good), ("Pikachu", "Catégorie Pokemon\nArticle Gradation Détails"), ("PSA 10", good), (None, good), ("Pikachu", "Pokémon 4/102"), ("Pikachu", good + "\nbooster"), ("Pikachu", "Category: Pokemon 4/102"), ("Pikachu", None)]
    got = [r.s for r in spark.createDataFrame(rows, "t string, b string").select(proofs.item_state(F.col("t"), F.col("b")).alias("s")).collect()]
    assert got == ["CARD", "CARD", "PARSE_FAILURE", "PARSE_FAILURE", "EXCLUDED_BY_RULES", "EXCLUDED_BY_RULES", "UNSUPPORTED", "EXCLUDED_BY_RULES"]
    blobs = spark.createDataFrame([("POKÉMON • French",), ("Pokemon display",), ("Pokemons",), (None,)], "b string")
    assert [r.s for r in blobs.select(proofs.is_card_listing(F.col("b")).alias("s")).collect()] == [True, False, False, False]


def test_identities_that_suffice(spark):
    rows = [("PSA", "9", "Mew", "4/102", None, None, None), ("PSA", "9", "Mew", "#", "1999", "Base", "fr"), ("PSA", "9", "Mew", None, "1999", "Base", None), ("PSA", None, "Mew", "4", None, None, None), ("", "9", "Mew", "4", None, None, None), ("PSA", "9", "--", "4", None, None, None)]
    df = spark.createDataFrame(rows, "g string, n string, c string, r string, y string, s string, l string")
    assert [r.s for r in df.select(proofs.sufficient(*map(F.col, "gncrysl")).alias("s")).collect()] == [True, True, False, False, False, False]
    rows = [("Mew", "Base", "4/102", "JA", "PSA", "9"), ("Mew", "Base", " # ", "ja", "PSA", "9"), ("Mew", "!", "4", "ja", "PSA", "9"), ("Mew", "Base", "4", None, "PSA", "9"), ("Mew", "Base", "4", "ja", "PSA", " ")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    assert [r.s for r in df.select(proofs.complete(*map(F.col, "abcdef")).alias("s")).collect()] == [True, False, False, False, False]
    spoken = spark.createDataFrame([("Japanese",), (" EN",), ("anglais",), ("fr",), (None,), ("",)], "l string")
    assert [r.s for r in spoken.select(proofs.actionable_language(F.col("l")).alias("s")).collect()] == [True, True, True, False, False, False]


def test_an_ask_proves_its_card(spark):
    card = ("ピカチュウ", "Base Set", "25/102", 1999, "1st Edition", "Shadowless", None)
    good = "Base Set #025/102 PSA10 日本版 1st Edition Shadowless"
    cases = [
        (good, None, "proven"), (good, "Related items: auction", "proven"), (good + " auction", None, "ongoing auction"), ("まとめ売り " + good, "", "several items"), (good.replace("025", "026"), None, "number unproven"), (good.replace("10 ", "9 "), None, "grade unproven"),
        (good.replace("日本版", "english"), None, "language unproven"), (good.replace("Base Set", "x"), None, "card or set unproven"), ("ピカチュウex 25/102 PSA 10 JP 1st edition shadowless", None, "proven"), (good.replace("1st Edition", ""), None, "edition unproven"), (good.replace("Shadowless", "Shadow"), None, "variant unproven"), (None, None, "number unproven"),
    ]
    df = spark.createDataFrame([(i, *card, t, x) for i, (t, x, _) in enumerate(cases)], "i int, name string, set string, number string, year int, edition string, attribute string, variety string, title string, text string")
    got = proofs.ask_proofs(df, F.col("title"), F.col("text"), {c: F.col(c) for c in ("name", "set", "number", "year", "edition", "attribute", "variety")}).orderBy("i").collect()
    assert [r.proof for r in got] == [c[2] for c in cases]
    modern = spark.createDataFrame([(2010, "Unlimited", "x Base Set 25/102 PSA 10 jp"), (2010, "Promo", "x Base Set 25/102 PSA 10 jp"), (2003, "Unlimited", "x Base Set 25/102 PSA 10 jp")], "year int, edition string, title string")
    made = proofs.ask_proofs(modern, F.col("title"), F.lit(None).cast("string"), {"name": F.lit("y"), "set": F.lit("base set"), "number": F.lit("25/102"), "year": F.col("year"), "edition": F.col("edition")})
    assert [r.proof for r in made.collect()] == ["proven", "edition unproven", "edition unproven"]


def test_strict_proof_needs_every_part(spark):
    cases = [("Pokémon Base Set Pikachu 025/102 PSA 10 JPN Shadowless", "proven"), ("", "empty text"), (None, "empty text"), ("Pikachu Base Set 25/102 PSA 10 jpn", "variant unproven: shadowless"), ("Pikachu 25/102 PSA 10 jpn shadowless", "set unproven"), ("Base Set 25/102 PSA 10 jpn", "name unproven"), ("Pikachu Base Set 25/102 PSA 10", "language unproven"), ("Pikachu Base Set 25/102", "grade unproven"), ("Pikachu 25", "number unproven")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    card = {"name": F.lit("Pikachu"), "set": F.lit("Base-Set"), "number": F.lit("#25/0102"), "variety": F.lit("Shadowless!")}
    assert [r.proof for r in proofs.strict_proofs(df, F.col("t"), card).orderBy("i").collect()] == [c[1] for c in cases]


CARD = "identity_ok boolean, offer double, home double, external double, sales int, family_conflict boolean"


def test_other_markets_confirm_the_lower_value(spark):
    rows = [
        (True, 60.0, 100.0, 110.0, 5, False), (True, 80.0, 100.0, 110.0, 5, False), (True, 60.0, 100.0, 126.0, 5, False), (True, 60.0, None, 100.0, 5, False), (True, 60.0, 0.0, 100.0, 5, False), (True, 60.0, 100.0, None, None, True), (True, 60.0, 100.0, None, None, False), (True, None, 100.0, 100.0, 5, False),
        (False, 60.0, 100.0, 100.0, 5, False), (True, 70.0, 100.0, 125.0, 5, False),
    ]
    df = spark.createDataFrame(rows, CARD).coalesce(1)
    strict = confirmations.confirmed(df, True).collect()
    assert [r.status for r in strict] == ["MULTIMARKET_CONFIRMED", "NO_GLOBAL_EDGE", "MARKET_CONFLICT_BLOCKED", "BLOCKED_FAIR_VALUE", "BLOCKED_FAIR_VALUE", "MARKET_CONFLICT_BLOCKED", "NO_EXTERNAL_CONFIRMATION", "NO_ACTIONABLE_ALL_IN_OFFER", "BLOCKED_IDENTITY", "MULTIMARKET_CONFIRMED"]
    assert (strict[0].confirmed, strict[0].discount, strict[0].ratio) == (100.0, 40.0, 1.1) and strict[9].discount == 30.0 and strict[2].confirmed is None and strict[2].ratio == 1.26
    open_ = confirmations.confirmed(df, False).collect()
    assert [(r.status, r.basis) for r in open_[3:5]] == [("MULTIMARKET_CONFIRMED", "EXTERNAL_ONLY")] * 2 and open_[0].basis == "HOME_PLUS_EXTERNAL"


def test_two_providers_of_a_family_speak_once(spark):
    side = "struct<provider:string,center:double,sales:int>"
    rows = [(("a", 100.0, 3), ("b", 120.0, 4)), (("a", 100.0, 3), ("b", 136.0, 4)), (None, ("b", 120.0, 4)), (("a", 1.0, 3), None), (None, None)]
    df = spark.createDataFrame(rows, f"x {side}, y {side}")
    of = confirmations.external_of_family(F.col("x"), F.col("y"))
    assert [(r.p, r.c) for r in df.select(of["external"]["provider"].alias("p"), of["conflict"].alias("c")).collect()] == [("a", False), (None, True), ("b", False), ("a", False), (None, False)]


def test_three_discounts(spark):
    rows = [(100.0, None, 70.0), (100.0, 0.0, 90.0), (100.0, 140.0, 60.0), (100.0, 110.0, 80.0), (100.0, 90.0, 80.0), (0.0, 100.0, 70.0)]
    df = spark.createDataFrame(rows, "h double, e double, l double").coalesce(1)
    made = confirmations.global_market(F.col("h"), F.col("e"), F.col("l"), 20.0)
    got = [(r.status, r.announce, r.off_home, r.off_external, r.off_global, r.priority) for r in df.select(*[c.alias(n) for n, c in made.items()]).collect()]
    assert got == [
        ("HOME_ONLY_UNCONFIRMED", True, 30.0, None, 30.0, "default"), ("HOME_ONLY_UNCONFIRMED", False, 10.0, None, 10.0, "default"), ("MARKET_CONFLICT_BLOCKED", False, 40.0, 57.1, 50.0, "default"), ("MULTIMARKET_CONFIRMED", True, 20.0, 27.3, 23.8, "high"), ("HOME_EDGE_NOT_GLOBAL", False, 20.0, 11.1, 15.8, "default"),
        ("HOME_EDGE_NOT_GLOBAL", False, 0.0, 30.0, -40.0, "default"),
    ]


def test_evaluations_end_or_are_tried_again(spark):
    rows = [("ERROR", "MATCHED", "MATCHED"), ("BUDGET", None, None), ("NO_MATCH", "RATE_LIMIT", None), ("AMBIGUOUS", None, None), ("EXACT", "MATCHED", "RATE_LIMIT"), ("EXACT", "CLEAN_NO_MATCH", "RATE_LIMIT"), ("EXACT", "CLEAN_NO_MATCH", "AMBIGUOUS"), ("EXACT", "CLEAN_NO_MATCH", "odd"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, a string, b string").coalesce(1)
    assert [r.d for r in df.select(confirmations.evaluation_done(F.col("c"), F.col("a"), F.col("b")).alias("d")).collect()] == [False, False, True, True, True, False, True, False, False]


def test_only_whole_decisions_are_announced(spark):
    base = dict(key="k", market="ebay", url="https://x", status="MULTIMARKET_CONFIRMED", announce=True, is_sold=False, offer=1.0, external=2.0, confirmed=2.0, home=2.0, discount=50.0, sales=3, provider="p", basis="HOME_PLUS_EXTERNAL")
    changes = [{}, {"status": "NO_GLOBAL_EDGE"}, {"announce": False}, {"is_sold": True}, {"is_sold": None}, {"external": 0.0}, {"discount": -1.0}, {"sales": 2}, {"key": "z"}, {"market": "EBAY "}, {"home": None}, {"provider": " "}, {"url": "ftp://x"}, {"basis": "?"}]
    rows = [{**base, **c, "n": i} for i, c in enumerate(changes)]
    schema = "key string, market string, url string, status string, announce boolean, is_sold boolean, offer double, external double, confirmed double, home double, discount double, sales int, provider string, basis string, n int"
    offers = spark.createDataFrame([("k", " Ebay", "https://x ", "FIXED_ASK", 1.0), ("k", "ebay", "ftp://x", "FIXED_ASK", 1.0), ("z", "ebay", "https://x", "AUCTION_SNAPSHOT", 1.0), ("z", "ebay", "https://x", "FIXED_ASK", None)], "key string, market string, url string, evidence string, all_in double")
    d = spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema)
    assert sorted(r.n for r in confirmations.announced(d, offers, True).collect()) == [0, 9, 13]
    assert sorted(r.n for r in confirmations.announced(d, offers, False).collect()) == [0, 9, 10, 11, 12]


@pytest.mark.parametrize("name", ["announced_cards", "confirmed_cards", "confirmed_marketplace_cards"])
def test_prices_between_two_cents_are_rounded_as_in_the_sql(spark, tmp_path, name):
    """At these totals a card's centres lie between two cents, and their ratio at the bound of 1.25 turns with the rounding."""
    totals = [1067.5, 1077.5, 1087.5, 1192.5, 1202.5, 1212.5, 1222.5, 75465.0, 112845.0, 1005.0, 4935.0, 97.5]
    orders = [(k, 87 + 792 * (k // 60) if k % 2 else k, totals[k % len(totals)]) for k in range(600)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "O", 20.0) for k in range(600)], "l_orderkey long, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
