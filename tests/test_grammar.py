"""Titles read by their grammar, offers in bounds, proof by dimension, audits and weighted titles."""

import json

from pyspark.sql import functions as F

from pricelens.functions import grammar
from pricelens.operators import offers, titles
from pricelens.sources import audits
from pricelens.sources.state import load, shared_folder


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return grammar.coordinates(df, "t").orderBy("i").collect()


def test_titles_of_the_fixed_form(spark):
    got = parsed(
        spark, "2023 Pokemon Japanese Scarlet & Violet Raging Surf AR Groudon #69 PSA 10 GEM MINT", "2023 Pokemon English Scarlet & Violet 151 Illustration Rare Psyduck #175 PSA 9 MINT",
        "2023 Pokemon Scarlet & Violet Raging Surf AR Groudon #69 PSA 10 GEM MINT", "2023 Pokemon Japanese Scarlet & Violet Raging Surf Groudon #69 PSA 10 GEM MINT", "2023 Pokemon Japanese Scarlet & Violet Raging Surf AR Groudon #69 PSA 7 NM",
        "1999 POKÉMON English SWSH12a  Base AR SR x #4 PSA 10", None, "", "1999 Pokemon English Base 1st Edition Shadowless Holo Charizard #004 PSA GEM MT 10.0", "2020 Pokemon English AR x #A-1 PSA 8.5",
    )
    assert [r.state for r in got] == ["PARSED", "PARSED", "schema unproven", "rarity missing", "schema unproven", "rarity ambiguous", "schema unproven", "schema unproven", "PARSED", "set or name unproven"]
    a, b, c = got[0], got[1], got[8]
    assert (a.year, a.language, a.set, a.name, a.local_id, a.grade) == (2023, "ja", "Raging Surf", "Groudon", "69", "10")
    assert (b.language, b.set, b.name, b.local_id, b.grade) == ("en", "151", "Psyduck", "175", "9")
    assert (c.set, c.name, c.local_id, c.grade, c.edition, c.finish, c.variant) == ("Base 1st Edition Shadowless", "Charizard", "4", "10", "First Edition", "Holo", "Shadowless")


def test_readings_of_loose_titles(spark):
    texts = [
        "2023 Japanese Pokemon SV2a Hitmonchan Masterball 107 PSA 10", "Pokemon 2021 JPN.SWSH VMax Climax - FA/Eevee #210 PSA 10", "Vivillon 107/106 - Art Rare - PSA 10 - Japanese Pokémon", "Pokémon Japanese Venusaur Holo Expansion Pack No. 003 PSA 8",
        "2026 Pokemon Ascended Heroes Pikachu ex 277 PSA 10", "2023 Pokemon Japanese Raging Surf AR Groudon #69 PSA 10", "Pokemon 2020 English Some Set #001 FA/Pikachu PSA 9", "Japanese card #1 PSA 10", "Pokemon Japanese x PSA 7", "Pokemon Japanese a 1/2 3/4 PSA 10", "Pokemon Japanese a PSA 10", None,
        "Pokemon Japanese English a #1 PSA 10",
    ]
    got = grammar.with_readings(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    read = lambda i: [(r["set"], r["name"], r["local_id"]) for r in got[i].readings]
    assert ("SV2a", "Hitmonchan", "107") in read(0) and got[0].finish == "Master Ball" and got[0].year == 2023 and len(read(0)) <= 10
    assert read(1)[0][1] == "Eevee" and read(1)[0][2] == "210" and got[1].language == "ja"
    assert any(name == "Vivillon" and local == "107" for _, name, local in read(2))
    assert ("Expansion Pack", "Venusaur", "3") in read(3) or any(n == "Venusaur" and l == "3" for _, n, l in read(3))
    assert got[3].grade == "8" and got[3].finish == "Holo" and got[3].year == 0
    assert read(4) == [] and got[4].reason == "language unproven"
    assert read(5)[0] == ("Raging Surf", "Groudon", "69")
    assert ("Some Set", "Pikachu", "1") in read(6)
    assert [got[i].reason for i in (7, 8, 9, 10, 11, 12)] == ["not the game", "grade unproven", "number unproven", "number unproven", "not the game", "language unproven"]
    assert all(len({(s.lower(), n.lower()) for s, n, _ in read(i)}) == len(read(i)) for i in range(len(texts)))


def test_identities_of_whole_titles(spark):
    rows = [
        ("PSA 9 Dracaufeu  ex", "Article\nRéférence : #4/102\nAnnée: 1999\nLangue: Français\nSérie: Set de Base  - Langue: Français", "PSA", "9", None), ("CGC 9.5+ Pikachu French #sv-12", "", None, None, None), ("Mew 151/165 2023", None, "", "", "Japanese"), (None, None, None, None, None),
        ("PCA 9.5+ x", "", "PCA", "9.5", ""), ("Collection", "Collection: A", None, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, b string, g string, n string, l string")
    of = grammar.card_identity(F.col("t"), F.col("b"), F.col("g"), F.col("n"), F.col("l"))
    got = [tuple(r) for r in df.select(*[of[c].alias(c) for c in ("core", "ref", "year", "language", "series")]).collect()]
    assert got == [("Dracaufeu ex", "4/102", "1999", "", "Set de Base"), ("Pikachu French #sv-12", "SV-12", "", "French", ""), ("Mew 151/165 2023", "151/165", "2023", "Japanese", ""), ("", "", "", "", ""), ("x", "", "", "", ""), ("Collection", "", "", "", "")]


LISTING = "key string, proven boolean, complete boolean, place long, market string, evidence string, url string, price double, all_in double"


def test_cards_hold_bounded_offers(spark):
    rows = [("a", True, True, i, "m", "FIXED_ASK", f"u{i}", 1.0 * i, 1.0 * i) for i in range(2000)] + [("b", True, True, 5, "m", "FIXED_ASK", "u", 1.0, None), ("c", False, True, 1, "m", "x", "u", 1.0, 1.0), ("d", True, False, 1, "m", "x", "u", 1.0, 1.0), (None, True, True, 1, "m", "x", "u", 1.0, 1.0)]
    cards = {r.key: r for r in offers.cards_of(spark.createDataFrame(rows, LISTING), spark.createDataFrame([("a", 3.456), ("b", -1.0)], "key string, value double"), 20).collect()}
    assert set(cards) == {"a", "b"} and [o.url for o in cards["a"].offers] == [f"u{i}" for i in range(20)] and cards["a"].n_more == 1980 and cards["a"].fair_value == 3.46
    assert cards["b"].n_more == 0 and cards["b"].fair_value is None and cards["b"].offers[0].all_in is None


def test_the_offer_that_was_meant(spark):
    rows = [("a", True, True, 9, " Ebay", "FIXED_ASK", "u ", 1.0, 2.0), ("a", True, True, 3, "EBAY", "AUCTION_SNAPSHOT", "u", 1.0, 2.0), ("a", True, True, 4, "ebay", "FIXED_ASK", "u", 1.0, None), ("a", True, True, 5, "ebay", "AUCTION_SNAPSHOT_LE5", "u", 1.0, 0.0), ("a", True, True, 7, "ebay", "AUCTION_SNAPSHOT_LE5", "u", 1.0, 2.0), ("a", False, True, 1, "ebay", "FIXED_ASK", "u", 1.0, 2.0)]
    asked = [("a", "eBay ", "u"), ("a", "comc", "u"), ("a", "ebay", "v"), ("b", "ebay", "u"), ("a", None, None)]
    got = offers.offers_meant(spark.createDataFrame(asked, "key string, market string, url string"), spark.createDataFrame(rows, LISTING)).collect()
    assert sorted(((r.market or "", r.url or "", r.key), r.offer) for r in got) == sorted((((m or ""), (u or ""), k), 7 if (k, m, u) == asked[0] else None) for k, m, u in asked)


def test_proof_of_every_required_dimension(spark):
    full = {"set": "s", "collector_number": "1", "language": "en", "condition": "NM"}
    cases = [
        (full, {"finish": "holo"}, None), (full, {"finish": ""}, {}), (None, None, {"variant": "x"}), (full, {"finish": "h", "edition": "1st"}, {"edition": "1st"}), (full, {"finish": "h"}, {"edition_applicable": "true"}), (full, {"finish": "h"}, {"edition_applicable": "False"}),
        ({**full, "set": ""}, {"set": "t", "finish": "h", "other": "z"}, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p map<string,string>, c map<string,string>, l map<string,string>")
    who, needed = offers.provenance(F.col("p"), F.col("c")), offers.required_dimensions(F.col("l"))
    got = df.select("i", who.alias("who"), needed.alias("needed")).select("i", "who", offers.unproven(F.col("who"), F.col("needed")).alias("missing"), offers.strong_enough(F.col("who"), F.col("needed")).alias("strong")).orderBy("i").collect()
    assert [r.missing for r in got] == [[], ["finish"], [*offers.REQUIRED, "variant"], [], ["edition"], [], []]
    assert [r.strong for r in got] == [not r.missing for r in got]
    assert got[6].who["set"] == "CATALOG" and got[6].who["language"] == "PROVIDER" and got[6].who["printing"] == "UNKNOWN" and set(got[6].who) == set(offers.DIMENSIONS)


def test_audits_are_observed_while_rows_are_written(spark):
    def page(feed, n, ids, following=None, total=None, **more):
        return feed, n, json.dumps({"info": {"currentPage": n, "nextPage": following, "counts": {"total": total}}, "results": [{"id": i, "price": 1.0} for i in ids], **more})

    rows = [
        page("whole", 1, "ab", 2, 3), page("whole", 2, "c"), page("none", 1, [], None, 0), page("open", 1, "ab", 2), page("last", 1, "ab"), page("short", 1, "ab", None, 5), page("twice", 1, "ab", 2, 2), page("twice", 2, "ab"),
        page("unkeyed", 1, ["a", None, " "], None, 1), ("bad", 1, "no json"), ("late", 2, json.dumps({"info": {"currentPage": 1}, "results": []})),
    ]
    df = spark.createDataFrame(rows, "feed string, page int, body string")
    folder = shared_folder(spark)
    feeds = ["whole", "none", "open", "last", "short", "twice", "unkeyed", "bad", "late", "never"]
    audit = audits.audited_scan(df, feeds, folder)
    got = {r.feed: (r.status, r.ratio, r.listings, r.duplicates, r.repeated, r.unkeyed, r.failed) for r in audits.coverage(audit, spark.createDataFrame([("open", 3), ("never", 1)], "feed string, requested long")).collect()}
    assert got == {
        "whole": ("COMPLETE", 100.0, 3, 0, 0, 0, 0), "none": ("COMPLETE", 100.0, 0, 0, 0, 0, 0), "open": ("INCOMPLETE", None, 2, 0, 0, 0, 2), "last": ("COMPLETE", None, 2, 0, 0, 0, 0), "short": ("INCOMPLETE", 40.0, 2, 0, 0, 0, 0),
        "twice": ("INCOMPLETE", 100.0, 2, 2, 1, 0, 0), "unkeyed": ("INCOMPLETE", 100.0, 1, 0, 0, 2, 0), "bad": ("INCOMPLETE", None, 0, 0, 0, 0, 0), "late": ("INCOMPLETE", None, 0, 0, 0, 0, 0), "never": ("INCOMPLETE", None, 0, 0, 0, 0, 1),
    }
    assert audits.coverage(audit).where("feed in ('open', 'never')").select("status").distinct().collect()[0].status == "UNKNOWN"
    assert sorted((r.feed, r.id) for r in load(spark, folder).collect()) == sorted([("whole", "a"), ("whole", "b"), ("whole", "c"), *[(f, i) for f in ("open", "last", "short", "twice") for i in "ab"], ("unkeyed", "a")])


CARD = "target int, ref string, year string, series string, core string, language string, grader string, grade string"


def test_points_of_sale_titles(spark):
    card = (1, "#45/120", "2026", "Mega Evolution", "Otaquin", "French", "PSA", "9")
    texts = ["Pokemon Otaquin 45/120 Mega Evolution 2026 PSA 9 French", "Pokémon Otaquin 45/120", "Otaquin 45/120", "Pokemon booster 45/120", "Pokemon Pikachu 1/2", "Pokemon Otaquin CGC 8 japanese", "pokemon 45 / 120 PSA 5", None]
    df = spark.createDataFrame([(*card, t) for t in texts], CARD + ", title string")
    got = [r.s for r in df.select(titles.sale_title_score({c: F.col(c) for c in titles.IDENTITY}, F.col("title")).alias("s")).collect()]
    assert got == [60 + 8 + 12 + 8 + 20 + 10 + 8, 60 + 8 - 10, 0, 0, 0, 8 + 8 + 2 - 25, 60 - 15 + 10, 0]


def test_points_of_certified_pages(spark):
    card = (1, "045", "2026", "MEGA EVOLUTION", "Otaquin", "French", None, None)
    none = (1, None, "2026", "MEGA EVOLUTION", "Otaquin", "French", None, None)
    text = "2026 POKEMON MEGA EVOLUTION\nNo. 045\nOtaquin\nLanguage: French"
    rows = [(*card, text, "45", "2026", "French"), (*card, text, "046", "2026", "French"), (*card, text, None, "2026", "French"), (*card, "No. 045", "045", None, None), (*card, text, "045", "2025", None), (*card, text, "045", None, "English"), (*card, text + " sealed", "045", None, None), (*none, text, None, "2026", "French"), (*none, "2026 Otaquin", None, None, None), (*card, text, "45/132", "2026", "French")]
    df = spark.createDataFrame(rows, CARD + ", text string, r string, y string, l string")
    got = [r.s for r in df.select(titles.certified_score({c: F.col(c) for c in titles.IDENTITY}, F.col("text"), F.col("r"), F.col("y"), F.col("l")).alias("s")).collect()]
    assert got == [65 + 12 + 12 + 10 + 5, 0, 0, 0, 0, 0, 0, 25 + 12 + 10 + 5, 0, 104]


def test_every_title_above_the_bound_is_found(spark):
    import random

    r = random.Random(6)
    words = [f"word{c}" for c in "abcdefghijklmnop"]
    cards = [(i, f"{i}/{r.randrange(3)}" if i % 3 else None, str(1990 + i % 9), " ".join(r.sample(words[:6], 3)), " ".join(r.sample(words, 3)), r.choice(["French", "", None]), r.choice(["PSA", "CGC", None]), r.choice(["9", "10", None])) for i in range(40)]
    texts = []
    for i in range(400):
        c = r.choice(cards)
        inner = f"xx{c[4].split()[0]}y" if r.random() < 0.3 else ""  # a word inside a longer one
        bits = ["Pokemon", inner, *(c[3].split() if r.random() < 0.8 else []), *(c[4].split()[: r.randrange(4)]), c[2] if r.random() < 0.7 else "", f"12{c[1]}" if c[1] and r.random() < 0.5 else "", "PSA 9", r.choice(["french", "english", ""])]
        r.shuffle(bits)
        texts.append((i, " ".join(bits)))
    t, s = spark.createDataFrame(cards, CARD), spark.createDataFrame(texts, "title_id int, title string")
    every = t.crossJoin(s).select("target", "title_id", titles.sale_title_score({c: F.col(c) for c in titles.IDENTITY}, F.col("title")).alias("score"))
    for least in (45, 60, 80):
        want = sorted(map(tuple, every.where(F.col("score") >= least).collect()))
        assert sorted(map(tuple, titles.matched_titles(t, s, least).collect())) == want and want
    best = {x.target: x for x in titles.best_two(titles.matched_titles(t, s, 45)).collect()}
    for target, x in best.items():
        own = sorted(((-sc, i) for tt, i, sc in map(tuple, every.where("score >= 45").collect()) if tt == target))
        assert (-x.score, x.title_id) == own[0] and x.runner_up == (-own[1][0] if len(own) > 1 else None)


def test_equal_cards_and_pages_are_scored_once(spark):
    kinds = [("45/120", "2026", "MEGA EVOLUTION", "Otaquin", "French"), ("45/120", "2026", "MEGA EVOLUTION", "Otaquin", None), ("45/120", None, "MEGA", "Pikachu", "French"), (None, "2026", "MEGA", "Otaquin", "French")]
    cards = spark.createDataFrame([(i, *kinds[i % 4], "PSA", str(i)) for i in range(40)], CARD)
    sheets = [("2026 POKEMON MEGA EVOLUTION\nOtaquin", "45/120", "2026", "French"), ("2026 POKEMON MEGA EVOLUTION\nOtaquin", "45/120", None, None), ("Pikachu mega", "45/120", "2025", None), ("2026 Otaquin", None, "2026", "French")]
    pages = spark.createDataFrame([(i, *sheets[i % 4]) for i in range(24)], "page int, text string, ref2 string, year2 string, language2 string")
    every = cards.join(pages, F.col("ref") == F.col("ref2")).select("target", "page", titles.certified_score({c: F.col(c) for c in titles.IDENTITY}, F.col("text"), F.col("ref2"), F.col("year2"), F.col("language2")).alias("score"))
    want = sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, titles.certified_pages(cards, pages).collect())) == want and len(want) == 30 * 18 and len({w[2] for w in want}) > 3
    rows, of = titles.once(cards, "target", ["ref", "year", "series", "core", "language"], "card")
    assert sorted((r.card, r.copies) for r in rows.collect()) == [(0, 10), (1, 10), (2, 10), (3, 10)]
    assert sorted(map(tuple, of.collect())) == [(i, i % 4) for i in range(40)]


def test_equal_cards_and_titles_are_matched_once(spark):
    kinds = [("45/120", "2026", "Mega Legend", "Otaquin Rouge", "French", "PSA", "9"), ("7/120", "2026", "Mega Legend", "Otaquin Rouge", "French", "PSA", "9"), (None, "99", "Mega Legend Onyx", "Pikachu Vert", None, None, None)]
    texts = ["Pokemon 2026 Mega Legend Otaquin Rouge 45/120 PSA 9", "Pokemon 2026 Mega Legend Otaquin Rouge PSA 9 french", "Pokemon Mega Legend Onyx xpikachu vert 1999", "Pokemon 2026 Mega Otaquin 17/120 PSA 9", "booster Pokemon 45/120"]
    t = spark.createDataFrame([(i, *kinds[i % 3]) for i in range(60)], CARD)
    s = spark.createDataFrame([(i, texts[min(i % 7, 4)] if i != 10 else f"{texts[3]} x") for i in range(7, 77)], "title_id int, title string")
    every = t.crossJoin(s).select("target", "title_id", titles.sale_title_score({c: F.col(c) for c in titles.IDENTITY}, F.col("title")).alias("score")).where("score >= 40").collect()
    own = {}
    for target, title_id, score in sorted(every, key=lambda r: (-r.score, r.title_id)):
        own.setdefault(target, []).append((title_id, score))
    want = sorted((k, v[0][0], v[0][1], v[1][1] if len(v) > 1 else None) for k, v in own.items())
    assert sorted(map(tuple, titles.best_titles(t, s, 40).collect())) == want and len(want) == 60
    cards, _, once, _ = titles.folded_pairs(t, s)
    met, list_of, _ = titles.met_by_words(cards, once, 20)
    assert list_of.count() == 3 and met.count() <= 6
