"""Budgets, retries, evidence as it was known, and repaired rules, on rows that tell them from their near misses."""

import datetime
import random

from pyspark.sql import functions as F

from pricelens.operators.joins import recovered_two_of_three
from pricelens.operators.signals import stale_seller_signals
from pricelens.streaming import budgets

CALLS = "n long, run string, consumed long, remaining long"


def calls(spark, *answers, **limits):
    df = spark.createDataFrame([(i, "r", c, left) for i, (c, left) in enumerate(answers)], CALLS)
    return [(r.allowed, r.reason, r.credits) for r in budgets.call_budget(df, "run", ["n"], **limits).orderBy("n").collect()]


def test_the_call_that_crosses_the_credits_is_made_and_ends_the_run(spark):
    assert calls(spark, (50, 20_000), (20, 20_000), (1, 20_000)) == [(True, None, 0), (True, None, 50), (False, "CREDIT_CAP_EXCEEDED", 70)]


def test_reasons_of_a_budget(spark):
    assert calls(spark, (60, 20_000), (1, 20_000))[1] == (False, "CREDIT_CAP", 60)
    assert calls(spark, *[(1, 20_000)] * 14)[11:] == [(True, None, 11), (False, "HTTP_CALL_CAP", 12), (False, "HTTP_CALL_CAP", 12)]
    assert calls(spark, (1, 15_000), (1, 99_000))[1] == (False, "DAILY_REMAINING_SAFETY_FLOOR", 1)
    assert calls(spark, (None, 20_000), (1, 20_000), (1, 1))[1:] == [(False, "CREDIT_HEADER_REQUIRED", 0)] * 2
    assert calls(spark, (1, None), (None, 20_000))[1] == (False, "DAILY_REMAINING_HEADER_REQUIRED", 1)
    assert calls(spark, (1, 20_000), known_left=F.lit(15_000)) == [(False, "DAILY_REMAINING_SAFETY_FLOOR", 0)]
    assert calls(spark, (0, 20_000), max_calls=0) == [(False, "HTTP_CALL_CAP", 0)]


def test_the_reserve_is_kept_for_fixed_offers(spark):
    r = random.Random(1)
    for total, reserve in ((8, 3), (3, 9), (0, 0), (5, 0), (-1, 2), (6, -2)):
        rows = [(i, "r", r.random() < 0.4) for i in range(40)]
        got = {x.n: (x.cap, x.taken) for x in budgets.within_reserve(spark.createDataFrame(rows, "n int, run string, fixed boolean"), "run", ["n"], "fixed", total, reserve).collect()}
        used, whole = 0, max(0, total)
        kept = max(0, min(whole, reserve))
        for n, _, fixed in rows:
            cap = whole if fixed else max(0, whole - kept)
            assert got[n] == (cap, used < cap)
            used += used < cap


def test_retries_double_and_are_cleared(spark):
    def after(*statuses):
        df = spark.createDataFrame([("k", i, s) for i, s in enumerate(statuses)], "k string, n int, status string")
        r = budgets.retries(df, "k", ["n"]).first()
        return r.retry_count, r.wait_minutes

    assert [after(*["RETRY"] * n) for n in range(1, 8)] == [(1, 15), (2, 30), (3, 60), (4, 120), (5, 240), (6, 360), (7, 360)]
    assert after("RETRY", "RETRY", "opportunity") == (0, None) and after("RETRY", "DONE", "RETRY") == (1, 15)
    assert after("RETRY", "RETRY", "PENDING") == (0, 5) and after("RETRY", "PENDING", "RETRY") == (1, 15) and after("RETRY", None) == (0, None)
    assert after(*["RETRY"] * 1200) == (1200, 360)


def test_known_at_is_the_latest_evidence_at_or_before(spark):
    r = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    at = lambda: day + datetime.timedelta(hours=r.randrange(24 * 12))
    ticks = [(i, r.choice(["a", "b", None]), at()) for i in range(300)]
    evidence = [(r.choice(["a", "a", "b", None, "c"]), at(), float(r.randrange(9))) for _ in range(60)]
    got = budgets.known_at(spark.createDataFrame(ticks, "id int, k string, ts timestamp"), spark.createDataFrame(evidence, "k string, ts timestamp, value double"), ["k"], "ts", ["value"]).collect()
    want = {i: max(((t, v) for kk, t, v in evidence if kk == k and t <= ts), default=(None, None))[1] for i, k, ts in ticks}
    assert {x.id: x.value for x in got} == want and len(got) == 300
    plan = budgets.known_at(spark.createDataFrame(ticks, "id int, k string, ts timestamp"), spark.createDataFrame(evidence, "k string, ts timestamp, value double"), ["k"], "ts", ["value"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_age_equal_to_the_ttl_is_stale(spark):
    df = spark.createDataFrame([(None, 3), (0.0, 0), (2.99, 3), (3.0, 3), (0.5, 0), (1.0, 0)], "age double, ttl int")
    assert [r.s for r in df.select(budgets.cache_state(F.col("age"), F.col("ttl")).alias("s")).collect()] == ["MISS", "HIT", "HIT", "STALE", "HIT", "STALE"]


def test_ttl_by_distance_to_a_bargain(spark):
    rows = [(80.0, 100.0, 90.0), (70.0, 100.0, 90.0), (77.0, 100.0, 0.0), (84.0, 100.0, 0.0), (89.0, 100.0, 0.0), (94.0, 100.0, 0.0), (99.0, 100.0, 0.0), (0.0, 100.0, 90.0), (50.0, 0.0, 0.0), (None, 100.0, 90.0)]
    df = spark.createDataFrame(rows, "p double, c double, l double")
    got = [r.t for r in df.select(budgets.adaptive_ttl(F.col("p"), F.col("c"), F.col("l"), F.lit(20.0)).alias("t")).collect()]
    assert got == [3, 1, 1, 2, 3, 6, 24, 24, 24, 24]
    got = [r.t for r in df.select(budgets.adaptive_ttl(F.col("p"), F.col("c"), F.col("l"), F.lit(20.0), arbitrage=F.lit(True)).alias("t")).collect()]
    assert got == [1, 1, 24, 24, 24, 24, 24, 24, 24, 24]


def test_a_seller_needs_two_old_asks_and_a_rising_market(spark):
    fixed = [(1, "s", 60.0, 30.0), (2, "s", 55.0, 25.0), (3, "s", 60.0, 5.0), (4, "t", 60.0, 30.0), (5, "u", 60.0, 30.0), (6, "u", 60.0, None), (7, "v", 60.0, 30.0), (8, "v", 120.0, 30.0), (9, None, 60.0, 30.0), (10, None, 60.0, 30.0)]
    moves = [(i, 125.0, 47.0) for i in range(1, 11) if i != 2] + [(2, 125.0, 3.0)]
    got = stale_seller_signals(spark.createDataFrame(fixed, "listing_id int, seller string, price double, age_days double"), spark.createDataFrame(moves, "listing_id int, recent double, momentum double"))
    assert sorted((r.listing_id, r.listed, r.stale) for r in got.collect()) == [(1, 3, 2), (7, 2, 2)]


def test_one_coordinate_never_finds_a_card(spark):
    catalogue = [(1, "a", "s", "1/9"), (2, "a", "t", "2/9"), (3, "b", "s", "1/9"), (4, "b", "s", "2/9"), (4, "b", "s", "2/9")]
    rows = [("a", None, "1/9"), ("a", "t", None), ("b", "s", None), ("b", None, "2/9"), ("c", None, "1/9"), (None, "s", "1/9"), ("a", "s", "1/9"), ("a", None, None), (None, "s", None)]
    made = recovered_two_of_three(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, set string, number string"), spark.createDataFrame(catalogue, "card int, name string, set string, number string"))
    assert [(r.card, r.recovery) for r in made.orderBy("id").collect()] == [(1, "by number"), (2, "by set"), (None, "ambiguous"), (4, "by number"), (None, "none"), *[(None, "not applicable")] * 4]
