"""Estimates bounded by neighbouring grades."""

from pricelens.operators.valuation import bounded_estimates


def test_neighbouring_grades_bound_and_a_lower_grade_may_stand_in(spark):
    asks = [(1, "PSA", 9.0, 100.0), (2, "PSA", 9.0, 40.0), (3, "PSA", 9.0, 60.0), (4, "PSA", 9.0, 1.0), (5, "PSA", 9.0, 1.0)]
    sold = [(1, "PSA", 9.0, p) for p in (100.0, 102.0, 105.0, 95.0, 310.0)] + [(1, "PSA", 8.0, 50.0), (1, "PSA", 7.0, 1.0), (1, "PSA", 10.0, 400.0), (1, "CGC", 9.0, 9.0)]
    sold += [(2, "PSA", 8.0, p) for p in (48.0, 50.0, 52.0)] + [(2, "PSA", 10.0, 90.0), (3, "PSA", 8.0, 50.0), (4, "CGC", 9.0, 5.0), (5, "PSA", 10.0, 5.0)]
    a = spark.createDataFrame(asks, "listing_id long, g string, want double, ask double")
    s = spark.createDataFrame([(*r, 10.0, "O") for r in sold], "part_id long, grader string, grade double, price double, age double, source string")
    got = {r.listing_id: r for r in bounded_estimates(a, s).collect()}
    assert set(got) == {1, 2}  # 3 asks more than the lower grade brings; 4 and 5 have nothing at or below the grade
    one, two = got[1], got[2]
    assert one.n == 4 and 95 <= one.central <= 105 and one.low == 50.0 and one.high == 400.0 and not one.arbitrage and one.reference_grade is None
    assert two.arbitrage and two.reference_grade == 8.0 and two.reference_value == 50.0 and two.low >= 48.0 and two.high == 90.0
