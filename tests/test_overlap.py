"""Overlapping intervals against all pairs."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from verdictlake.operators.overlap import overlapping

SCHEMA = "backend string, lo double, hi double, extra int"


def pairs(rows):
    rows = [r for r in rows if None not in r and r[1] <= r[2]]
    return Counter((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])


def found(spark, rows, size):
    return Counter((r.backend, r.other) for r in overlapping(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), size=size).collect())


@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcdefghij")), st.one_of(st.none(), st.integers(-3, 9).map(float)), st.one_of(st.none(), st.integers(-3, 9).map(float))), max_size=25), st.sampled_from([1, 2, 1024]))
def test_against_all_pairs(spark, rows, size):
    """Ties, points, nulls, reversed ends, repeated keys and rows, segments of one start."""
    assert found(spark, rows, size) == pairs(rows)


def test_long_and_short_intervals(spark):
    """One interval over everything, many at one point, many apart; candidates stay near the result."""
    rows = [("all", 0.0, 1e6)] + [(f"p{i}", 500.5, 500.5) for i in range(30)] + [(f"s{i}", i * 10.0, i * 10.0 + (12 if i % 5 == 0 else 3)) for i in range(600)]
    assert found(spark, rows, 8) == pairs(rows)


def test_no_nested_loop(spark):
    plan = overlapping(spark.createDataFrame([("a", 0.0, 1.0, 1), ("b", 1.0, 2.0, 1)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    assert overlapping(spark.createDataFrame([], SCHEMA)).collect() == []
