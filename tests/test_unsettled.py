"""Pairs without a settled reason, with their places."""

from verdictlake.operators import agreement


def test_places_of_unsettled_pairs(spark):
    keys = [("a", "pair-0010"), ("a", "pair-0002"), ("a", "q"), ("a", None), ("b", ""), (None, "pair-0002"), (None, "p")]
    rows = [(b, p, 2, None) for b, p in keys] + [("a", "pair-0003", 3, "ok")]
    got = agreement.unsettled_reason_pairs(spark.createDataFrame(rows, "backend string, pair_id string, n_votes long, reason string")).collect()
    assert sorted(map(repr, [(r.backend, r.place, r.pair_id, r.n) for r in got])) == sorted(map(repr, [("a", 1, None, 4), ("a", 2, "pair-0002", 4), ("a", 3, "pair-0010", 4), ("a", 4, "q", 4), ("b", 1, "", 1), (None, 1, "p", 2), (None, 2, "pair-0002", 2)]))
    assert {r.n_votes for r in got} == {2}
