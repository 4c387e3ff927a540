"""Every unstable pair is in the leaderboard's lines, and they are in order."""

from verdictlake.plans import catalog, report, report_queries


def test_all_unstable_pairs_are_listed(spark, sf, monkeypatch):
    monkeypatch.setattr(report, "PAGE", 7)
    lines = report_queries.leaderboard_report(spark, sf).where("section = 'Unstable pairs'").orderBy("place").collect()
    want = catalog.unstable_pairs(spark, sf).orderBy("backend", "place").collect()
    assert [r.place for r in lines] == list(range(1, len(lines) + 1)) and len({r.nth for r in lines}) == 1
    listed = []
    for r in lines:
        head, ids = (r.line.rstrip(")").split(" (") if " (" in r.line else r.line.rsplit(": ", 1))
        listed += [(head[2:4], i) for i in ids.removesuffix(", ...").split(",")]
    assert listed == [(r.backend, r.pair_id) for r in want] and len(want) > 50
