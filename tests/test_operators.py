import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import text
from verdictlake.operators import agreement, bootstrap, caveats, guards, journal, kept_tally, records, reliability, score
from verdictlake.operators.guards import GuardError
from verdictlake.operators.tally import majority_first_seen, stability, tally, tally_any
from verdictlake.plans import report
from verdictlake.schema import REASONS, VERDICTS
from verdictlake.sources import fixtures, judge, readers, sinks, slate
from verdictlake.streaming import twins

VOTES = "backend string, pair_id string, run_index long, verdict string, reason string"


def votes(spark, rows):
    return spark.createDataFrame([(b, p, i, v, r) for b, p, i, v, r in rows], VOTES)


EDGE = [
    *[("a", "tie", i, v, r) for i, (v, r) in enumerate([("approve", "ok"), ("reject", "casing_error")] * 2)],
    *[("a", "split", i, "reject", r) for i, r in enumerate(["casing_error", "overcorrection", "meaning_change"])],
    ("a", "one", 0, "approve", "ok"),
    *[("b", "tie", i, "reject", "overcorrection") for i in range(3)],
]


def test_tally_edges(spark):
    got = {(r.backend, r.pair_id): r for r in tally(votes(spark, EDGE)).collect()}
    tie, split, one = got["a", "tie"], got["a", "split"], got["a", "one"]
    assert (tie.verdict, tie.reason, tie.verdict_flip_rate) == (None, None, 0.5)
    assert (split.verdict, split.reason, split.verdict_flip_rate) == ("reject", None, 0.0) and split.reason_flip_rate == pytest.approx(2 / 3)
    assert (one.verdict, one.reason, one.n_votes, one.reason_flip_rate) == ("approve", "ok", 1, 0.0)


@pytest.mark.parametrize("seed", range(8))
def test_tally_ignores_order(spark, seed):
    rows = list(EDGE)
    random.Random(seed).shuffle(rows)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(tally(votes(spark, rows))) == key(tally(votes(spark, EDGE)))


def test_duplicate_runs_count_unless_deduped(spark):
    rows = [("a", "p", 0, "approve", "ok")] * 2 + [("a", "p", 1, "reject", "casing_error")]
    assert tally(votes(spark, rows)).first().verdict == "approve"
    assert tally(votes(spark, rows), dedupe=True).first().verdict is None


def test_other_majorities(spark):
    v = votes(spark, EDGE)
    assert {(r.backend, r.pair_id): r.n_top for r in tally_any(v, "reason").collect()}["a", "split"] == 3
    assert {r.pair_id: r.ruling for r in majority_first_seen(v.where("backend = 'a'"), "verdict", ["run_index"]).collect()}["tie"] == "approve"


def test_stability_keeps_empty_backends(spark):
    roster = spark.createDataFrame([("a",), ("b",), ("empty",)], "backend string")
    got = {r.backend: r for r in stability(tally(votes(spark, EDGE)), roster).collect()}
    assert (got["empty"].pairs, got["empty"].verdict_flip) == (0, None) and got["a"].unstable_pairs == 2


@pytest.mark.parametrize("rows,kappa", [([("x", "x")] * 4, 1.0), ([("x", "y")] * 3, 0.0), ([("x", "x"), ("y", "y")], 1.0), ([("x", "y"), ("y", "x")], -1.0)])
def test_kappa_edges(spark, rows, kappa):
    assert score.cohens_kappa(spark.createDataFrame(rows, "t string, p string"), "t", "p").first().kappa == pytest.approx(kappa)


def test_tiers_chain(spark):
    s = spark.createDataFrame([("A", 0.85, 0.80, 0.90), ("B", 0.65, 0.60, 0.70), ("C", 0.7, 0.50, 0.85), ("D", 0.2, 0.1, 0.3), ("E", 0.35, 0.3, 0.4)], "backend string, kappa double, lo double, hi double")
    assert {r.backend: r.tier for r in bootstrap.tiers(s).collect()} == {"A": 1, "B": 1, "C": 1, "D": 2, "E": 2}
    assert {(r.backend, r.other) for r in bootstrap.tiers_theta(s).collect()} == {("A", "C"), ("B", "C"), ("D", "E")}


def test_agreement_without_overlap_is_null(spark):
    v = votes(spark, [("a", "p", 0, "approve", "ok"), ("b", "q", 0, "approve", "ok"), ("c", "p", 0, "approve", "ok")])
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "backend string")
    got = {(r.backend, r.other): r.agreement for r in agreement.agreement_matrix(tally(v), roster).collect()}
    assert got["a", "b"] is None and got["a", "c"] == got["c", "a"] == got["b", "b"] == 1.0


def same_rows(a, b):
    return sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.select(*a.columns).collect())))


def test_kept_tally_equals_the_tally_after_every_batch(spark, tmp_path):
    folder, rng, rows = str(tmp_path / "kept"), random.Random(7), []
    assert kept_tally.read_tally(spark, folder).count() == 0
    for n in range(6):
        new = [(rng.choice(["a", "b", None]), rng.choice(["p", "q", "r", None]), i, rng.choice(["approve", "reject", "odd", None]), rng.choice([*REASONS, None])) for i in range(0 if n == 2 else 9)]
        rows += new
        assert kept_tally.add_votes(votes(spark, new).withColumn("n_votes", F.lit(5)), folder, n)
        assert not kept_tally.add_votes(votes(spark, [("x", "x", 0, "approve", "ok")]), folder, n)  # a batch that comes again
        assert same_rows(kept_tally.read_tally(spark, folder), tally(votes(spark, rows)))
        keys = {r[:2] for r in new}
        got = kept_tally.changed(spark, folder, n)
        assert {(r.backend, r.pair_id): r.n_votes for r in got.collect()} == Counter(r[:2] for r in rows if r[:2] in keys)
        if n in (1, 3, 4):
            before = kept_tally.read_tally(spark, folder)
            kept_tally.fold(spark, folder)
            assert same_rows(before, tally(votes(spark, rows))) and same_rows(kept_tally.read_tally(spark, folder), tally(votes(spark, rows)))
            assert not kept_tally.add_votes(votes(spark, EDGE), folder, n)
    (tmp_path / "kept" / "batch-5" / "_SUCCESS").unlink()  # a write that was cut off does not count, and is made again
    assert kept_tally.read_tally(spark, folder).agg(F.sum("n_votes")).first()[0] == len(rows) - 9
    assert kept_tally.add_votes(votes(spark, rows[-9:]), folder, 5) and same_rows(kept_tally.read_tally(spark, folder), tally(votes(spark, rows)))
    kept_tally.add_votes(votes(spark, EDGE), folder, 8)
    with pytest.raises(GuardError):
        kept_tally.add_votes(votes(spark, EDGE), folder, 7)


def test_kept_tally_of_a_stream_that_starts_over(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "kept")
    for k in range(3):
        votes(spark, EDGE[k::3]).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 1).json(source)
        kept_tally.keep(stream, folder, str(tmp_path / "checkpoint")).awaitTermination()
        assert same_rows(kept_tally.read_tally(spark, folder), tally(votes(spark, [r for j in range(k + 1) for r in EDGE[j::3]])))
    kept_tally.keep(spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 1).json(source), folder, str(tmp_path / "new")).awaitTermination()  # without its checkpoint
    assert same_rows(kept_tally.read_tally(spark, folder), tally(votes(spark, EDGE)))


@pytest.mark.parametrize("parts", [1, 3])
def test_packed_agreement_is_the_count_over_pairs(spark, monkeypatch, parts):
    """Several words of 64 pairs in a part, backends that skip pairs, missing rulings, null keys and repeated rows."""
    monkeypatch.setattr(agreement, "PARTS", parts)
    rng = random.Random(parts)
    rows = [(b, f"p{i}", rng.choice([*VERDICTS, None]), rng.choice([*REASONS, None])) for b in ("a", "b", "c", "d") for i in range(300) if rng.random() < 0.8]
    table = spark.createDataFrame([*rows, rows[0], (None, "p1", "approve", "ok"), ("a", None, "approve", "ok"), ("b", None, "approve", "ok")], "backend string, pair_id string, verdict string, reason string")
    by = {(b, p): (v, r) for b, p, v, r in rows}
    roster = spark.createDataFrame([(b,) for b in "abcde"], "backend string")
    for k, axis in enumerate(("verdict", "reason")):
        for r in agreement.agreement_matrix(table, roster, axis).collect():
            both = [(v[k], by[r.other, p][k]) for (b, p), v in by.items() if b == r.backend and (r.other, p) in by]
            both = [x == y for x, y in both if x is not None and y is not None]
            assert r.shared == len(both) and r.agreement == (pytest.approx(sum(both) / len(both)) if both else None)
    want = Counter((b, o, v[1], by[o, p][1]) for (b, p), v in by.items() for o in "abcd" if b < o and (o, p) in by and v[1] and by[o, p][1])
    assert {tuple(r)[:4]: r.pairs for r in agreement.reason_cross_tab(table).collect()} == want
    assert agreement.reason_cross_tab(table.limit(0)).count() == 0 and {r.shared for r in agreement.agreement_matrix(table.limit(0), roster).collect()} == {0}


def test_unsettled_never_agrees(spark):
    rows = [(b, "p", i, v, "ok") for b in "ab" for i, v in enumerate(["approve", "reject"])]
    roster = spark.createDataFrame([("a",), ("b",)], "backend string")
    assert all(r.agreement is None for r in agreement.agreement_matrix(tally(votes(spark, rows)), roster).collect())


def test_deadlocks_and_ties(spark):
    t = tally(votes(spark, EDGE))
    got = [(r.pair_id, r.kind, r.split) for r in agreement.deadlocks(t, "leg").orderBy("backend", "pair_id", "axis_order").collect()]
    assert got == [("split", "reason", "casing_error=1,meaning_change=1,overcorrection=1"), ("tie", "verdict", "approve=2,reject=2"), ("tie", "reason", "casing_error=2,ok=2")]
    assert caveats.tied_pairs(t).first().tie == "approve 2 = reject 2"
    assert json.loads(sinks.deadlock_lines(agreement.deadlocks(t, "leg")).first().value)["record_version"] == 1


def test_cache_states(spark):
    rows = [(b, f"p{p}", i, "approve" if b != "flips" or i else "reject", "ok", c) for b, c in (("hit", 5), ("zero", 0), ("silent", None), ("flips", 5)) for p in range(2) for i in range(3)]
    rows.append(("single", "p", 0, "approve", "ok", 9))
    v = spark.createDataFrame(rows, VOTES + ", cached_tokens long")
    got = {r.backend: r.status for r in agreement.cache_findings(v, tally(v)).collect()}
    assert got == {"hit": "collapse_suspected", "zero": "ok", "silent": "unverifiable", "flips": "ok", "single": "ok"}


def test_contention_of_nothing_settled(spark):
    rows = [("a", "p", i, v, r) for i, (v, r) in enumerate([("approve", "ok"), ("reject", "casing_error")])]
    r = agreement.contention(tally(votes(spark, rows))).first()
    assert (r.x_verdict, r.x_reason, r.n_unsettled) == (0.0, 0.0, 1) and r.contention == pytest.approx(0.5 + 0.25 + 2)


def test_reliability_is_three_valued(spark):
    rows = [("none", "none", None, None, None), ("bill", "cumulative", 0, 3, {"QuotaExhausted": 3}), ("dead", "cumulative", 0, 3, {"ReadTimeout": 2, "QuotaExhausted": 1}), ("slow", "cumulative", 5, 5, {"ReadTimeout": 5}), ("good", "cumulative", 9, 1, {"JudgeResponseError": 1}), ("idle", "cumulative", 0, 0, {})]
    c = spark.createDataFrame(rows, "backend string, scope string, succeeded long, failed long, error_kinds map<string,bigint>")
    got = {r.backend: r for r in reliability.judged_reliability(c).collect()}
    assert {b: r.unusable_at_scale for b, r in got.items()} == {"none": None, "bill": None, "dead": True, "slow": True, "good": False, "idle": True}
    assert got["none"].attempted is None and got["none"].failure_rate is None and got["dead"].timeouts == 2 and got["good"].contract_failures == 1
    assert [r.backend for r in caveats.compliance(c).collect()] == ["good"]


def test_coverage_shapes(spark):
    order = spark.createDataFrame([(f"p{i:02}", i) for i in range(20)], "pair_id string, rank long")
    rows = [("all", i) for i in range(20)] + [("prefix", i) for i in range(10)] + [("gaps", i) for i in range(20) if i != 3] + [("spread", i) for i in range(0, 18, 3)] + [("extra", 5), ("extra", 99)]
    v = votes(spark, [(b, f"p{i:02}", 0, "approve", "ok") for b, i in rows])
    got = {r.backend: (r.shape, r.span, r.total_pairs) for r in reliability.coverage_shapes(v, order).collect()}
    assert got == {"all": ("spread, stopped early", 20, 21), "prefix": ("prefix", 10, 21), "gaps": ("prefix", 20, 21), "spread": ("spread, stopped early", 16, 21), "extra": ("scattered gaps", 21, 21)} | {"all": ("prefix", 20, 21)}
    v = v.where("pair_id <> 'p99'")
    got = {r.backend: r.shape for r in reliability.coverage_shapes(v, order).collect()}
    assert (got["all"], got["gaps"], got["prefix"]) == ("complete", "scattered gaps", "prefix")


def test_reconstructed_order(spark):
    rows = [("a", "x", 1), ("a", "y", 0), ("b", "z", 0), ("b", "w", 1), ("b", "x", 2)]
    v = spark.createDataFrame(rows, "backend string, pair_id string, pos long")
    assert [r.pair_id for r in reliability.reconstructed_order(v).orderBy("rank").collect()] == ["z", "w", "x", "y"]


def test_accumulate_launches(spark):
    h = "struct<calls_ok:bigint,calls_failed:bigint,error_kinds:map<string,bigint>>"
    ident = "struct<model_id:string,code_version:string>"
    prev = spark.createDataFrame([("a", ("m", None), [(5, 1, {"X": 1})]), ("b", ("old", "1"), [(9, 9, {"Y": 9})])], f"backend string, identity {ident}, launches array<{h}>")
    now = spark.createDataFrame([(b, ("m", "2"), (3, 2, {"X": 1, "Z": 1})) for b in "abc"], f"backend string, identity {ident}, health {h}")
    got = {r.backend: r for r in reliability.accumulate(prev, now).collect()}
    assert (got["a"].calls_ok, got["a"].n_launches, got["a"].error_kinds, got["a"].discarded_prior_launches) == (8, 2, {"X": 2, "Z": 1}, 0)
    assert (got["b"].calls_ok, got["b"].discarded_prior_launches) == (3, 1) and got["c"].n_launches == 1


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 100, 101):
        calls = spark.range(1, n + 1).select(F.lit("b").alias("backend"), F.lit(1).alias("ok"), F.col("id").cast("double").alias("latency_s"), F.lit(None).cast("string").alias("error_kind"))
        assert reliability.health_summary(calls, "backend").first().latency_p95 == -(-95 * n // 100)


def test_hosts(spark):
    urls = {"https://h:8443/v1": "h:8443", "h2/v1": "h2", "http://u@x.y": "u@x.y"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", reliability.host_of(F.col("u")).alias("h")).collect()} == urls


def test_guards(spark):
    pairs = spark.createDataFrame([("a", 1, None), ("b", 2, "approve")], "id string, pos long, ground_truth string")
    with pytest.raises(GuardError, match="1 pairs"):
        guards.require_ruled(pairs)
    full = "pair_id string, run_index long, model_id string, prompt_version string, temperature double, reasoning_effort string, base_url string, config_digest string, code_version string"
    rows = spark.createDataFrame([("p", 0, "m", "v3", None, None, None, "d", "c"), ("p", 0, "m", "v3", None, None, "u", "d", "c")], full)
    run = {"model_id": "m", "prompt_version": "v3", "temperature": None, "base_url": "u", "config_digest": "d"}
    with pytest.raises(GuardError, match="lack provenance"):
        guards.resume_keys(rows, run)
    with pytest.raises(GuardError, match="served by v"):
        guards.resume_keys(rows, run, manifest_host="v")
    assert guards.resume_keys(rows, run, allow_unknown=True).count() == guards.resume_keys(rows, run, manifest_host="u").count() == 1
    for change in ({"temperature": 0.0}, {"config_digest": "other"}, {"model_id": "x"}):
        with pytest.raises(GuardError):
            guards.resume_keys(rows, run | change, allow_unknown=True)
    mixed = guards.config_guard(rows.withColumns({"backend": F.lit("b"), "temperature": F.when(F.col("base_url") == "u", 0.0)})).first()
    assert mixed.temperature == "0.0,None" and mixed.mixed_fields == "temperature"


def test_provenance_mixtures(spark):
    rows = [("one", "u", "c", None), ("one", "u", "c", None), ("two", "u", "c", None), ("two", "u", "d", None), ("part", "u", "c", None), ("part", None, None, None), ("old", None, None, None), ("torn", "u", "c", None), ("torn", None, None, "{bad")]
    df = spark.createDataFrame(rows, "backend string, base_url string, code_version string, _corrupt string")
    got = {r.backend: (r.is_mixed, r.unknown_rows, r.malformed_rows) for r in guards.provenance_audit(df, corrupt="_corrupt").collect()}
    assert got == {"one": (False, 0, 0), "two": (True, 0, 0), "part": (True, 1, 0), "old": (False, 1, 0), "torn": (True, 0, 1)}


def test_parse_reply(spark):
    cases = {
        'x {"verdict": "approve", "reason": "ok"} y': ("approve", "ok", None),
        '{"verdict":\n"reject", "reason": "casing_error"}': ("reject", "casing_error", None),
        '{"verdict": "reject", "reason": "truncation_worse"}': (None, None, "JudgeResponseError"),
        '{"verdict": {"a": 1}, "reason": "ok"}': (None, None, "JudgeResponseError"),
        "nothing": (None, None, "JudgeResponseError"),
        '{"verdict": "approve"': (None, None, "JudgeResponseError"),
        "[]{}": (None, None, "JudgeResponseError"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: tuple(r.p) for r in df.select("t", text.parse_reply(F.col("t")).alias("p")).collect()} == cases


def test_usage(spark):
    cases = {
        '{"usage": {"prompt_tokens": 3, "completion_tokens": 0, "prompt_tokens_details": {"cached_tokens": 0}}}': (3, 0, 3, 0, None),
        '{"usage": {"input_tokens": 2, "output_tokens": 5, "cache_read_input_tokens": 1}}': (2, 5, 7, 1, None),
        '{"usage": {"prompt_tokens": true, "completion_tokens": "7", "total_tokens": 3.5}}': None,
        '{"usage": {}}': None,
        "{}": None,
        "not json": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.u and tuple(r.u) for r in df.select("t", text.usage(F.col("t")).alias("u")).collect()} == cases


def test_retry_and_quota(spark):
    heads = {"5": 5.0, None: 30.0, "-1": 30.0, "inf": 30.0, "nan": 30.0, "soon": 30.0, "900": 300.0}
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert {r.h: r.w for r in df.select("h", text.retry_after(F.lit(429), F.col("h")).alias("w")).collect()} == heads
    one = spark.range(1).select(text.retry_after(F.lit(500), F.lit("5")), text.quota_failure(F.lit(429), F.lit('{"error": {"code": "insufficient_quota"}}')), text.quota_failure(F.lit(429), F.lit("busy")), text.quota_failure(F.lit(500), F.lit('{"error": {"code": "insufficient_quota"}}')), text.quota_failure(F.lit(429), F.lit('{"error": {"type": "quota_exceeded", "message": " Pay up "}}'))).first()
    assert tuple(one) == (None, "insufficient_quota", None, None, "Pay up [quota_exceeded]")
    assert [judge.backoff(h) for h in heads] == list(heads.values())


def test_prompt_parts(spark):
    df = spark.createDataFrame([("B", "M"), ("B", ""), (None, "M"), ("", None)], "brand string, mpn string")
    assert [r[0] for r in df.select(text.prompt_variant(F.col("brand"), F.col("mpn"))).collect()] == ["brand+mpn", "brand", "mpn", "none"]
    said = df.select(text.system_prompt(F.col("brand"), F.col("mpn")), text.user_prompt(F.lit("o"), F.lit("e"), F.col("brand"), F.col("mpn"))).collect()
    assert "known BRAND and MPN (manufacturer part number).\n\nApprove" in said[0][0] and "replacement title.\n\nApprove" in said[3][0]
    assert said[0][1] == "BRAND: B\nMPN: M\nORIGINAL: o\nENRICHED: e" and said[3][1] == "ORIGINAL: o\nENRICHED: e"
    assert text.backend_digest({"name": "x", "rpm": 1, "model_id": "m"}) == text.backend_digest({"name": "y", "model_id": "m"}) != text.backend_digest({"model_id": "n"})
    assert text.config_digest({"b": None, "a": 1}) == text.config_digest({"a": 1, "b": None}) != text.config_digest({"a": 1})


def test_replay_is_no_global_stack(spark):
    acts = [("rule", "A", "approve"), ("rule", "B", "approve"), ("rule", "A", "reject"), ("undo", None, None), ("undo", None, None)]
    df = spark.createDataFrame([("s", i, a, p, g, "ok") for i, (a, p, g) in enumerate(acts)], "session string, seq int, action string, pair_id string, ground_truth string, reason string")
    assert [(r.pair_id, r.ground_truth) for r in journal.replay(df).collect()] == [("B", "approve")]


def test_notes_and_skips(spark):
    rows = [("s", 0, "skip", "A", None), ("s", 1, "skip", "B", None), ("s", 2, "rule", "A", "n1"), ("s", 3, "undo", None, None), ("s", 4, "note", "A", "n2"), ("s", 5, "note", "A", "")]
    df = spark.createDataFrame(rows, "session string, seq int, action string, pair_id string, notes string")
    assert [tuple(r) for r in journal.notes(df).collect()] == [("s", "A", "n2")]
    assert [r.pair_id for r in journal.skipped(df).collect()] == ["B"]


def test_merge_refuses(spark):
    blank = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, original string")
    rulings = lambda *ids: spark.createDataFrame([(i, "approve", "ok") for i in ids], "id string, ground_truth string, reason string")
    assert journal.merge_rulings(blank, rulings("a", "b")).count() == 2
    for ids, word in ((("a", "b", "x"), "unknown"), (("a",), "without")):
        with pytest.raises(GuardError, match=word):
            journal.merge_rulings(blank, rulings(*ids))


def test_records(spark):
    one = spark.range(1)
    r = one.select(records.rule(F.lit("s"), F.lit("p"), F.lit("approve"), F.lit("ok")).alias("r")).first().r
    assert (r.action, r.ground_truth, r.auto, r.elapsed_ms) == ("rule", "approve", False, None) and r.ts.endswith("Z")
    with pytest.raises(Exception, match="fit"):
        one.select(records.rule(F.lit("s"), F.lit("p"), F.lit("approve"), F.lit("casing_error")).alias("r")).collect()
    assert one.select(records.undo(F.lit("s")).alias("r")).first().r.pair_id is None
    assert records.reason_keys(True) == {"1": "casing_error", "2": "overcorrection", "3": "meaning_change"}
    with pytest.raises(GuardError):
        records.allocate_keys("abc", "12")


def verdict_line(**more):
    return json.dumps({"pair_id": "p", "verdict": "approve", "reason": "ok", "model_id": "m", "prompt_version": "v3", "temperature": None} | more)


def test_readers(spark, tmp_path):
    d = tmp_path / "results"
    (d / "sub").mkdir(parents=True)
    (d / "a.jsonl").write_text(verdict_line(usage={"cached_tokens": 0}) + "\n\n" + verdict_line(run_index=1, new_key=1) + "\n")
    (d / "empty.jsonl").write_text("")
    (d / "a.manifest.json").write_text(json.dumps({"model_id": "m", "n_pairs": 7, "health": {"calls_ok": 3, "error_kinds": {"X": 1}}, "cumulative": {}}, indent=1))
    assert [r.backend for r in readers.roster(spark, str(d)).collect()] == ["a", "empty"]
    with pytest.raises(Exception, match="unknown new_key"):
        readers.read_votes(spark, str(d)).collect()
    got = readers.read_votes(spark, str(d), strict=False).orderBy("run_index").collect()
    assert [(r.backend, r.run_index, r.cached_tokens) for r in got] == [("a", 0, 0), ("a", 1, None)]
    m = readers.read_manifests(spark, str(d))
    assert m.first().backend == "a" and m.agg(caveats.manifest_pairs(m)).first()[0] == 7
    c = reliability.manifest_counts(m).first()
    assert (c.scope, c.succeeded, c.error_kinds) == ("last-launch", 3, {"X": 1})
    (d / "sub" / "b.jsonl").write_text("{torn\n" + verdict_line(pair_id="q") + '\n{"pair_id": "x"}\n')
    assert sorted(r.pair_id for r in readers.read_votes_tolerant(spark, str(d)).collect()) == ["p", "p", "q"]
    assert readers.read_votes_tolerant(spark, str(tmp_path / "missing")).count() == 0
    audit = guards.provenance_audit(readers.read_raw(spark, str(d / "sub" / "b.jsonl")).cache(), corrupt="_corrupt").first()
    assert (audit.malformed_rows, audit.total_rows) == (1, 3)


def test_strict_votes(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text(verdict_line(usage={"cached_tokens": 3}, run_index=2) + "\n\n" + verdict_line() + "\n")
    got = readers.read_votes(spark, str(tmp_path)).orderBy("run_index").collect()
    assert [(r.backend, r.run_index, r.cached_tokens, r.temperature) for r in got] == [("a", 0, None, None), ("a", 2, 3, None)]
    whole = json.loads(verdict_line())
    for line, said in ((verdict_line(extra=1), "unknown extra"), (json.dumps({k: v for k, v in whole.items() if k != "temperature"}), "missing temperature"), ('"text"', "no object"), ("{torn", "no object"), (verdict_line(reason="new"), "reason")):
        f.write_text(verdict_line() + "\n" + line + "\n")
        with pytest.raises(Exception, match=said):
            readers.read_votes(spark, str(tmp_path)).collect()


def test_votes_of_unknown_pairs(spark):
    pairs = spark.createDataFrame([("p", 0, "approve", "ok")], "id string, pos long, ground_truth string, reason string")
    v = votes(spark, [("a", "p", 0, "approve", "ok"), ("a", "q", 0, "approve", "ok")])
    assert [r.pair_id for r in score.known_votes(v, pairs).collect()] == ["p"]
    with pytest.raises(GuardError):
        score.known_votes(v.where("pair_id = 'q'"), pairs)
    assert score.known_votes(v.limit(0), pairs).count() == 0


def test_shared_folder_without_a_setting(spark, monkeypatch):
    from verdictlake.sources import shared

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, *a):
            raise AssertionError("not at run time")

    class Context:
        master, applicationId = "local[2]", "app-1"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    first = shared.shared_dir(Session())
    assert shared.shared_dir(Session()) == first
    monkeypatch.setattr(Context, "master", "spark://host:7077")
    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_read_pairs(spark, tmp_path):
    f = tmp_path / "pairs.jsonl"
    f.write_text('{"id": "b", "original": "x y", "enriched": "z"}\n\n{"id": "a", "original": "o", "enriched": "e", "ground_truth": "approve", "reason": "ok"}\n')
    rows = readers.read_pairs(spark, str(f)).orderBy("pos").collect()
    assert [(r.id, r.pos) for r in rows] == [("b", 0), ("a", 2)] and rows[0].original == "x y"
    assert [(r.pair_id, r["rank"]) for r in readers.pair_order(spark, str(f)).orderBy("rank").collect()] == [("b", 0), ("a", 1)]
    f.write_text('{"id": "b", "original": "x", "enriched": "z", "ground_truth": "approve"}\n')
    with pytest.raises(Exception, match="go together"):
        readers.read_pairs(spark, str(f)).collect()


def test_journal_file(spark, tmp_path):
    f = tmp_path / "journal.jsonl"
    line = lambda a, p: json.dumps({"ts": "t", "session": "s", "action": a, "pair_id": p, "ground_truth": "approve", "reason": "ok", "auto": False})
    assert readers.read_journal(spark, str(f)).count() == 0
    f.write_text(line("rule", "a") + "\n" + line("rule", "b") + "\n" + '{"torn')
    rows = readers.read_journal(spark, str(f))
    assert [r.pair_id for r in journal.replay(rows).collect()] == ["a", "b"]
    f.write_text(line("rule", "a") + "\n{bad\n" + line("undo", None) + "\n")
    with pytest.raises(GuardError, match="line 2"):
        readers.read_journal(spark, str(f))


def test_journal_round_trip(spark, tmp_path):
    """Appends follow each other, undo reaches across them, and a file of lines goes before what is appended."""
    folder = str(tmp_path / "journal")
    schema = "session string, seq long, action string, pair_id string, ground_truth string, reason string"
    batches = [[("s", i, "rule", p, g, "ok") for i, (p, g) in enumerate(b)] for b in ([("a", "approve"), ("b", "approve")], [("a", "reject"), ("c", "approve")])]
    for b in batches:
        sinks.append_journal(spark.createDataFrame(b, schema).repartition(2), folder)
    one = spark.createDataFrame([("s", "undo", None, None, None)], schema.replace(" seq long,", ""))
    sinks.append_journal(one, folder)
    sinks.append_journal(one, folder)
    rows = readers.read_journal(spark, folder)
    assert [(r.seq, r.action, r.pair_id) for r in rows.orderBy("seq").collect()] == [(0, "rule", "a"), (1, "rule", "b"), (2, "rule", "a"), (3, "rule", "c"), (4, "undo", None), (5, "undo", None)]
    assert [(r.pair_id, r.ground_truth) for r in journal.replay(rows).orderBy("place").collect()] == [("b", "approve"), ("a", "approve")]
    with pytest.raises(GuardError, match="order"):
        sinks.append_journal(one.union(one), folder)
    old = tmp_path / "old"
    old.mkdir()
    (old / "z.json").write_text('{"action": "rule", "pair_id": "x"}\n\n{"action": "rule", "pair_id": "y"}\n')
    sinks.append_journal(one, str(old))
    assert [r.action for r in readers.read_journal(spark, str(old)).orderBy("seq").collect()] == ["rule", "rule", "undo"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    f = tmp_path / "pairs.jsonl"
    f.write_text("".join(json.dumps({"id": f"p{i}", "original": "x" * (i % 50), "enriched": "y"}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert spark.read.text(str(f)).rdd.getNumPartitions() > 1
        assert all(r.id == f"p{r.pos}" for r in readers.read_pairs(spark, str(f)).collect())
        assert [r.pair_id for r in readers.pair_order(spark, str(f)).orderBy("rank").collect()] == [f"p{i}" for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manifests_beside_results(spark, tmp_path):
    runs = spark.createDataFrame([("a", "m", 7), ("b", "n", 8)], "backend string, model_id string, n_pairs long")
    sinks.write_manifests(runs, str(tmp_path))
    sinks.write_manifests(runs.withColumn("n_pairs", F.col("n_pairs") + 1), str(tmp_path))
    assert sorted((r.backend, r.model_id, r.n_pairs) for r in readers.read_manifests(spark, str(tmp_path)).collect()) == [("a", "m", 8), ("b", "n", 9)]
    assert readers.manifest_beside(spark, str(tmp_path / "b.jsonl")).first().n_pairs == 9
    assert readers.manifest_beside(spark, str(tmp_path / "c.jsonl")).count() == 0
    (tmp_path / "c.manifest.json").write_text("{torn")
    assert readers.manifest_beside(spark, str(tmp_path / "c.jsonl")).count() == 0


@pytest.mark.parametrize("sketch", [20, 100, 50_000])
def test_order_statistics_of_close_values(spark, sketch):
    """Values within a tenth of a second, ties, and groups about as large as the sketch: exact by sketch and bracket."""
    rng = random.Random(sketch)
    groups = {"close": [rng.random() / 10 for _ in range(5000)], "ties": [rng.choice([0.01, 0.02, 0.02, 0.03]) for _ in range(3000)], "one": [0.5], "two": [0.1, 0.9], "same": [0.25] * 999}
    groups |= {f"n{n}": [rng.gauss(0, 1) for _ in range(n)] for n in (sketch - 1, sketch, sketch + 1, sketch + 2) if n < 1000}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("close", None)] * 5
    rng.shuffle(rows)
    got = {r.g: r for r in reliability.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", sketch).collect()}
    for g, vs in groups.items():
        v, n = sorted(vs), len(vs)
        assert (got[g].n, got[g].low, got[g].high, got[g].tail) == (n, v[(n + 1) // 2 - 1], v[n // 2], v[-(-19 * n // 20) - 1])


def test_latencies_are_exact(spark):
    rng = random.Random(2)
    rows = [(b, int(rng.random() < 0.7), rng.choice([0.1, 0.1, 3.0, round(rng.expovariate(0.3), 3)])) for b in "abc" for _ in range(rng.choice([1, 40, 301]))] + [("d", 0, 2.5), ("e", 1, None)]
    got = {r.backend: r for r in reliability.latencies(spark.createDataFrame(rows, "backend string, ok int, latency_s double"), "backend").collect()}
    for b in "abcde":
        for ok, names in ((1, ("latency_min", "latency_median", "latency_max")), (0, (None, "failed_latency_median", "failed_latency_max"))):
            x = sorted(v for k, o, v in rows if k == b and o == ok and v is not None)
            want = (x[0], (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2, x[-1]) if x else (None, None, None)
            assert [got[b][n] for n in names if n] == [pytest.approx(w) if w is not None else None for n, w in zip(names, want) if n]
            if ok:
                assert got[b].latency_p95 == (x[-(-len(x) * 19 // 20) - 1] if x else None)


def test_qa_pack_and_template(spark, tmp_path):
    f = tmp_path / "pack.md"
    f.write_text("# Pack\nprose | with | pipes\n| Cohort | Source | Before | After | Stages |\n| --- | :-: | --- | --- | --- |\n| casing | feed | a b | A B | clean, brand |\n|\tx |s|  o|n | — |\n| a | b | c | d | e | f |\n")
    rows = readers.read_qa_pack(spark, str(f)).orderBy("pos").collect()
    assert [(r.cohort, r.before, r.after, list(r.stages)) for r in rows] == [("casing", "a b", "A B", ["clean", "brand"]), ("x", "o", "n", [])]
    pack = readers.read_qa_pack(spark, str(f))
    ids = [r[0] for r in pack.select(text.row_id(F.col("before"), F.col("after"))).collect()]
    extra = spark.createDataFrame([(ids[0], "Old", None, 0), (ids[0], "Acme", "", 1)], "id string, brand string, mpn string, pos long")
    lines = [json.loads(r.value) for r in sinks.template(pack, extra).collect()]
    by = {x["id"]: x for x in lines}
    assert by[ids[0]]["brand"] == "Acme" and "mpn" not in by[ids[0]] and by[ids[0]]["ground_truth"] is None and "brand" not in by[ids[1]]
    assert {r.cohort: r.rows for r in caveats.cohort_counts(pack).collect()} == {"casing": 1, "x": 1}


def test_sinks(spark, tmp_path):
    v = votes(spark, EDGE)
    for _ in range(2):
        sinks.append_votes(v, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 * len(EDGE)
    # what is appended is read again, beside files of other backends
    whole = v.limit(2).withColumns({"backend": F.lit("a/b 1"), "model_id": F.lit("m"), "prompt_version": F.lit("v3"), "run_index": F.lit(1).cast("long")})
    folder = tmp_path / "results"
    for _ in range(2):
        sinks.append_votes(whole, str(folder))
    (folder / "z.jsonl").write_text('{"pair_id": "p", "verdict": "approve", "reason": "ok", "model_id": "m", "prompt_version": "v3", "temperature": null}\n\n')
    (folder / "empty.jsonl").write_text("")
    assert [r.backend for r in readers.roster(spark, str(folder)).orderBy("backend").collect()] == ["a/b 1", "empty", "z"]
    for strict in (True, False):
        got = readers.read_votes(spark, str(folder), strict).collect()
        assert Counter(r.backend for r in got) == {"a/b 1": 4, "z": 1} and {r.run_index for r in got if r.backend != "z"} == {1}


def test_pair_lines_round_trip(spark, tmp_path):
    rows = [("a", 0, "x", "y", "", "M", "approve", "ok"), ("b", 1, "é", "z", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, pos long, original string, enriched string, brand string, mpn string, ground_truth string, reason string")
    lines = [r.value for r in sinks.pair_lines(df).orderBy("pos").collect()]
    assert "brand" not in lines[0] and set(json.loads(lines[1])) == {"id", "original", "enriched"}
    (tmp_path / "pairs.jsonl").write_text("\n".join(lines))
    back = readers.read_pairs(spark, str(tmp_path / "pairs.jsonl")).orderBy("pos").collect()
    assert [(r.id, r.mpn, r.ground_truth) for r in back] == [("a", "M", "approve"), ("b", None, None)]
    with pytest.raises(Exception, match="go together"):
        bad = df.withColumn("reason", F.lit(None).cast("string"))
        (tmp_path / "bad.jsonl").write_text(sinks.pair_lines(bad).first().value)
        readers.read_pairs(spark, str(tmp_path / "bad.jsonl")).collect()


def test_exports(spark, tmp_path):
    standing = spark.createDataFrame([("s", 0, "p", "approve", "ok")], "session string, place int, pair_id string, ground_truth string, reason string")
    sinks.export_rulings(standing, str(tmp_path / "rulings"))
    sinks.export_notes(spark.createDataFrame([("s", "p", "n")], "session string, pair_id string, notes string"), str(tmp_path / "notes"))
    assert spark.read.json(str(tmp_path / "rulings")).first().asDict() == {"id": "p", "ground_truth": "approve", "reason": "ok"}
    assert spark.read.json(str(tmp_path / "notes")).first().notes == "n"


SLATE = """
[[backends]]
name = "x-1"
base_url = "https://h.example/v1/"
model_id = "m"
rpm = 60000
eval_only = false
[[backends]]
name = "y"
base_url = "https://h.example/v1"
model_id = "n"
rpm = 90000
eval_only = true
reasoning_effort = "none"
structured_output = true
api = "anthropic"
"""


def test_judge_connector(spark, tmp_path):
    def fake(backend, body):
        said = json.loads(body)
        if backend["backend"] == "y":
            assert "system" in said and said["thinking"] == {"type": "disabled"} and said["output_config"]["format"]["type"] == "json_schema" and backend["path"] == "/messages"
            return 200, json.dumps({"content": [{"type": "thinking"}, {"type": "text", "text": '{"verdict": "reject", "reason": "casing_error"}'}]})
        if "bad" in said["messages"][1]["content"]:
            raise TimeoutError
        return 200, json.dumps({"choices": [{"message": {"content": 'Well: {"verdict": "approve", "reason": "ok"}'}}]})

    (tmp_path / "slate.toml").write_text(SLATE)
    s = readers.read_slate(spark, str(tmp_path / "slate.toml"))
    assert {(r.name, r.base_url, r.api_key_env) for r in s.collect()} == {("x-1", "https://h.example/v1", "X_1_API_KEY"), ("y", "https://h.example/v1", "Y_API_KEY")}
    todo = spark.createDataFrame([("p", 0, "a", "A", None, None, 0), ("q", 0, "bad", "B", "br", None, 1)], "pair_id string, run_index int, original string, enriched string, brand string, mpn string, pos long")
    log = judge.judge(todo, s, fake).cache()
    got = {(r.backend, r.pair_id): (r.ok, r.error_kind) for r in log.collect()}
    assert got == {("x-1", "p"): (1, None), ("x-1", "q"): (0, "TimeoutError"), ("y", "p"): (1, None), ("y", "q"): (1, None)}
    assert sorted((r.backend, r.pair_id, r.verdict) for r in judge.verdicts(log).collect()) == [("x-1", "p", "approve"), ("y", "p", "reject"), ("y", "q", "reject")]
    assert slate.render(slate.check_keys(s, {"Y_API_KEY": "k"})).startswith("FAIL x-1")
    kept, missing = slate.with_keys(s, {"Y_API_KEY": "k"}, keep_going=True)
    assert [r.name for r in kept.collect()] == ["y"] and missing == ["x-1"]
    with pytest.raises(GuardError):
        slate.with_keys(s, {})
    assert slate.code_version(".", lambda *a: "abcdef0123456789" if a[0] == "rev-parse" else "") == "abcdef012345"


def test_limiter():
    now, slept = [0.0], []
    limit = judge.Limiter(60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limit.wait()
    limit.penalize(10)
    limit.penalize(1)
    limit.wait()
    assert slept == [1.0, 1.0, 10.0]


def test_limiter_spaces_threads():
    import threading
    import time

    limit, starts = judge.Limiter(60 * 50), []

    def call():
        for _ in range(3):
            limit.wait()
            starts.append(time.monotonic())

    threads = [threading.Thread(target=call) for _ in range(8)]
    for t in threads:
        t.start()
    time.sleep(0.1)
    limit.penalize(0.3)
    barred = time.monotonic()
    for t in threads:
        t.join()
    starts.sort()
    assert len(starts) == 24 and all(b - a > 0.012 for a, b in zip(starts, starts[1:]))
    assert not [t for t in starts if barred + 0.01 < t < barred + 0.29]


def test_billing_refusals():
    error = lambda **e: json.dumps({"error": e})
    assert judge.billing_refusal(error(type="insufficient_quota")) and judge.billing_refusal(error(code="billing_not_active"))
    assert not any(map(judge.billing_refusal, (error(type="rate_limit", message="insufficient_quota"), "insufficient_quota", '{"error": "insufficient_quota"}', "[]", "")))


def todo_of(spark, n):
    return spark.createDataFrame([(f"p{i}", 0, "a", "A", None, None, i) for i in range(n)], "pair_id string, run_index int, original string, enriched string, brand string, mpn string, pos long").coalesce(1)


def test_judge_of_one_backend_and_stop(spark, tmp_path):
    (tmp_path / "slate.toml").write_text(SLATE)
    s = readers.read_slate(spark, str(tmp_path / "slate.toml"))
    fake = lambda backend, body: (200, json.dumps({"choices": [{"message": {"content": "x"}}]}))
    only = todo_of(spark, 3).withColumn("backend", F.lit("x-1"))
    assert {r.backend for r in judge.judge(only, s, fake).collect()} == {"x-1"}
    assert judge.judge(only, s, fake, stop=lambda: True).count() == 0


def test_streams(spark, tmp_path):
    votes(spark, EDGE).repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(twins.run_to_end(spark, twins.stream_tally(stream))) == key(tally(votes(spark, EDGE)))
    doubled = stream.union(spark.readStream.schema(VOTES).json(str(tmp_path / "in")))
    assert twins.run_to_end(spark, twins.stream_dedupe(doubled), "append").count() == len(EDGE)


def test_reports(spark, sf):
    v, p, r, c = (fixtures.view(spark, sf, n) for n in ("votes", "pairs", "roster", "calls"))
    board = report.leaderboard(v, p.where("pos < 60"), r, 50)
    assert board.startswith("# Leaderboard") and "Not ranked" in board and "m6" in board
    order = p.select(F.col("id").alias("pair_id"), F.col("pos").alias("rank"))
    text_ = report.scenario(v, r, c, order, "s1")
    heads = [line[3:] for line in text_.splitlines() if line.startswith("## ")]
    assert heads[:6] == ["Are votes independent?", "Deadlocks", "Reliability", "Replies that broke the contract", "Completion", "Coverage"] and heads[-1] == "Ruling queue"
    assert text_ == report.scenario(v.repartition(5), r, c.repartition(3), order, "s1")
    row = agreement.pooled_flips(v).first().asDict()
    assert "of" in report.flip_pane(row) and report.flip_pane(None) == "not judged yet"
    assert report.number(0.0625) == "0.062" and report.number(None) == "-"


def test_places_over_ranges(spark):
    from verdictlake.operators.ranking import placed

    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.floor(F.col("id") / 100).alias("r"))
    got = [r.id for r in placed(rows, [("g", True), ("r", False)], ["id"]).orderBy("place").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i % 3), i))


def test_run_manifest(spark, tmp_path):
    from verdictlake.operators import manifest

    (tmp_path / "slate.toml").write_text(SLATE)
    s = readers.read_slate(spark, str(tmp_path / "slate.toml"))
    calls = spark.createDataFrame([("x-1", 1, 1.0, None), ("x-1", 1, 3.0, None), ("x-1", 0, 9.0, "ReadTimeout"), ("y", 0, 1.0, "X")], "backend string, ok int, latency_s double, error_kind string")
    pairs = spark.createDataFrame([("B", None), (None, None)], "brand string, mpn string")
    now = manifest.health(calls)
    health_type = now.schema["health"].dataType.simpleString()
    before = spark.createDataFrame([], f"backend string, identity struct<model_id:string>, launches array<{health_type}>")
    before = before.union(now.where("backend = 'x-1'").select("backend", F.struct(F.lit("m").alias("model_id")), F.array("health")))
    got = {r.backend: r for r in manifest.run_manifest(s, calls, pairs, before, {"code_version": "c"}).collect()}
    x = got["x-1"]
    assert (x.health.latency_median, x.health.latency_p95, x.cumulative.launches, x.cumulative.calls_ok, x.cumulative.error_kinds) == (2.0, 3.0, 2, 4, {"ReadTimeout": 2})
    assert got["y"].health.latency_median is None and x.prompt_variants == {"brand": 1, "none": 1} and x.n_pairs == 2
    json.loads(sinks.manifest_line(manifest.run_manifest(s, calls, pairs, before, {})).first().value)


def ordered(rows):
    by = {}
    for r in rows:
        by.setdefault(r.session, []).append((r.place, r.pair_id, r.ground_truth, r.reason))
    return {s: [x[1:] for x in sorted(v)] for s, v in by.items()}


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 3, 40, 41, 90]])
def test_stream_replay(spark, tmp_path, cuts):
    """Any split of the journals into batches gives what one replay gives, and a restart goes on from its state."""
    rng, events = random.Random(11), []
    for seq in range(120):
        events.append((rng.choice(["s", "t"]), seq, rng.choice(["rule", "rule", "rule", "undo", "skip"]), rng.choice("abcdef") if rng.random() < 0.95 else None, rng.choice(["approve", "reject"]), "ok"))
    events += [("u", 200 + i, "undo", None, None, None) for i in range(3)] + [("u", 203, "rule", "z", "approve", "ok"), ("u", 204, "undo", None, None, None)]
    schema = "session string, seq long, action string, pair_id string, ground_truth string, reason string"
    folder, changes = str(tmp_path / "in"), None
    for a, b in zip([0, *cuts], [*cuts, len(events)]):
        spark.createDataFrame(events[a:b], schema).coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema(schema).json(folder)
        part = twins.run_to_end(spark, twins.stream_replay(stream), "update", str(tmp_path / "checkpoint"))
        changes = part if changes is None else changes.union(part)
        if b - a < 3:
            assert part.count() <= b - a  # not the whole journal again
    want = ordered(journal.replay(spark.createDataFrame(events, schema)).collect())
    assert ordered(twins.standing(changes).collect()) == want and len(want["s"]) > 1


def test_command_line(spark, tmp_path):
    from verdictlake import cli

    d = tmp_path / "run1"
    d.mkdir()
    pairs = [{"id": f"p{i}", "original": "o", "enriched": "e", "ground_truth": "reject" if i % 3 == 0 else "approve", "reason": "casing_error" if i % 3 == 0 else "ok"} for i in range(12)]
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, pairs)))
    for name, wrong in (("good", 0), ("half", 2)):
        lines = [verdict_line(pair_id=p["id"], run_index=r, verdict=v, reason="ok" if v == "approve" else "casing_error") for i, p in enumerate(pairs) for r in range(3) for v in ["approve" if (p["ground_truth"] == "approve") != bool(wrong and i % wrong == 1) else "reject"]]
        (d / f"{name}.jsonl").write_text("\n".join(lines))
    (d / "none.jsonl").write_text("")
    (d / "good.manifest.json").write_text(json.dumps({"health": {"calls_ok": 36, "calls_failed": 2, "latency_median": 1.5}, "cumulative": {"launches": 2, "calls_ok": 36, "calls_failed": 44, "error_kinds": {"ReadTimeout": 40, "JudgeResponseError": 3, "QuotaExhausted": 1}}}))
    assert cli.main(["score", str(tmp_path / "pairs.jsonl"), str(d), str(tmp_path / "board.md")]) == 0
    board = (tmp_path / "board.md").read_text()
    assert "| good | 1.000 |" in board and "none" in board
    assert cli.main(["report", str(d), str(tmp_path / "pairs.jsonl"), str(tmp_path / "report.md")]) == 0
    said = (tmp_path / "report.md").read_text()
    assert "# Scenario run1" in said and "| good | 36 | 80 | 44 | 2.22 | 40 | unusable |" in said and "| half | 36 | - | - | - | 0 | unknown |" in said
    assert "Could not bill at times: good." in said and "- good: 3 beside 36 good ones" in said and "2 of 38" in said
    (tmp_path / "journal.jsonl").write_text(json.dumps({"action": "rule", "pair_id": "p", "ground_truth": "approve", "reason": "ok"}) + "\n")
    assert cli.main(["rulings", str(tmp_path / "journal.jsonl"), str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).first().id == "p"
    assert cli.main([]) == 2
