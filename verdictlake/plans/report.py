"""Markdown reports: small aggregates gathered and formatted on the driver.

Numbers are formatted by Python, whose rounding the engines do not share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, bootstrap, caveats, reliability, score
from ..operators.tally import ROWS, stability, tally
from ..schema import RETIRED_REASONS
from ..sources.files import delete
from ..sources.shared import shared_dir

DASH = "-"


#: Ids of a list that a report shows; the whole list is a query's.
PAGE = 40


def number(x: float | None, digits: int = 3) -> str:
    """Rounded to six digits first, so that a sum's last bit, which depends on the order of rows, cannot show."""
    return DASH if x is None else f"{round(x, 6):.{digits}f}"


def seconds(x: float | None) -> str:
    return DASH if x is None else f"{number(x, 2)}s"


def table(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def section(title: str, *parts: str) -> str:
    return "\n\n".join([f"## {title}", *[p for p in parts if p]])


def leaderboard(votes: DataFrame, pairs: DataFrame, roster: DataFrame, resamples: int = bootstrap.RESAMPLES) -> str:
    """Ranked tiers of fully covered backends, unstable pairs, the others, confusion of reasons. Votes of unknown pairs alone are an error."""
    votes = score.known_votes(votes, pairs)
    judged = score.judged(votes, pairs).cache()
    try:
        return _leaderboard(votes, pairs, roster, judged, resamples)
    finally:
        judged.unpersist()


def unstable_pages(judged: DataFrame) -> DataFrame:
    """Unstable pairs page by page, from 0: backend, n of the backend, page, and the ids of a page in a line."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "pair_id"))), lambda x: x["pair_id"]), ",")
    page = F.floor((F.col("place") - 1) / PAGE).alias("page")
    return score.unstable_pairs(judged).groupBy("backend", "n", page).agg(ids.alias("ids"))


def _leaderboard(votes: DataFrame, pairs: DataFrame, roster: DataFrame, judged: DataFrame, resamples: int) -> str:
    scores = caveats.full_coverage(score.score_models(votes, pairs, roster, judged))
    items = judged.where("verdict is not null").select("backend", "pos", F.col("ground_truth").alias("truth"), F.col("verdict").alias("predicted"))
    kappas = score.cohens_kappa(items, "truth", "predicted", ("backend",)).drop("n").join(bootstrap.bootstrap_kappa(items, resamples), "backend")
    spread = score.mean_sd(score.per_run_kappas(votes, pairs), "kappa")
    ranked = bootstrap.tiers(scores.where("ranked").select("backend").join(kappas, "backend"))
    rows = ranked.join(scores, "backend").join(spread, "backend").orderBy("tier", F.col("kappa").desc(), "backend").collect()
    sizes = {t: sum(r["tier"] == t for r in rows) for t in {r["tier"] for r in rows}}
    place = lambda r: f"{r['tier']} (not separable)" if sizes[r["tier"]] > 1 else str(r["tier"])
    body = [[place(r), r["backend"], number(r["kappa"]), f"{number(r['lo'])} to {number(r['hi'])}", f"{number(r['sd'])} (n={r['n_runs']})", number(r["accuracy"]), number(r["false_approve_rate"]), r["n"], r["unsettled_verdict"], r["unsettled_reason"]] for r in rows]
    head = ["Tier", "Backend", "Kappa", "95% interval", "Run sd", "Accuracy", "False approve", "Scored", "No verdict", "No reason"]
    out = ["# Leaderboard", table(head, body) if body else "No backend judged every pair."]
    unstable = unstable_pages(judged).where("page = 0").orderBy("backend").collect()
    out.append(section("Unstable pairs", *[f"- {r['backend']}: {r['n']} ({r['ids']}{', ...' if r['n'] > PAGE else ''})" for r in unstable]) if unstable else "")
    rest = scores.where("not ranked").orderBy(F.col("coverage").desc(), "backend").collect()
    out.append(section("Not ranked", table(["Backend", "Pairs judged", "Coverage"], [[r["backend"], r["judged"], number(r["coverage"])] for r in rest])) if rest else "")
    cells = score.reason_confusion(judged).orderBy("backend", F.col("pairs").desc(), "true_reason", "reason").collect()
    out.append(section("Reasons", table(["Backend", "True", "Ruled", "Pairs"], [[r["backend"], r["true_reason"], r["reason"], r["pairs"]] for r in cells])) if cells else "")
    retired = caveats.on_retired_axis(score.reason_confusion(judged)).count()
    out.append(f"{retired} cells of the table above have a reason that is no longer offered." if retired else "")
    return "\n\n".join(p for p in out if p) + "\n"


def scenario(votes: DataFrame, roster: DataFrame, calls: DataFrame | None, order: DataFrame, leg: str, queue: int = 40, manifests: DataFrame | None = None, votes_per_pair: int = 3) -> str:
    """What can be said without ground truth; warnings about the data come before the figures.

    How calls went comes from the call log, or where there is none from the manifests.
    """
    if (calls is None) == (manifests is None):
        raise ValueError("either a call log or manifests")
    spark = votes.sparkSession
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    kept = lambda df, name: written(df, f"{folder}/{name}")
    try:
        held = None if manifests is None else kept(manifests, "manifests")
        return "\n\n".join(p for p in _scenario(kept(tally(votes), "tally"), kept(facts(votes), "facts"), roster, calls, order, leg, queue, held, votes_per_pair) if p) + "\n"
    finally:
        delete(spark, folder)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The rows as a table in the folder: a cached plan is not found again in every plan made of it, and then it is computed anew."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def facts(votes: DataFrame) -> DataFrame:
    """What the report says of single votes, in one pass: a row per backend, prompt version and retired reason, n its votes; what it says of pairs is the tally's."""
    gone = F.when(F.col("reason").isin(*RETIRED_REASONS), F.col("reason")).alias("reason")
    return votes.groupBy("backend", "prompt_version", gone).agg(F.count("*").alias("n"), F.count("cached_tokens").alias("measuring"), F.count_if(F.col("cached_tokens") > 0).alias("hits"), F.min(F.nullif("base_url", F.lit(""))).alias("base_url"))


def _scenario(t, said, roster, calls, order, leg, queue, manifests, votes_per_pair) -> list[str]:
    tasks = -(-t.count() // ROWS)
    by_pair = t.repartition(tasks, "pair_id") if tasks > 1 else t
    out = [f"# Scenario {leg}"]
    hits = said.groupBy("backend").agg(F.sum("measuring").alias("measuring"), F.sum("hits").alias("hits"), F.sum("n").alias("total_calls"))
    cache = agreement.cache_findings(said, t, hits).orderBy("backend").collect()
    if any(r["repeated_pairs"] for r in cache):
        shown = [[r["backend"], r["status"], r["repeated_pairs"], number(r["verdict_flip"]), f"{r['hits']}/{r['measuring']}"] for r in cache]
        bad = [r["backend"] for r in cache if r["status"] == "collapse_suspected"]
        out.append(section("Are votes independent?", f"Answers look cached: {', '.join(bad)}." if bad else "No sign of cached answers.", table(["Backend", "Status", "Repeated pairs", "Flip rate", "Cache hits"], shown)))
    tied = agreement.deadlocks(t, leg)
    ties = tied.orderBy("backend", "pair_id", "axis_order").limit(queue).collect()
    if ties:
        out.append(section("Deadlocks", table(["Backend", "Pair", "Axis", "Split"], [[r["backend"], r["pair_id"], r["kind"], r["split"]] for r in ties]), f"{tied.count()} in all."))
    rel = (reliability.reliability(said, calls, t) if manifests is None else reliability.manifest_reliability(said, manifests, t)).orderBy("backend").collect()
    verdict = lambda r: "unknown" if r["unusable_at_scale"] is None else ("unusable" if r["unusable_at_scale"] else "usable")
    out.append(section("Reliability", table(["Backend", "Rows", "Attempts", "Failed", "Attempts per vote", "Timeouts", "At scale"], [[r["backend"], r["rows_on_disk"], r["attempted"] if r["attempted"] is not None else DASH, r["failed"] if r["failed"] is not None else DASH, number(r["attempts_per_vote"], 2), r["timeouts"], verdict(r)] for r in rel])))
    billed = [r["backend"] for r in rel if r["quota_failures"]]
    out.append(f"Could not bill at times: {', '.join(billed)}." if billed else "")
    broke = [r for r in rel if r["contract_failures"]]
    out.append(section("Replies that broke the contract", *[f"- {r['backend']}: {r['contract_failures']} beside {r['succeeded']} good ones" for r in broke]) if broke else "")
    total = order.select("pair_id")
    if manifests is not None:  # the run may have had more pairs than the file has now
        asked = manifests.agg(caveats.manifest_pairs(manifests).alias("n")).first()["n"]
        total = total.sparkSession.range(asked) if asked else total
    done = reliability.completion(said, roster, votes_per_pair, total, manifests, t).orderBy("backend").collect()
    failed = lambda r: "" if manifests is None or r["calls_failed"] is None else f"{r['calls_failed']} of {r['calls_failed'] + (r['calls_ok'] or 0)}"
    out.append(section("Completion", table(["Backend", "Rows", "Asked for", "Pairs", "Failed calls of the last launch"], [[r["backend"], r["n_rows"], r["expected_rows"], r["n_pairs"], failed(r) or DASH] for r in done])))
    shapes = [r for r in reliability.coverage_shapes(by_pair, order).orderBy("backend").collect() if r["shape"] != "complete"]
    if shapes:
        out.append(section("Coverage", "These backends' figures describe a part of the pairs only.", table(["Backend", "Pairs", "Of", "Reaches", "Shape"], [[r["backend"], r["distinct_pairs"], r["total_pairs"], r["span"], r["shape"]] for r in shapes])))
    st = stability(t, roster).orderBy("backend").collect()
    out.append(section("Stability", table(["Backend", "Pairs", "Votes", "Verdict flip", "Reason flip", "Unstable"], [[r["backend"], r["pairs"], r["max_votes"], number(r["verdict_flip"]), number(r["reason_flip"]), r["unstable_pairs"]] for r in st])))
    names = [r["backend"] for r in st]
    cells = {(r["backend"], r["other"]): r["agreement"] for r in agreement.agreement_matrix(t, roster, tasks=tasks).collect()}
    out.append(section("Agreement", table(["", *names], [[a, *[number(cells[a, b], 2) for b in names]] for a in names])))
    cross = agreement.reason_cross_tab(t, tasks).orderBy(F.col("pairs").desc(), "left", "right", "left_reason", "right_reason").limit(queue).collect()
    out.append(section("Reasons side by side", table(["Left", "Right", "Left reason", "Right reason", "Pairs"], [[r["left"], r["right"], r["left_reason"], r["right_reason"], r["pairs"]] for r in cross])))
    dist = agreement.reason_distribution(t).orderBy("backend", F.col("pairs").desc(), "reason").collect()
    out.append(section("Reasons", table(["Backend", "Reason", "Pairs"], [[r["backend"], r["reason"], r["pairs"]] for r in dist])))
    if manifests is None:
        health = reliability.health_summary(calls, "backend").orderBy("backend").collect()
    else:
        kinds = F.array_join(F.transform(F.array_sort(F.map_entries("health.error_kinds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
        health = manifests.where("health is not null").select("backend", "health.*", kinds.alias("kinds")).drop("error_kinds").withColumnRenamed("kinds", "error_kinds").orderBy("backend").collect()
    out.append(section("Calls", table(["Backend", "Ok", "Failed", "Median", "p95", "Max", "Failed median", "Errors"], [[r["backend"], r["calls_ok"], r["calls_failed"], *[seconds(r[c]) for c in ("latency_median", "latency_p95", "latency_max", "failed_latency_median")], r["error_kinds"] or DASH] for r in health])))
    hosts = reliability.host_concentration(said, manifests).orderBy(F.col("backends").desc(), "names").collect()
    out.append(section("Hosts", f"{hosts[0]['names']} share {hosts[0]['host']}." if hosts and hosts[0]["backends"] > 1 else "No host is shared." if hosts else "Hosts are not known."))
    gone = caveats.retired_votes(said, F.col("n")).orderBy("prompt_version").collect()
    out.append(section("Retired reasons", *[f"- {r['prompt_version']}: {r['votes']} votes of {r['backends']}" for r in gone]) if gone else "")
    top = agreement.contention_top(by_pair, queue).collect()
    out.append(section("Ruling queue", table(["Pair", "Contention", "Models", "Unsettled"], [[r["pair_id"], number(r["contention"]), r["n_models"], r["n_unsettled"]] for r in sorted(top, key=lambda r: (-r["contention"], r["pair_id"]))])) if top else "Nothing is contested.")
    return out


def flip_pane(row: dict | None) -> str:
    """One pair's votes, for a person about to rule."""
    if row is None:
        return "not judged yet"
    said = ", ".join(f"{v} {row[f'n_verdict_{v}']}" for v in ("approve", "reject") if row[f"n_verdict_{v}"])
    return f"{row['verdict'] or 'no majority'} of {row['n_votes']} ({said}); flips {number(row['verdict_flip_rate'], 2)}; {row['models']}"


def card(pair: dict, diff: str, pane: str, place: int, total: int) -> str:
    known = ", ".join(f"{k} {pair[k]}" for k in ("brand", "mpn") if pair.get(k))
    return "\n".join([f"[{place}/{total}] {pair['id']}" + (f" ({known})" if known else ""), diff, f"  judges: {pane}"])


def session_stats(row: dict) -> str:
    return f"{row['decisions']} decisions, {row['skipped']} skipped, {row['undone']} undone, {number(row['decisions_per_minute'], 1)} a minute"
