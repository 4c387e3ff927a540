"""The markdown reports, line by line, against lines that SQL makes of the figures' own queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score
from ..sources.fixtures import view
from . import report
from .catalog import ORACLES, RETIRED, manifests, query

UNSTABLE = "Unstable pairs"
LINES = "nth int, section string, place int, line string"


def lines(text: str) -> list[tuple[int, str, int, str]]:
    """(number of the section, its title, place in it, line) without blank lines and heads of tables."""
    out, nth, title, place = [], 0, "", 0
    kept = [x for x in text.splitlines() if x]
    for line, after in zip(kept, [*kept[1:], ""], strict=True):
        if line.startswith("#"):
            nth, title, place = nth + 1, line.lstrip("# "), 0
        elif not line.startswith("| --- ") and not after.startswith("| --- "):
            place += 1
            out.append((nth, title, place, line))
    return out


def sections(parts: dict[tuple[int, str], str]) -> str:
    """SQL of all sections; each part's SQL gives (o, line), o its order."""
    return " union all ".join(f"select {nth} as nth, '{title}' as section, cast(row_number() over (order by o) as integer) as place, line from ({sql}) x{nth}" for (nth, title), sql in parts.items())


def row(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


def number(x: str, digits: int = 3, unit: str = "") -> str:
    return f"coalesce(printf('%.{digits}f{unit}', {x}), '-')"


def of(name: str) -> str:
    return f"({ORACLES[name]}) {name}_"


#: Sections are counted with the title of the whole.
SCENARIO = {
    (2, "Are votes independent?"): f"select 0 as o0, '' as o, coalesce('Answers look cached: ' || string_agg(backend, ', ' order by backend) filter (status = 'collapse_suspected') || '.', 'No sign of cached answers.') as line from {of('cache_findings')} union all select 1, backend, {row('backend', 'status', 'repeated_pairs', number('verdict_flip'), "hits || '/' || measuring")} from {of('cache_findings')}",
    (3, "Deadlocks"): f"select * from (select (backend, pair_id, axis_order) as o, {row('backend', 'pair_id', 'kind', 'split')} as line from {of('backend_deadlocks')} order by o limit 40) union all select ('~', '~', 0), count(*) || ' in all.' from {of('backend_deadlocks')}",
    (4, "Reliability"): f"select backend as o, {row('backend', 'rows_on_disk', "coalesce(attempted :: varchar, '-')", "coalesce(failed :: varchar, '-')", number('attempts_per_vote', 2), 'timeouts', "case when unusable_at_scale is null then 'unknown' when unusable_at_scale then 'unusable' else 'usable' end")} as line from {of('reliability_rows')} union all select '~', 'Could not bill at times: ' || string_agg(backend, ', ' order by backend) || '.' from {of('reliability_rows')} where quota_failures > 0",
    (5, "Replies that broke the contract"): f"select backend as o, '- ' || backend || ': ' || contract_failures || ' beside ' || succeeded || ' good ones' as line from {of('reliability_rows')} where contract_failures > 0",
    (6, "Completion"): f"select backend as o, {row('backend', 'n_rows', 'expected_rows', 'n_pairs', "'-'")} as line from {of('completion')}",
    (7, "Coverage"): f"select '' as o, 'These backends'' figures describe a part of the pairs only.' as line union all select backend, {row('backend', 'distinct_pairs', 'total_pairs', 'span', 'shape')} from {of('coverage_shapes')} where shape <> 'complete'",
    (8, "Stability"): f"select backend as o, {row('backend', 'pairs', 'max_votes', number('verdict_flip'), number('reason_flip'), 'unstable_pairs')} as line from {of('stability_by_backend')}",
    (9, "Agreement"): f"select backend as o, {row('backend', f"string_agg({number('agreement', 2)}, ' | ' order by other)")} as line from {of('agreement_matrix')} group by backend",
    (10, "Reasons side by side"): f"""select * from (select (-pairs, "left", "right", left_reason, right_reason) as o, {row('"left"', '"right"', 'left_reason', 'right_reason', 'pairs')} as line from {of('reason_cross_tab')} order by o limit 40)""",
    (11, "Reasons"): f"select (backend, -pairs, reason) as o, {row('backend', 'reason', 'pairs')} as line from {of('reason_distribution')}",
    (12, "Calls"): f"select backend as o, {row('backend', 'calls_ok', 'calls_failed', *[number(c, 2, 's') for c in ('latency_median', 'latency_p95', 'latency_max', 'failed_latency_median')], "coalesce(nullif(error_kinds, ''), '-')")} as line from {of('health_summary')}",
    (13, "Hosts"): f"select 0 as o, names || ' share ' || host || '.' as line from (select * from {of('host_concentration')} order by backends desc, names limit 1)",
    (14, "Ruling queue"): f"select (-contention, pair_id) as o, {row('pair_id', number('contention'), 'n_models', 'n_unsettled')} as line from {of('contention_top40')}",
}
SCENARIO[2, "Are votes independent?"] = f"select (o0, o) as o, line from ({SCENARIO[2, 'Are votes independent?']})"

SCORED = f"(select s.*, f.ranked from {of('score_models')[:-len('score_models_')]} s join {of('full_coverage')[:-len('full_coverage_')]} f on f.backend = s.backend)"
LEADERBOARD = {
    (1, "Leaderboard"): f"select (-kappa, s.backend) as o, {row('s.backend', number('kappa'), number('accuracy'), 's.n', 'unsettled_verdict', 'unsettled_reason')} as line from {SCORED} s join {of('kappa_majority')} on kappa_majority_.backend = s.backend where ranked",
    (2, "Unstable pairs"): f"select (backend, page) as o, case when page = 0 then '- ' || backend || ': ' || n || ' (' || ids || case when n > {report.PAGE} then ', ...' else '' end || ')' else '- ' || backend || ', from ' || (page * {report.PAGE} + 1) || ': ' || ids end as line from (select backend, n, (place - 1) // {report.PAGE} as page, string_agg(pair_id, ',' order by place) as ids from {of('unstable_pairs')} group by all) pages",
    (3, "Not ranked"): f"select (-coverage, backend) as o, {row('backend', 'judged', number('coverage'))} as line from {SCORED} s where not ranked",
    (4, "Reasons"): f"select (backend, -pairs, true_reason, reason) as o, {row('backend', 'true_reason', 'reason', 'pairs')} as line from {of('reason_confusion')}",
}
#: What a report says of calls when manifests say it, and of reasons that are gone.
FROM_MANIFESTS = {
    (0, "Reliability"): SCENARIO[4, "Reliability"].replace(of("reliability_rows"), of("manifest_reliability")),
    (0, "Replies that broke the contract"): SCENARIO[5, "Replies that broke the contract"].replace(of("reliability_rows"), of("manifest_reliability")),
    (0, "Completion"): f"select backend as o, {row('backend', 'n_rows', '21', 'n_pairs', "coalesce(calls_failed || ' of ' || (calls_failed + calls_ok), '-')")} as line from {of('completion_with_health')}",
    (0, "Hosts"): SCENARIO[13, "Hosts"],
    (0, "Retired reasons"): f"select prompt_version as o, '- ' || prompt_version || ': ' || votes || ' votes of ' || backends as line from {of('retired_votes')}",
}


def _order(pairs: DataFrame) -> DataFrame:
    first = pairs.agg(F.min("pos").alias("first"))  # positions of this file have no gaps
    return pairs.join(F.broadcast(first)).select(F.col("id").alias("pair_id"), (F.col("pos") - F.col("first")).alias("rank"))


@query()
def scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the report without ground truth, in its order."""
    order = _order(view(spark, sf_dir, "pairs"))
    text = report.scenario(view(spark, sf_dir, "votes"), view(spark, sf_dir, "roster"), view(spark, sf_dir, "calls"), order, "s1")
    return spark.createDataFrame(lines(text), LINES)


@query()
def scenario_from_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those sections of the report that manifests and retired reasons change; the run had seven pairs."""
    votes = view(spark, sf_dir, "votes").withColumns({"reason": F.expr(RETIRED), "prompt_version": F.concat(F.lit("v"), F.col("run_index").cast("string"))})
    held = manifests(spark, sf_dir).withColumn("n_pairs", F.lit(7).cast("long"))
    text = report.scenario(votes, view(spark, sf_dir, "roster"), None, _order(view(spark, sf_dir, "pairs")), "s1", manifests=held)
    wanted = {title for _, title in FROM_MANIFESTS}
    return spark.createDataFrame([(0, *x[1:]) for x in lines(text) if x[1] in wanted], LINES)


@query()
def leaderboard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the leaderboard, in its order, and the pages of unstable pairs that follow each first one; of its first table without tiers, intervals and spread (see separability_tiers, kappa_spread)."""
    votes, pairs = view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")
    text = report.leaderboard(votes, pairs, view(spark, sf_dir, "roster"))
    out, starts, before = [], [], {}
    for nth, section, place, line in lines(text):
        if nth == 1:
            cells = line.strip("| ").split(" | ")
            line = "| " + " | ".join(cells[i] for i in (1, 2, 5, 7, 8, 9)) + " |"
        elif section == UNSTABLE:  # the first page of a backend comes after all pages of those before it
            backend, n = re.match(r"- (.*?): (\d+) \(", line).groups()
            place, before[backend] = 1 + sum(before.values()), -(-int(n) // report.PAGE)
            starts.append((nth, backend, place))
        out.append((nth, section, place, line))
    if not starts:
        return spark.createDataFrame(out, LINES)
    first = F.broadcast(spark.createDataFrame(starts, "nth int, backend string, first int"))  # a row for each backend
    pages = report.unstable_pages(score.judged(votes, pairs)).where("page > 0").join(first, "backend")
    line = F.concat(F.lit("- "), "backend", F.lit(", from "), (F.col("page") * report.PAGE + 1).cast("string"), F.lit(": "), "ids")
    more = pages.select("nth", F.lit(UNSTABLE).alias("section"), (F.col("first") + F.col("page")).cast("int").alias("place"), line.alias("line"))
    return spark.createDataFrame(out, LINES).union(more)


ORACLES["scenario_report"] = sections(SCENARIO)
ORACLES["leaderboard_report"] = sections(LEADERBOARD)
ORACLES["scenario_from_manifests"] = sections(FROM_MANIFESTS)
