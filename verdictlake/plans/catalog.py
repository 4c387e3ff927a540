"""Queries of the library over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import agreement, bootstrap, caveats, guards, journal, manifest, reliability, score
from ..operators.tally import majority_first_seen, stability, tally, tally_any
from ..sources import readers
from ..sources.fixtures import table, tasks, view, with_views
from ..sources.shared import shared_dir
from ..streaming import twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


TALLY = """
 counted as (select backend, pair_id, count(*) as n, count(*) filter (verdict = 'approve') as a, count(*) filter (verdict = 'reject') as r from votes group by all),
 rc as (select backend, pair_id, reason, count(*) as c from votes group by all),
 rt as (select backend, pair_id, max(c) as mx from rc group by all),
 rw as (select rc.backend, rc.pair_id, count(*) as n_top, min(reason) as one from rc join rt on rc.backend = rt.backend and rc.pair_id = rt.pair_id and rc.c = rt.mx group by all),
 tally as (select c.backend, c.pair_id, c.n as n_votes, case when a > r then 'approve' when r > a then 'reject' end as verdict, case when n_top = 1 then one end as reason,
   1 - greatest(a, r) / c.n as vf, 1 - mx / c.n as rf, a, r from counted c join rt using (backend, pair_id) join rw using (backend, pair_id))
"""


def tallied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(view(spark, sf_dir, "votes"))


def with_tally(sql: str) -> str:
    return f"with {TALLY.strip()} {sql.strip()}" if not sql.strip().startswith("with ") else f"with {TALLY.strip()}, {sql.strip()[5:]}"


@query(with_tally("select backend, pair_id, n_votes, verdict, reason, round(vf, 6) as verdict_flip_rate, round(rf, 6) as reason_flip_rate from tally"))
def tally_votes(spark, sf_dir):
    return rounded(tallied(spark, sf_dir), "verdict_flip_rate", "reason_flip_rate").select("backend", "pair_id", "n_votes", "verdict", "reason", "verdict_flip_rate", "reason_flip_rate")


@query("""with c as (select backend, pair_id, verdict, count(*) as c, sum(count(*)) over (partition by backend, pair_id) as n, max(count(*)) over (partition by backend, pair_id) as mx from line_votes group by backend, pair_id, verdict)
 select backend, pair_id, cast(max(n) as bigint) as n, case when sum(case when c = mx then 1 else 0 end) = 1 then max(case when c = mx then verdict end) end as ruling, round(1 - max(mx) / max(n), 6) as flip_rate, cast(sum(case when c = mx then 1 else 0 end) as bigint) as n_top from c group by backend, pair_id""")
def tally_uneven(spark, sf_dir):
    return rounded(tally_any(view(spark, sf_dir, "line_votes"), "verdict"), "flip_rate")


@query("""with c as (select backend, pair_id, reason, count(*) as c, min(run_index) as first from votes group by all),
 k as (select *, row_number() over (partition by backend, pair_id order by c desc, first) as k from c)
 select backend, pair_id, reason as ruling, c as votes from k where k = 1""")
def majority_by_first_vote(spark, sf_dir):
    return majority_first_seen(view(spark, sf_dir, "votes"), "reason", ["run_index"])


STABILITY = with_tally("""select roster.backend, count(pair_id) as pairs, coalesce(max(n_votes), 0) as max_votes, round(avg(vf), 6) as verdict_flip, round(avg(rf), 6) as reason_flip,
 count(*) filter (vf > 0 or rf > 0) as unstable_pairs from roster left join tally on tally.backend = roster.backend join (select count(*) from votes) on true group by roster.backend""")


@query(STABILITY)
def stability_by_backend(spark, sf_dir):
    return rounded(stability(tallied(spark, sf_dir), view(spark, sf_dir, "roster")), "verdict_flip", "reason_flip")


JUDGED = TALLY.strip() + ", judged as (select tally.*, pos, ground_truth, p.reason as true_reason from tally join pairs p on p.id = tally.pair_id)"


@query(f"""with {JUDGED},
 by_backend as (select backend, count(*) as judged, count(verdict) as n, count(*) filter (verdict is null) as unsettled_verdict, count(*) filter (reason is null) as unsettled_reason,
  avg(case when verdict is not null then case when verdict = ground_truth then 1 else 0 end end) as accuracy,
  coalesce(avg(case when ground_truth = 'reject' and verdict is not null then case when verdict = 'approve' then 1 else 0 end end), 0) as far,
  avg(case when verdict is not null then vf end) as vflip, avg(case when verdict is not null then rf end) as rflip from judged group by backend)
 select roster.backend, coalesce(judged, 0) as judged, n, unsettled_verdict, unsettled_reason, round(accuracy, 6) as accuracy, round(far, 6) as false_approve_rate, round(vflip, 6) as verdict_flip_rate, round(rflip, 6) as reason_flip_rate,
  (select count(*) from pairs ) as total_pairs, round(coalesce(judged, 0) / (select count(*) from pairs ), 6) as coverage from roster left join by_backend on by_backend.backend = roster.backend join (select count(*) from votes ) on true""")
def score_models(spark, sf_dir):
    s = score.score_models(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs"), view(spark, sf_dir, "roster"))
    return rounded(s, "accuracy", "false_approve_rate", "verdict_flip_rate", "reason_flip_rate", "coverage")


def kappa_sql(source: str, keys: str, t: str, p: str) -> str:
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(",") if k.strip()) or "true"
    lead = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""n as (select {lead}count(*) as n, sum(case when {t} = {p} then 1 else 0 end) as same from {source} {group}),
 l as (select {lead}{t} as label, count(*) as x from {source} group by all), r as (select {lead}{p} as label, count(*) as y from {source} group by all),
 e as (select {", ".join(f"a.{k.strip()}" for k in keys.split(",")) + ", " if keys else ""}sum(x * y) as chance from l a join r b on a.label = b.label and {on} group by all),
 kappas as (select {", ".join(f"a.{k.strip()}" for k in keys.split(",")) + ", " if keys else ""}cast(n as bigint) as n, case when coalesce(chance, 0) = n * n then case when same = n then 1.0 else 0.0 end
   else (same / n - coalesce(chance, 0) / (n * n)) / (1 - coalesce(chance, 0) / (n * n)) end as kappa from n a left join e b on {on})"""


@query(f"""with {JUDGED}, settled as (select * from judged where verdict is not null and (select count(*) from votes ) > 0 and (select count(*) from pairs ) > 0), {kappa_sql("settled", "backend", "ground_truth", "verdict")}
 select backend, n, round(kappa, 6) as kappa from kappas""")
def kappa_majority(spark, sf_dir):
    rows = score.judged(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")).where("verdict is not null")
    return rounded(score.cohens_kappa(rows, "ground_truth", "verdict", ("backend",)), "kappa")


PER_RUN = f"known as (select votes.*, ground_truth from votes join pairs p on p.id = pair_id), {kappa_sql('known', 'backend, run_index', 'ground_truth', 'verdict')}"


@query(f"with {PER_RUN} select backend, run_index, n, round(kappa, 6) as kappa from kappas where (select count(*) from pairs ) > 0")
def kappa_per_run(spark, sf_dir):
    return rounded(score.per_run_kappas(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")), "kappa")


@query(f"with {PER_RUN} select backend, count(*) as n_runs, round(avg(kappa), 6) as mean, round(coalesce(stddev_samp(kappa), 0), 6) as sd from kappas where (select count(*) from pairs ) > 0 group by backend")
def kappa_spread(spark, sf_dir):
    return rounded(score.mean_sd(score.per_run_kappas(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")), "kappa"), "mean", "sd")


@query(f"with x as (select quality, 1 - toxic as clean from labels), {kappa_sql('x', '', 'quality', 'clean')} select n, round(kappa, 6) as kappa from kappas")
def kappa_labels(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    return rounded(score.cohens_kappa(x, "quality", "clean"), "kappa")


@query(f"with {JUDGED} select backend, true_reason, reason, count(*) as pairs from judged where reason is not null and (select count(*) from votes ) > 0 and (select count(*) from pairs ) > 0 group by backend, true_reason, reason")
def reason_confusion(spark, sf_dir):
    return score.reason_confusion(score.judged(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")))


@query(f"""with {JUDGED} select backend, pair_id, row_number() over (partition by backend order by pos) as place, count(*) over (partition by backend) as n from judged where verdict is not null and (vf > 0 or rf > 0)
 and (select count(*) from votes ) > 0 and (select count(*) from pairs ) > 0""")
def unstable_pairs(spark, sf_dir):
    return score.unstable_pairs(score.judged(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")), tasks(spark, sf_dir))


def items(spark, sf_dir):
    rows = score.judged(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs")).where("verdict is not null")
    return rows.select("backend", "pos", F.col("ground_truth").alias("truth"), F.col("verdict").alias("predicted"))


LO, HI = bootstrap.ends(bootstrap.RESAMPLES)
BOOT = f"""{JUDGED}, it as (select backend, case when ground_truth = 'approve' then 1 else 0 end as t, case when verdict = 'approve' then 1 else 0 end as p
   from judged where verdict is not null and (select count(*) from votes ) > 0 and (select count(*) from pairs ) > 0),
 cl as (select backend, t, p, count(*) as c from it group by all),
 cn as (select *, row_number() over w as k, cast(sum(c) over (partition by backend) as bigint) as n, sum(c) over (w rows between current row and unbounded following) as rem from cl window w as (partition by backend order by t desc, p desc)),
 pw as (select backend, k, n, c = rem as rest, c / rem as q, j, 1::bigint << j as m from cn, range(62) a(j) where 1::bigint << j <= n),
 tb as (select *, cast(case when rest then m else greatest(0, floor(m * q) - half) end as bigint) as low, cast(least(m, floor(m * q) + half) as bigint) as high from (select *, ceil({bootstrap.REACH} * sqrt(m * q * (1 - q))) + {bootstrap.LEAST_HALF} as half from pw)),
 ex as (select *, unnest(range(low, high + 1)) as x from tb where not rest),
 lw as (select *, sum(case when x = low then 0 else ln((m - x + 1) / x * (q / (1 - q))) end) over (partition by backend, k, j order by x rows unbounded preceding) as w from ex),
 ew as (select *, exp(w - max(w) over (partition by backend, k, j)) as e from lw),
 ed as (select backend, k, j, x, high, sum(e) over (partition by backend, k, j order by x rows unbounded preceding) / sum(e) over (partition by backend, k, j) as edge from ew),
 un as (select backend, k, j, edge, null::bigint as r, null::bigint as low from ed where x < high union all
   select backend, k, j, ('0x' || substr(md5('{bootstrap.SEED}|' || r || '|' || k || '|' || j), 1, 13))::bigint / {1 << 52} as edge, r, low from tb, range({bootstrap.RESAMPLES}) b(r)),
 dr as (select backend, k, j, r, low + below as x from (select *, count(*) filter (r is null) over (partition by backend, k, j order by edge, r nulls first rows unbounded preceding) as below from un) where r is not null),
 s1 as (select backend, r, n, cast(sum(x * ((n >> j) & 1)) as bigint) as x1 from dr join (select distinct backend, n from cn) using (backend) where k = 1 group by all),
 s2 as (select s1.*, cast(coalesce(sum(x * (((n - x1) >> j) & 1)), 0) as bigint) as x2 from s1 left join dr on dr.backend = s1.backend and dr.r = s1.r and k = 2 group by all),
 s3 as (select s2.*, cast(coalesce(sum(x * (((n - x1 - x2) >> j) & 1)), 0) as bigint) as x3 from s2 left join dr on dr.backend = s2.backend and dr.r = s2.r and k = 3 group by all),
 sm as (select backend, s3.n, r, sum(v) filter (t = 1) as t, sum(v) filter (p = 1) as p, sum(v) filter (t = p) as same from (select backend, n, r, unnest([1, 2, 3, 4]) as k, unnest([x1, x2, x3, n - x1 - x2 - x3]) as v from s3) s3 join cn using (backend, k) group by all),
 sn as (select backend, n, r, coalesce(t, 0) as t, coalesce(p, 0) as p, coalesce(same, 0) as same from sm),
 ks as (select backend, same / n as accuracy, case when t * p + (n - t) * (n - p) = n * n then case when same = n then 1.0 else 0.0 end else (same / n - (t * p + (n - t) * (n - p)) / (n * n)) / (1 - (t * p + (n - t) * (n - p)) / (n * n)) end as kappa from sn),
 ci as (select backend, list_sort(list(kappa))[{LO + 1}] as lo, list_sort(list(kappa))[{HI + 1}] as hi, list_sort(list(accuracy))[{LO + 1}] as lo_accuracy, list_sort(list(accuracy))[{HI + 1}] as hi_accuracy from ks group by backend)"""


@query(f"with {BOOT} select backend, round(lo, 6) as lo, round(hi, 6) as hi from ci")
def bootstrap_kappa_ci(spark, sf_dir):
    return rounded(bootstrap.bootstrap_kappa(items(spark, sf_dir)), "lo", "hi")


@query(f"with {BOOT} select backend, round(lo_accuracy, 6) as lo, round(hi_accuracy, 6) as hi from ci")
def bootstrap_accuracy_ci(spark, sf_dir):
    """Another statistic of the same resamples."""
    return rounded(bootstrap.bootstrap_ci(items(spark, sf_dir), ["truth", "predicted"], bootstrap.accuracy_statistic), "lo", "hi")


def scores(spark, sf_dir):
    rows = items(spark, sf_dir)
    kappas = score.cohens_kappa(rows, "truth", "predicted", ("backend",)).drop("n")
    return kappas.join(bootstrap.bootstrap_kappa(rows), "backend")


KAPPA_IT = f"{BOOT}, {kappa_sql('it', 'backend', 't', 'p')}, sc as (select k.backend, kappa, lo, hi from kappas k join ci on ci.backend = k.backend)"


@query(f"""with recursive {KAPPA_IT}, ov as (select a.backend as x, b.backend as y from sc a join sc b on a.lo <= b.hi and b.lo <= a.hi),
 reach as (select x, y from ov union select r.x, o.y from reach r join ov o on o.x = r.y), comp as (select x as backend, min(y) as root from reach group by x),
 best as (select root, max(kappa) as best from comp join sc using (backend) group by root)
 select backend, round(kappa, 6) as kappa, round(lo, 6) as lo, round(hi, 6) as hi, dense_rank() over (order by best desc, root) as tier from sc join comp using (backend) join best using (root)""")
def separability_tiers(spark, sf_dir):
    return rounded(bootstrap.tiers(scores(spark, sf_dir)), "kappa", "lo", "hi")


@query(f"with {KAPPA_IT} select a.backend, b.backend as other from sc a join sc b on a.backend < b.backend and a.lo <= b.hi and b.lo <= a.hi")
def tiers_theta(spark, sf_dir):
    return bootstrap.tiers_theta(scores(spark, sf_dir))


@query()
def bootstrap_exact_ci(spark, sf_dir):
    """The seeded draw sequence, which SQL cannot repeat; tests hold it against a plain loop."""
    return bootstrap.bootstrap_exact(items(spark, sf_dir))


USED = "(select count(*) from votes ) > 0"


@query(with_tally(f"""with s as (select backend, pair_id, verdict from tally where verdict is not null and {USED}),
 f as (select a.backend, b.backend as other, count(*) as shared, avg(case when a.verdict = b.verdict then 1 else 0 end) as agreement from s a join s b using (pair_id) group by all)
 select x.backend, y.backend as other, coalesce(shared, 0) as shared, round(agreement, 6) as agreement from roster x cross join roster y left join f on f.backend = x.backend and f.other = y.backend"""))
def agreement_matrix(spark, sf_dir):
    return rounded(agreement.agreement_matrix(tallied(spark, sf_dir), view(spark, sf_dir, "roster")), "agreement")


@query(with_tally(f"""select a.backend as "left", b.backend as "right", a.reason as left_reason, b.reason as right_reason, count(*) as pairs from tally a join tally b on a.pair_id = b.pair_id and a.backend < b.backend and a.reason is not null and b.reason is not null and {USED} group by all"""))
def reason_cross_tab(spark, sf_dir):
    return agreement.reason_cross_tab(tallied(spark, sf_dir))


@query(with_tally(f"select backend, reason, count(*) as pairs from tally where reason is not null and {USED} group by all"))
def reason_distribution(spark, sf_dir):
    return agreement.reason_distribution(tallied(spark, sf_dir))


CONTENTION = with_tally(f"""with m as (select pair_id, count(*) as n_models, count(*) filter (verdict is null or reason is null) as n_unsettled, avg(vf) as mvf, avg(rf) as mrf, count(verdict) as nv, count(reason) as nr from tally where {USED} group by pair_id),
 v as (select pair_id, max(c) as top from (select pair_id, verdict, count(*) as c from tally where verdict is not null group by all) group by pair_id),
 w as (select pair_id, max(c) as top from (select pair_id, reason, count(*) as c from tally where reason is not null group by all) group by pair_id),
 x as (select pair_id, n_models, n_unsettled, coalesce(1 - v.top / nullif(nv, 0), 0) as x_verdict, coalesce(1 - w.top / nullif(nr, 0), 0) as x_reason, mvf, mrf from m left join v using (pair_id) left join w using (pair_id))
 select pair_id, n_models, n_unsettled, round(x_verdict, 6) as x_verdict, round(x_reason, 6) as x_reason, round(mvf, 6) as mean_verdict_flip, round(mrf, 6) as mean_reason_flip,
  round(2 * x_verdict + x_reason + mvf + 0.5 * mrf + 2 * n_unsettled / n_models, 6) as contention from x""")
CONTENTION_COLS = ("x_verdict", "x_reason", "mean_verdict_flip", "mean_reason_flip", "contention")


@query(CONTENTION)
def contention_ranking(spark, sf_dir):
    return rounded(agreement.contention(tallied(spark, sf_dir)), *CONTENTION_COLS)


@query()
def contention_top40(spark, sf_dir):
    return rounded(agreement.contention_top(tallied(spark, sf_dir)), *CONTENTION_COLS)


ORACLES["contention_top40"] = f"select * from ({with_views(CONTENTION)}) where contention > 0 order by contention desc, pair_id limit 40"

POOLED = """c as (select pair_id, count(*) as n_votes, count(*) filter (verdict = 'approve') as a, count(*) filter (verdict = 'reject') as r, string_agg(distinct model_id, ',' order by model_id) as models from votes group by pair_id),
 q as (select pair_id, reason, count(*) as k from votes group by all), qt as (select pair_id, max(k) as mx from q group by all),
 qw as (select q.pair_id, count(*) as n_top, min(reason) as one, max(mx) as mx from q join qt on q.pair_id = qt.pair_id and q.k = qt.mx group by all),
 pooled as (select c.pair_id, n_votes, a, r, models, case when a > r then 'approve' when r > a then 'reject' end as verdict, case when n_top = 1 then one end as reason, 1 - greatest(a, r) / n_votes as vf, 1 - mx / n_votes as rf from c join qw using (pair_id))"""


@query(f"with {POOLED} select pair_id, n_votes, a as n_verdict_approve, r as n_verdict_reject, models, verdict, reason, round(vf, 6) as verdict_flip_rate, round(rf, 6) as reason_flip_rate from pooled")
def flip_stats_pooled(spark, sf_dir):
    rows = agreement.pooled_flips(view(spark, sf_dir, "votes"))
    return rounded(rows, "verdict_flip_rate", "reason_flip_rate").select("pair_id", "n_votes", "n_verdict_approve", "n_verdict_reject", "models", "verdict", "reason", "verdict_flip_rate", "reason_flip_rate")


@query(f"""with {POOLED}, j as (select p.id as pair_id, pos, case when n_votes is null then 1 else 0 end as unjudged, case when n_votes is not null and (verdict is null or pooled.reason is null) then 1 else 0 end as undecided, coalesce(round(vf, 9), 0) as flip from pairs p left join pooled on pooled.pair_id = p.id)
 select pair_id, row_number() over (order by unjudged, undecided desc, flip desc, pos) as place, undecided, flip from j where {USED}""")
def operator_queue(spark, sf_dir):
    return agreement.operator_queue(view(spark, sf_dir, "pairs"), agreement.pooled_flips(view(spark, sf_dir, "votes")))


@query(with_tally(f"""with rs as (select backend, pair_id, string_agg(reason || '=' || c, ',' order by reason) as split from rc group by all)
 select 's1' as leg, backend, pair_id, 0 as axis_order, 'verdict' as kind, n_votes, 'approve=' || a || ',reject=' || r as split from tally where verdict is null and n_votes >= 2 and {USED}
 union all select 's1', backend, pair_id, 1, 'reason', n_votes, split from tally join rs using (backend, pair_id) where reason is null and n_votes >= 2"""))
def backend_deadlocks(spark, sf_dir):
    return agreement.deadlocks(tallied(spark, sf_dir), "s1")


@query(with_tally(f"select backend, pair_id, n_votes, row_number() over (partition by backend order by pair_id nulls first) as place, count(*) over (partition by backend) as n from tally where reason is null and {USED}"))
def unsettled_reason_pairs(spark, sf_dir):
    return agreement.unsettled_reason_pairs(tallied(spark, sf_dir))


@query(with_tally("""with b as (select backend, max(n_votes) as max_votes, count(*) filter (n_votes >= 2) as repeated_pairs, coalesce(avg(case when n_votes >= 2 then vf end), 0) as vflip, coalesce(avg(case when n_votes >= 2 then rf end), 0) as rflip from tally group by backend),
 k as (select backend, count(cached_tokens) as measuring, count(*) filter (cached_tokens > 0) as hits, count(*) as total_calls from votes group by backend)
 select backend, max_votes, repeated_pairs, round(vflip, 6) as verdict_flip, round(rflip, 6) as reason_flip, measuring, hits, total_calls,
  case when repeated_pairs = 0 or vflip > 0 or rflip > 0 then 'ok' when measuring = 0 then 'unverifiable' when hits > 0 then 'collapse_suspected' else 'ok' end as status from b join k using (backend)"""))
def cache_findings(spark, sf_dir):
    return rounded(agreement.cache_findings(view(spark, sf_dir, "votes"), tallied(spark, sf_dir)), "verdict_flip", "reason_flip")


SHAPE = """case when d >= u then 'complete' when s < u and s <= d * 1.1 then 'prefix' when s < u then 'spread, stopped early' else 'scattered gaps' end"""


@query(f"""with o as (select id, row_number() over (order by pos) - 1 as rk from pairs ), b as (select backend, count(distinct pair_id) as d, max(rk) + 1 as s from votes join o on o.id = pair_id group by backend), u as (select count(*) as u from o)
 select backend, d as distinct_pairs, s as span, u as total_pairs, d < u and s < u and s <= d * 1.1 as is_prefix, {SHAPE} as shape, 'pairs-file' as order_source from b, u""")
def coverage_shapes(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs")
    first = pairs.agg(F.min("pos").alias("first"))  # positions of this file have no gaps
    order = pairs.join(F.broadcast(first)).select(F.col("id").alias("pair_id"), (F.col("pos") - F.col("first")).alias("rank"))
    return reliability.coverage_shapes(view(spark, sf_dir, "votes"), order)


@query("""with f as (select backend, pair_id, min(run_index * 1000000 + cast(substr(pair_id, 2) as bigint)) as first from votes group by all), z as (select backend, count(*) as n from f group by backend),
 ref as (select backend from z order by n desc, backend limit 1), m as (select pair_id, 0 as part, '' as b, first from f join ref using (backend)),
 r as (select pair_id, 1 as part, min(backend) as b, 0 as first from f where pair_id not in (select pair_id from m) group by pair_id)
 select pair_id, row_number() over (order by part, b, first, pair_id) - 1 as "rank" from (select * from m union all select * from r)""")
def reconstructed_order(spark, sf_dir):
    votes = view(spark, sf_dir, "votes").withColumn("pos", F.col("run_index") * 1000000 + F.substring("pair_id", 2, 20).cast("long"))
    return reliability.reconstructed_order(votes)


HEALTH_SQL = """select {keys}, count(*) filter (ok = 1) as calls_ok, count(*) filter (ok = 0) as calls_failed, round(min(latency_s) filter (ok = 1), 6) as latency_min, round(quantile_cont(latency_s, 0.5) filter (ok = 1), 6) as latency_median,
 round(quantile_disc(latency_s, 0.95) filter (ok = 1), 6) as latency_p95, round(max(latency_s) filter (ok = 1), 6) as latency_max, round(quantile_cont(latency_s, 0.5) filter (ok = 0), 6) as failed_latency_median, round(max(latency_s) filter (ok = 0), 6) as failed_latency_max from calls group by {keys}"""
KIND_SQL = "select {keys}, error_kind, count(*) as calls from calls where ok = 0 group by {keys}, error_kind"
LATENCIES = ("latency_min", "latency_median", "latency_p95", "latency_max", "failed_latency_median", "failed_latency_max")


@query(f"""with h as ({HEALTH_SQL.format(keys="backend")}), k as (select backend, string_agg(error_kind || '=' || calls, ',' order by error_kind) as error_kinds from ({KIND_SQL.format(keys="backend").replace("as calls from calls", "as calls from calls ")}) group by backend)
 select h.*, coalesce(error_kinds, '') as error_kinds from h left join k on k.backend = h.backend""")
def health_summary(spark, sf_dir):
    return rounded(reliability.health_summary(view(spark, sf_dir, "calls"), "backend"), *LATENCIES)


@query(KIND_SQL.format(keys="backend"))
def error_kinds(spark, sf_dir):
    return reliability.error_kinds(view(spark, sf_dir, "calls"), "backend")


@query("select backend, count(cached_tokens) as calls_measured, count(*) - count(cached_tokens) as calls_unmeasured, cast(sum(cached_tokens) as bigint) as cached_tokens, count(*) filter (cached_tokens > 0) as calls_with_cache_hit from votes group by backend")
def usage_summary(spark, sf_dir):
    return reliability.usage_summary(view(spark, sf_dir, "votes"), "backend", ("cached_tokens",), F.col("cached_tokens").isNotNull())


@query("""with t as (select backend, count(distinct launch) as launches, count(*) filter (ok = 1) as calls_ok, count(*) filter (ok = 0) as calls_failed, max(launch) as last from calls group by backend),
 k as (select backend, string_agg(error_kind || '=' || n, ',' order by error_kind) as error_kinds from (select backend, error_kind, count(*) as n from calls where ok = 0 group by all) group by backend),
 m as (select c.backend, quantile_cont(latency_s, 0.5) as med, quantile_disc(latency_s, 0.95) as p95 from calls c join t on t.backend = c.backend and c.launch = t.last where ok = 1 group by c.backend)
 select t.backend, launches, calls_ok, calls_failed, coalesce(error_kinds, '') as error_kinds, round(med, 6) as latency_median, round(p95, 6) as latency_p95 from t left join k on k.backend = t.backend left join m on m.backend = t.backend""")
def launch_accumulation(spark, sf_dir):
    return rounded(reliability.launch_accumulation(view(spark, sf_dir, "calls")), "latency_median", "latency_p95")


@query("""with v as (select backend, count(*) as rows_on_disk, count(distinct pair_id) as distinct_pairs from votes group by backend),
 c as (select backend, count(*) filter (ok = 1) as ok, count(*) filter (ok = 0) as bad, count(*) filter (error_kind like '%Timeout') as t, count(*) filter (error_kind = 'JudgeResponseError') as j, count(*) filter (error_kind = 'QuotaExhausted') as q from calls group by backend)
 select coalesce(v.backend, c.backend) as backend, coalesce(rows_on_disk, 0) as rows_on_disk, coalesce(distinct_pairs, 0) as distinct_pairs, ok + bad as attempted, ok as succeeded, bad as failed, case when c.backend is null then 'none' else 'cumulative' end as scope,
  coalesce(t, 0) as timeouts, coalesce(j, 0) as contract_failures, coalesce(q, 0) as quota_failures, round(bad / nullif(ok + bad, 0), 6) as failure_rate, round((ok + bad) / nullif(ok, 0), 6) as attempts_per_vote,
  case when c.backend is null then null when q > 0 and q = bad then null when ok = 0 then true else (ok + bad) / nullif(ok, 0) >= 2 end as unusable_at_scale from v full join c on c.backend = v.backend""")
def reliability_rows(spark, sf_dir):
    r = reliability.reliability(view(spark, sf_dir, "votes"), view(spark, sf_dir, "calls"))
    r = rounded(r, "failure_rate", "attempts_per_vote")
    return r.select("backend", "rows_on_disk", "distinct_pairs", "attempted", "succeeded", "failed", "scope", "timeouts", "contract_failures", "quota_failures", "failure_rate", "attempts_per_vote", "unusable_at_scale")


@query("with u as (select distinct backend, base_url from votes ) select regexp_extract(base_url, '://([^/?#]*)', 1) as host, count(*) as backends, string_agg(backend, ',' order by backend) as names from u group by 1")
def host_concentration(spark, sf_dir):
    return reliability.host_concentration(view(spark, sf_dir, "votes"))


@query("select case when contains(url, '://') then regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) else split_part(url, '/', 1) end as host, count(*) as n_pages from pages group by 1")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(reliability.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))


@query("select roster.backend, count(pair_id) as n_rows, count(distinct pair_id) as n_pairs, 3 * (select count(*) from pairs ) as expected_rows from roster left join votes on votes.backend = roster.backend group by roster.backend")
def completion(spark, sf_dir):
    return reliability.completion(view(spark, sf_dir, "votes"), view(spark, sf_dir, "roster"), 3, view(spark, sf_dir, "pairs"))


@query("""with one as (select case when backend in ('m0', 'm1', 'm2') then 'alpha' else backend end as file, base_url, model_id, prompt_version from votes )
 select file, string_agg(distinct base_url, ',' order by base_url) as base_url, cast(0 as bigint) as unknown_rows, cast(0 as bigint) as malformed_rows, count(*) as total_rows, count(distinct base_url) > 1 as is_mixed from one group by file""")
def provenance_audit(spark, sf_dir):
    files = view(spark, sf_dir, "votes").withColumn("file", F.when(F.col("backend").isin("m0", "m1", "m2"), "alpha").otherwise(F.col("backend")))
    return guards.provenance_audit(files, "file")


@query("""with one as (select case when backend in ('m0', 'm1', 'm2') then 'alpha' else backend end as file, base_url, model_id, prompt_version from votes )
 select file, string_agg(distinct model_id, ',' order by model_id) as model_id, string_agg(distinct prompt_version, ',' order by prompt_version) as prompt_version, 'None' as temperature, string_agg(distinct base_url, ',' order by base_url) as base_url,
  concat_ws(',', case when count(distinct model_id) > 1 then 'model_id' end, case when count(distinct base_url) > 1 then 'base_url' end) as mixed_fields from one group by file""")
def config_guard(spark, sf_dir):
    files = view(spark, sf_dir, "votes").withColumn("file", F.when(F.col("backend").isin("m0", "m1", "m2"), "alpha").otherwise(F.col("backend")))
    return guards.config_guard(files, "file")


@query("select p.id as pair_id, pos, cast(r as integer) as run_index from pairs p, range(3) a(r) where not exists (select 1 from votes where backend = 'm3' and votes.pair_id = p.id and votes.run_index = r)")
def pending_votes(spark, sf_dir):
    done = guards.resume_keys(view(spark, sf_dir, "votes").where("backend = 'm3'").withColumn("reasoning_effort", F.lit(None).cast("string")).withColumns({"config_digest": F.lit(None).cast("string"), "code_version": F.lit(None).cast("string")}), {"model_id": "model-m3", "prompt_version": "v3", "temperature": None})
    return guards.pending_votes(view(spark, sf_dir, "pairs"), done, 3)


@query("select id as pair_id, 'e10-' || substr(sha256(original || chr(0) || enriched), 1, 12) as row_id from pairs ")
def row_id_hash(spark, sf_dir):
    return view(spark, sf_dir, "pairs").select(F.col("id").alias("pair_id"), text.row_id(F.col("original"), F.col("enriched")).alias("row_id"))


@query("select coalesce(nullif(concat_ws('+', case when brand <> '' then 'brand' end, case when mpn <> '' then 'mpn' end), ''), 'none') as variant, count(*) as pairs from pairs group by 1")
def prompt_variant_counts(spark, sf_dir):
    return view(spark, sf_dir, "pairs").groupBy(text.prompt_variant(F.col("brand"), F.col("mpn")).alias("variant")).agg(F.count("*").alias("pairs"))


@query("""select id as pair_id, case when brand <> '' then 'BRAND: ' || brand || chr(10) else '' end || case when mpn <> '' then 'MPN: ' || mpn || chr(10) else '' end || 'ORIGINAL: ' || original || chr(10) || 'ENRICHED: ' || enriched as content, original is not distinct from enriched as unchanged from pairs """)
def build_messages(spark, sf_dir):
    p = view(spark, sf_dir, "pairs")
    said = text.messages(F.col("original"), F.col("enriched"), F.col("brand"), F.col("mpn"))
    return p.select(F.col("id").alias("pair_id"), said[1]["content"].alias("content"), guards.unchanged(F.col("original"), F.col("enriched")).alias("unchanged"))


REPLY = """case event_id % 6 when 0 then concat('Sure. {"verdict": "', case when event_id % 4 < 2 then 'approve' else 'reject' end, '", "reason": "', case when event_id % 4 < 2 then 'ok' else 'casing_error' end, '"} Done.')
 when 1 then '{"verdict": "reject", "reason": "truncation_worse"}' when 2 then 'no json here' when 3 then '{"verdict": "maybe", "reason": "ok"}' when 4 then '{"verdict": "approve"}' else concat('{"verdict": {"a": ', props, '}}') end"""


@query(f"""with r as (select event_id, {REPLY} as reply from events), j as (select event_id, regexp_extract(reply, '(?s)\\{{.*?\\}}') as body from r),
 k as (select event_id, case when body <> '' and json_valid(body) then body end as body from j),
 p as (select event_id, coalesce(json_extract_string(body, '$.verdict') in ('approve', 'reject') and json_extract_string(body, '$.reason') in ('ok', 'casing_error', 'overcorrection', 'meaning_change'), false) as good, body from k)
 select event_id, case when good then json_extract_string(body, '$.verdict') end as verdict, case when good then json_extract_string(body, '$.reason') end as reason, case when not good then 'JudgeResponseError' end as error from p""")
def parse_judge_response(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("reply", F.expr(REPLY))
    return e.select("event_id", text.parse_reply(F.col("reply")).alias("p")).select("event_id", "p.*")


PAYLOAD = """case event_id % 5 when 0 then concat('{"usage": {"prompt_tokens": ', event_id % 900, ', "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": ', event_id % 3, '}}}')
 when 1 then concat('{"usage": {"input_tokens": ', event_id % 800, ', "output_tokens": 0, "cache_read_input_tokens": 5}}') when 2 then '{"usage": {"prompt_tokens": true, "completion_tokens": 3.5}}' when 3 then '{"usage": {}}' else '{"usage": {"total_tokens": 12, "completion_tokens_details": {"reasoning_tokens": 0}}}' end"""


@query("""select event_id, case event_id % 5 when 0 then event_id % 900 when 1 then event_id % 800 end as prompt_tokens, cast(case event_id % 5 when 0 then 7 when 1 then 0 end as bigint) as completion_tokens,
 case event_id % 5 when 0 then event_id % 900 + 7 when 1 then event_id % 800 when 4 then 12 end as total_tokens, case event_id % 5 when 0 then event_id % 3 when 1 then 5 end as cached_tokens, cast(case when event_id % 5 = 4 then 0 end as bigint) as reasoning_tokens from events""")
def usage_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("payload", F.expr(PAYLOAD))
    u = e.select("event_id", text.usage(F.col("payload")).alias("u"))
    return u.select("event_id", *[F.col(f"u.{f}").cast("long").alias(f) for f in ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "reasoning_tokens")])


PACK_LINE = "case p_partkey % 7 when 0 then '| --- | :-- | --- | --- | --- |' when 1 then concat('prose about ', p_name) when 2 then concat('| casing | file | ', p_name, ' | with | pipe | x |') else concat('|  casing | part ', p_brand, '|', p_name, ' | ', upper(p_name), ' | ', case when p_partkey % 2 = 0 then '—' else 'clean , brand' end, ' |') end"


@query("select cast(p_partkey as bigint) as pos, 'casing' as cohort, 'part ' || p_brand as source, p_name as \"before\", upper(p_name) as \"after\", case when p_partkey % 2 = 0 then '' else 'clean;brand' end as stages, 'e10-' || substr(sha256(p_name || chr(0) || upper(p_name)), 1, 12) as id from part where p_partkey % 7 > 2")
def qa_pack_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pos"), F.expr(PACK_LINE).alias("value"))
    rows = readers.qa_pack(lines)
    return rows.select("pos", "cohort", "source", "before", "after", F.array_join("stages", ";").alias("stages"), text.row_id(F.col("before"), F.col("after")).alias("id"))


@query("select p.id, p.ground_truth, p.reason, original from pairs p")
def merge_rulings(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs")
    blank = pairs.select("id", "original", F.lit(None).cast("string").alias("ground_truth"), F.lit(None).cast("string").alias("reason"))
    return journal.merge_rulings(blank, pairs.select("id", "ground_truth", "reason")).select("id", "ground_truth", "reason", "original")


@query("select distinct cast(l_partkey as bigint) as l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 4 > 0)")
def unknown_rulings(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(F.col("p_partkey").cast("long").alias("id"))
    return journal.unknown_rulings(known, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("id"))).select(F.col("id").alias("l_partkey")).distinct()


def records(spark, sf_dir):
    """conversations as journals: a user rules, an assistant notes, a system line undoes; every fifth turn undoes too."""
    c = table(spark, sf_dir, "conversations")
    undo = (F.col("role") == "system") | (F.col("turn") % 5 == 4)
    action = F.when(undo, "undo").when(F.col("role") == "user", "rule").otherwise("note")
    key = F.concat(F.lit("p"), (F.length("text") % 3).cast("string"))
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), action.alias("action"), key.alias("pair_id"), F.when(F.length("text") % 2 == 0, "approve").otherwise("reject").alias("ground_truth"), F.when(F.length("text") % 2 == 0, "ok").otherwise("casing_error").alias("reason"), F.col("text").alias("notes"), (F.length("text") * 10).cast("long").alias("elapsed_ms"))


#: The fold event by event: what stands is a list of pairs, each with its rulings.
REPLAY = """with recursive ev as (select conv_id as session, case when role = 'system' or turn % 5 = 4 then 'undo' else 'rule' end as action, 'p' || (length(text) % 3) as pair_id,
   {'t': case when length(text) % 2 = 0 then 'approve' else 'reject' end, 'r': case when length(text) % 2 = 0 then 'ok' else 'casing_error' end} as ruling, row_number() over (partition by conv_id order by turn) as i
   from conversations where role in ('system', 'user') or turn % 5 = 4),
 st as (select distinct session, 0 :: bigint as i, [] :: struct(p varchar, past struct(t varchar, r varchar)[])[] as s from ev
   union all select st.session, ev.i, case when action = 'rule' then list_append(list_filter(s, lambda x: x.p <> pair_id), {'p': pair_id, 'past': list_append(coalesce(list_filter(s, lambda x: x.p = pair_id)[1].past, []), ruling)})
     when len(s) = 0 then s when len(s[-1].past) > 1 then list_append(s[1 : -2], {'p': s[-1].p, 'past': s[-1].past[1 : -2]}) else s[1 : -2] end as s
   from st join ev on ev.session = st.session and ev.i = st.i + 1),
 ends as (select session, max_by(s, i) as s from st group by session),
 stands as (select session, unnest(s) as x, unnest(range(len(s))) as place from ends)
 select session, cast(place as integer) as place, x.p as pair_id, x.past[-1].t as ground_truth, x.past[-1].r as reason from stands"""


@query(REPLAY)
def journal_replay(spark, sf_dir):
    return journal.replay(records(spark, sf_dir))


@query(REPLAY)
def stream_replay(spark, sf_dir):
    """The journals read in two batches, with keyed state between them."""
    folder, rows = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}", records(spark, sf_dir).select("session", "seq", "action", "pair_id", "ground_truth", "reason")
    for part in ("seq < 3", "seq >= 3"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stands = twins.standing(twins.run_to_end(spark, twins.stream_replay(stream), "append"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("place")) - 1
    return stands.select(F.col("session").cast("long").alias("session"), place.alias("place"), "pair_id", "ground_truth", "reason")


RECORDS = """rec as (select conv_id as session, turn as seq, case when role = 'system' or turn % 5 = 4 then 'undo' when role = 'user' then 'rule' else 'note' end as action, 'p' || (length(text) % 3) as pair_id, length(text) * 10 as elapsed_ms, text as notes from conversations)"""


@query(f"""with {RECORDS}, s as (select session, count(*) filter (action = 'rule') as ruled, cast(0 as bigint) as skipped, count(*) filter (action = 'undo') as undone, count(*) filter (action = 'note') as noted, cast(sum(elapsed_ms) as bigint) as elapsed_ms from rec group by session)
 select *, greatest(ruled - undone, 0) as decisions, round(coalesce(greatest(ruled - undone, 0) / nullif(elapsed_ms / 60000.0, 0), 0), 6) as decisions_per_minute from s""")
def session_tallies(spark, sf_dir):
    return rounded(journal.session_tallies(records(spark, sf_dir)), "decisions_per_minute")


@query(f"with {RECORDS} select session, pair_id, max_by(notes, seq) as notes from rec where action in ('rule', 'note') and notes <> '' group by session, pair_id")
def journal_notes(spark, sf_dir):
    return journal.notes(records(spark, sf_dir))


@query("select id, pos from pairs p where pos % 3 <> 1")
def pending_rows(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs")
    return journal.pending_rows(pairs.select("id", "pos"), pairs.where("pos % 3 = 1").select(F.col("id").alias("pair_id")))


@query()
def word_diff(spark, sf_dir):
    """Alignment heuristics that SQL cannot express; tests hold it against plain calls."""
    return view(spark, sf_dir, "pairs").select(F.col("id").alias("pair_id"), text.word_diff("original", "enriched").alias("diff"))


def manifests(spark, sf_dir):
    """Manifests of the call log: m0 to m2 with their history, m3 as one written before there were histories, m4 without one."""
    calls = view(spark, sf_dir, "calls").where("backend <> 'm4'")
    last = calls.groupBy("backend").agg(F.max("launch").alias("launch"))
    health = manifest.health(calls.join(last, ["backend", "launch"], "left_semi"))
    launches = calls.groupBy("backend").agg(F.count_distinct("launch").alias("launches"))
    whole = manifest.health(calls).withColumnRenamed("health", "h").join(launches, "backend")
    cumulative = F.struct("launches", "h.calls_ok", "h.calls_failed", "h.error_kinds", F.lit(0).cast("long").alias("discarded_prior_launches"))
    out = health.join(whole.select("backend", F.when(F.col("backend") != "m3", cumulative).alias("cumulative")), "backend")
    return out.withColumn("base_url", F.concat(F.lit("https://manifest."), F.col("backend"), F.lit(".example/v1")))


#: Counts as the manifests above have them.
COUNTED = """last as (select backend, max(launch) as launch from calls group by backend), counted as (select c.backend, c.ok, c.error_kind from calls c join last l on l.backend = c.backend and (c.backend <> 'm3' or c.launch = l.launch) where c.backend <> 'm4'),
 c as (select backend, count(*) filter (ok = 1) as ok, count(*) filter (ok = 0) as bad, count(*) filter (error_kind like '%Timeout') as t, count(*) filter (error_kind = 'JudgeResponseError') as j, count(*) filter (error_kind = 'QuotaExhausted') as q from counted group by backend)"""


@query(f"""with {COUNTED}, v as (select backend, count(*) as rows_on_disk, count(distinct pair_id) as distinct_pairs from votes group by backend),
 h as (select c.backend, quantile_cont(latency_s, 0.5) as med, quantile_disc(latency_s, 0.95) as p95 from calls c join last l on l.backend = c.backend and c.launch = l.launch where ok = 1 and c.backend <> 'm4' group by c.backend),
 n as (select backend, count(distinct launch) as launches from calls where backend < 'm3' group by backend)
 select coalesce(v.backend, c.backend) as backend, coalesce(rows_on_disk, 0) as rows_on_disk, coalesce(distinct_pairs, 0) as distinct_pairs, ok + bad as attempted, ok as succeeded, bad as failed, launches, case when c.backend is null then 'none' when c.backend = 'm3' then 'last-launch' else 'cumulative' end as scope,
  coalesce(t, 0) as timeouts, coalesce(j, 0) as contract_failures, coalesce(q, 0) as quota_failures, round(bad / nullif(ok + bad, 0), 6) as failure_rate, round((ok + bad) / nullif(ok, 0), 6) as attempts_per_vote, round(med, 6) as latency_median, round(p95, 6) as latency_p95,
  case when c.backend is null then null when q > 0 and q = bad then null when ok = 0 then true else (ok + bad) / nullif(ok, 0) >= 2 end as unusable_at_scale
 from v full join c on c.backend = v.backend left join h on h.backend = c.backend left join n on n.backend = c.backend""")
def manifest_reliability(spark, sf_dir):
    r = reliability.manifest_reliability(view(spark, sf_dir, "votes"), manifests(spark, sf_dir))
    names = ["backend", "rows_on_disk", "distinct_pairs", "attempted", "succeeded", "failed", "launches", "scope", "timeouts", "contract_failures", "quota_failures", "failure_rate", "attempts_per_vote", "latency_median", "latency_p95", "unusable_at_scale"]
    return rounded(r, "failure_rate", "attempts_per_vote", "latency_median", "latency_p95").select(*names)


@query(f"with {COUNTED} select backend, j as contract_failures, ok as succeeded from c where j > 0")
def compliance(spark, sf_dir):
    return caveats.compliance(reliability.manifest_counts(manifests(spark, sf_dir)))


@query("""with last as (select backend, max(launch) as launch from calls group by backend), h as (select c.backend, count(*) filter (ok = 1) as calls_ok, count(*) filter (ok = 0) as calls_failed from calls c join last l on l.backend = c.backend and l.launch = c.launch where c.backend <> 'm4' group by c.backend),
 d as (select roster.backend, count(pair_id) as n_rows, count(distinct pair_id) as n_pairs from roster left join votes on votes.backend = roster.backend group by roster.backend)
 select d.backend, n_rows, n_pairs, 3 * (select count(*) from pairs ) as expected_rows, calls_ok, calls_failed from d left join h on h.backend = d.backend""")
def completion_with_health(spark, sf_dir):
    return reliability.completion(view(spark, sf_dir, "votes"), view(spark, sf_dir, "roster"), 3, view(spark, sf_dir, "pairs"), manifests(spark, sf_dir))


@query("""with r as (select backend, min(base_url) as url from votes where backend in ('m0', 'm5') group by backend), m as (select distinct backend, 'https://manifest.' || backend || '.example/v1' as url from calls where backend <> 'm4'),
 u as (select coalesce(r.backend, m.backend) as backend, coalesce(r.url, m.url) as url from r full join m on m.backend = r.backend)
 select regexp_extract(url, '://([^/?#]*)', 1) as host, count(*) as backends, string_agg(backend, ',' order by backend) as names from u group by 1""")
def hosts_with_manifests(spark, sf_dir):
    return reliability.host_concentration(view(spark, sf_dir, "votes").where("backend in ('m0', 'm5')"), manifests(spark, sf_dir))


RETIRED = "case when run_index = 2 and backend in ('m0', 'm2') and verdict = 'reject' then 'truncation_worse' else reason end"


@query(f"select 'v' || run_index as prompt_version, count(*) as votes, string_agg(distinct backend, ',' order by backend) as backends from votes where {RETIRED} = 'truncation_worse' group by 1")
def retired_votes(spark, sf_dir):
    v = view(spark, sf_dir, "votes").withColumns({"reason": F.expr(RETIRED), "prompt_version": F.concat(F.lit("v"), F.col("run_index").cast("string"))})
    return caveats.retired_votes(v)


@query(f"""with {JUDGED}, cells as (select backend, case when true_reason = 'meaning_change' then 'truncation_worse' else true_reason end as true_reason, reason from judged where reason is not null)
 select backend, true_reason, reason, count(*) as pairs from cells where true_reason = 'truncation_worse' group by all""")
def confusion_on_retired_axis(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs").withColumn("reason", F.when(F.col("reason") == "meaning_change", "truncation_worse").otherwise(F.col("reason")))
    return caveats.on_retired_axis(score.reason_confusion(score.judged(view(spark, sf_dir, "votes"), pairs)))


@query(f"""with {JUDGED}, j as (select backend, count(*) as judged, count(verdict) as n from judged group by backend), total as (select count(*) as total_pairs from pairs )
 select roster.backend, coalesce(judged, 0) as judged, total_pairs, coalesce(judged, 0) = total_pairs and n > 0 as ranked from roster join total on true left join j on j.backend = roster.backend""")
def full_coverage(spark, sf_dir):
    s = score.score_models(view(spark, sf_dir, "votes"), view(spark, sf_dir, "pairs"), view(spark, sf_dir, "roster"))
    return caveats.full_coverage(s).select("backend", "judged", "total_pairs", (F.col("ranked") & (F.col("judged") > 0)).alias("ranked")).withColumn("ranked", F.when(F.col("judged") > 0, F.col("ranked")).otherwise(F.lit(False)))


@query("select pair_id, 'approve ' || (n / 2) :: bigint || ' = reject ' || (n / 2) :: bigint as tie from (select pair_id, count(*) as n, count(*) filter (verdict = 'approve') as a from votes where backend = 'm0' group by pair_id) where 2 * a = n")
def tied_pairs(spark, sf_dir):
    return caveats.tied_pairs(tallied(spark, sf_dir).where("backend = 'm0'"))


STATUS = "case when event_id % 3 = 0 then 200 else 429 end"
HEADER = "case event_id % 7 when 0 then null when 1 then 'soon' when 2 then '-4' when 3 then '0' when 4 then '2.5' when 5 then '9999' else cast(event_id % 250 as string) end"


@query(f"""select event_id, case when status = 429 then least(300.0, case when header is null or header = 'soon' or header = '-4' then 30.0 else cast(header as double) end) end as wait_s
 from (select event_id, {STATUS} as status, {HEADER} as header from events)""")
def retry_after(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(STATUS).alias("status"), F.expr(HEADER).alias("header"))
    return e.select("event_id", text.retry_after(F.col("status"), F.col("header")).cast("double").alias("wait_s"))


REFUSAL = """case event_id % 5 when 0 then concat('{"error": {"type": "insufficient_quota", "code": "c', event_id % 9, '", "message": "pay"}}') when 1 then '{"error": {"code": "billing_not_active"}}'
 when 2 then '{"error": {"type": "rate_limit", "message": "insufficient_quota is what this is not"}}' when 3 then 'no json' else '{"error": "quota_exceeded"}' end"""


@query(f"select event_id, case when {STATUS} = 429 then case event_id % 5 when 0 then 'pay [insufficient_quota/c' || (event_id % 9) || ']' when 1 then 'billing_not_active' end end as detail from events")
def quota_failure(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(STATUS).alias("status"), F.expr(REFUSAL).alias("body"))
    return e.select("event_id", text.quota_failure(F.col("status"), F.col("body")).alias("detail"))


@query("select id, brand is null = (mpn is null) as whole, (ground_truth = 'approve') = (reason = 'ok') as consistent, ground_truth in ('approve', 'reject') and reason in ('ok', 'casing_error', 'overcorrection', 'meaning_change', 'truncation_worse') as in_domain from pairs ")
def ruling_checks(spark, sf_dir):
    p = view(spark, sf_dir, "pairs")
    return p.select("id", guards.whole_ruling(F.col("brand"), F.col("mpn")).alias("whole"), guards.consistent_ruling(F.col("ground_truth"), F.col("reason")).alias("consistent"), guards.in_domain(F.col("ground_truth"), F.col("reason")).alias("in_domain"))


@query("select o_custkey, max(o_orderkey) as o_orderkey, max_by(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey")
def last_per_id(spark, sf_dir):
    return journal.last_per_id(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("select c_mktsegment as cohort, count(*) as rows from customer group by 1")
def cohort_counts(spark, sf_dir):
    return caveats.cohort_counts(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cohort")))


def _files(df: DataFrame, parts: int) -> tuple[str, str]:
    """The rows as several JSON files, to be streamed."""
    path = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.repartition(parts).write.json(path)
    return path, df._jdf.schema().toDDL()


@query()
def stream_tally(spark, sf_dir):
    path, schema = _files(view(spark, sf_dir, "votes"), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(path)
    out = twins.run_to_end(spark, twins.stream_tally(stream))
    return rounded(out, "verdict_flip_rate", "reason_flip_rate").select("backend", "pair_id", "n_votes", "verdict", "reason", "verdict_flip_rate", "reason_flip_rate")


@query("select backend, count(*) filter (ok = 1) as calls_ok, count(*) filter (ok = 0) as calls_failed, round(min(latency_s) filter (ok = 1), 6) as latency_min, round(max(latency_s) filter (ok = 1), 6) as latency_max from calls group by backend")
def stream_health(spark, sf_dir):
    path, schema = _files(view(spark, sf_dir, "calls"), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(path)
    return rounded(twins.run_to_end(spark, twins.stream_health(stream)), "latency_min", "latency_max")


ORACLES["stream_tally"] = ORACLES["tally_votes"]
