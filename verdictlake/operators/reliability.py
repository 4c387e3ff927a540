"""Call health, token use, launches, reliability and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed, ranges

# Thresholds, and names of failures.
PREFIX_SLACK, UNUSABLE = 1.1, 2.0
TIMEOUT_SUFFIX, CONTRACT, QUOTA = "Timeout", "JudgeResponseError", "QuotaExhausted"
IDENTITY = ("model_id", "base_url", "api", "temperature", "reasoning_effort", "config_digest", "code_version")


def error_kinds(calls: DataFrame, *keys: str) -> DataFrame:
    return calls.where("ok = 0").groupBy(*keys, "error_kind").agg(F.count("*").alias("calls"))


def shown(kind: str, count: str) -> Column:
    """Counts by kind as text in order of the kinds: equal maps are equal texts."""
    pairs = F.array_sort(F.collect_list(F.struct(kind, count)))
    return F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x[kind], x[count].cast("string"))), ",")


#: Values of one group that may meet in one task as they are; above that, a sketch says between which values a rank lies.
SKETCH = 50_000
#: Ranks from 1 among n values: both middles of the median, and the nearest rank of the tail.
_RANKS = {
    "low": (0.5, lambda n: F.floor((n + 1) / 2)),
    "high": (0.5, lambda n: F.floor(n / 2) + 1),
    "tail": (0.95, lambda n: F.ceil(n * F.lit(19) / F.lit(20))),
}


def order_statistics(rows: DataFrame, keys: list[str], value: str, sketch: int = SKETCH) -> DataFrame:
    """Per group: n, and the exact values at the ranks `low`, `high` (the middles) and `tail`.

    A mergeable quantile summary of each group, wrong by at most 1 / sketch of its ranks,
    brackets each wanted rank between two values. Then the values below the bracket are
    only counted, and those inside are counted by value, summed up and looked through:
    6 / sketch of a group at most, however close together its values lie. Groups of
    `sketch` values or fewer need no bracket.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    at = sorted({max(0.0, min(1.0, q + side * 3 / sketch)) for q, _ in _RANKS.values() for side in (-1, 1)})
    place = {(q, side): at.index(max(0.0, min(1.0, q + side * 3 / sketch))) for q, _ in _RANKS.values() for side in (-1, 1)}
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_value", at, sketch).alias("_at"))
    few, inf = F.col("n") <= sketch, float("inf")
    edge = lambda q, side: F.when(few, F.lit(side * inf)).otherwise(F.col("_at")[place[q, side]].cast("double"))
    wanted = [F.struct(F.lit(k).alias("what"), rank(F.col("n")).cast("long").alias("rank"), edge(q, -1).alias("low"), edge(q, 1).alias("high")) for k, (q, rank) in _RANKS.items()]
    brackets = sizes.select(*keys, F.explode(F.array(*wanted)).alias("_w")).select(*keys, "_w.*")
    # counted by value where several brackets or calls share it; of what lies below only a number is left
    of = [*keys, "what", "rank"]
    near = known.join(brackets, keys).where(F.col("_value") <= F.col("high"))
    inside = F.when(F.col("_value") >= F.col("low"), F.col("_value"))
    counts = near.groupBy(*of, inside.alias("_in")).agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*of).orderBy(F.asc_nulls_first("_in")))
    hit = counts.withColumn("_to", up_to).where((F.col("rank") <= F.col("_to")) & (F.col("rank") > F.col("_to") - F.col("_c")))
    found = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == k, F.col("_in"))).alias(k) for k in _RANKS])
    return sizes.select(*keys, "n").join(found, keys, "left")


def latencies(calls: DataFrame, *keys: str, sketch: int = SKETCH) -> DataFrame:
    """Counts and exact order statistics of the latencies of good and failed calls. No task and no aggregate holds all values of a backend."""
    good, bad = F.when(F.col("ok") == 1, F.col("latency_s")), F.when(F.col("ok") == 0, F.col("latency_s"))
    main = calls.groupBy(*keys).agg(
        F.count_if(F.col("ok") == 1).alias("calls_ok"), F.count_if(F.col("ok") == 0).alias("calls_failed"), F.min(good).alias("latency_min"),
        F.max(good).alias("latency_max"), F.max(bad).alias("failed_latency_max"),
    )
    found = order_statistics(calls.where(F.col("ok").isin(0, 1)), [*keys, "ok"], "latency_s", sketch)
    pick = lambda ok, c: F.max(F.when(F.col("ok") == ok, c))
    middle = (F.col("low") + F.col("high")) / 2
    at = found.groupBy(*keys).agg(pick(1, middle).alias("latency_median"), pick(1, F.col("tail")).alias("latency_p95"), pick(0, middle).alias("failed_latency_median"))
    names = ("calls_ok", "calls_failed", "latency_min", "latency_median", "latency_p95", "latency_max", "failed_latency_median", "failed_latency_max")
    return main.join(at, list(keys), "left").select(*keys, *names)


def health_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """Counts and order statistics; failures are timed apart. The tail is a latency that was observed (nearest rank)."""
    main = latencies(calls, *keys)
    kinds = error_kinds(calls, *keys).groupBy(*keys).agg(shown("error_kind", "calls").alias("error_kinds"))
    return main.join(kinds, list(keys), "left").withColumn("error_kinds", F.coalesce("error_kinds", F.lit("")))


def usage_summary(rows: DataFrame, key: str, fields: tuple[str, ...], measured: Column) -> DataFrame:
    """Sums stay null until a call reports; unmeasured calls are counted."""
    return rows.groupBy(key).agg(
        F.count_if(measured).alias("calls_measured"),
        F.count_if(~measured).alias("calls_unmeasured"),
        *[F.sum(f).alias(f) for f in fields],
        F.count_if(F.col("cached_tokens") > 0).alias("calls_with_cache_hit"),
    )


def same_run(before: str, now: str, fields: tuple[str, ...] = IDENTITY) -> Column:
    """Unknown on either side is not a difference."""
    out = F.lit(True)
    for f in fields:
        out = out & F.coalesce(F.col(f"{before}.{f}") == F.col(f"{now}.{f}"), F.lit(True))
    return out


def launch_accumulation(calls: DataFrame) -> DataFrame:
    """Counts over all launches of a backend; latencies of the latest launch alone, since medians do not add up."""
    per = health_summary(calls, "backend", "launch")
    last = per.groupBy("backend").agg(F.max_by(F.struct("latency_median", "latency_p95", "latency_max"), "launch").alias("last"), F.count("*").alias("launches"), F.sum("calls_ok").alias("calls_ok"), F.sum("calls_failed").alias("calls_failed"))
    kinds = error_kinds(calls, "backend").groupBy("backend").agg(shown("error_kind", "calls").alias("error_kinds"))
    return last.join(kinds, "backend", "left").select("backend", "launches", "calls_ok", "calls_failed", F.coalesce("error_kinds", F.lit("")).alias("error_kinds"), F.col("last.latency_median").alias("latency_median"), F.col("last.latency_p95").alias("latency_p95"))


def accumulate(previous: DataFrame, launches: DataFrame) -> DataFrame:
    """Fold a new launch of each backend into its history.

    previous: backend, identity, launches (array of health); launches: backend,
    identity, health. A history of another identity is dropped, and counted.
    """
    joined = launches.alias("l").join(previous.alias("p"), "backend", "left").select("backend", F.col("l.identity").alias("now"), F.col("p.identity").alias("before"), "health", F.col("p.launches").alias("old"))
    fields = tuple(f for f in IDENTITY if all(f in joined.schema[side].dataType.names for side in ("now", "before")))
    keep = F.col("before").isNull() | same_run("before", "now", fields)
    none = F.slice(F.array("health"), 1, 0)
    old = F.coalesce("old", none)
    out = joined.select("backend", F.concat(F.when(keep, old).otherwise(none), F.array("health")).alias("launches"), F.when(keep, 0).otherwise(F.size(old)).alias("discarded_prior_launches"))
    kinds = out.select("backend", F.explode("launches").alias("x")).select("backend", F.explode("x.error_kinds").alias("k", "v")).groupBy("backend", "k").agg(F.sum("v").alias("v"))
    kinds = kinds.groupBy("backend").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("error_kinds"))
    total = lambda f: F.aggregate("launches", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[f], F.lit(0).cast("long")))
    out = out.withColumns({"n_launches": F.size("launches"), "calls_ok": total("calls_ok"), "calls_failed": total("calls_failed")})
    return out.join(kinds, "backend", "left")


def judged_reliability(counts: DataFrame) -> DataFrame:
    """rows_on_disk, attempted..., error maps -> rates and the three-valued verdict on use at scale.

    counts: backend, scope, succeeded, failed, error_kinds map. No manifest (scope
    `none`) is no evidence; only billing refusals are none either.
    """
    kinds = F.coalesce("error_kinds", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    zero = F.lit(0).cast("long")
    c = counts.withColumns(
        {
            "attempted": F.when(F.col("scope") != "none", F.coalesce("succeeded", zero) + F.coalesce("failed", zero)),
            "timeouts": F.aggregate(F.map_values(F.map_filter(kinds, lambda k, v: k.endswith(TIMEOUT_SUFFIX))), zero, lambda a, v: a + v),
            "contract_failures": F.coalesce(F.try_element_at(kinds, F.lit(CONTRACT)), zero),
            "quota_failures": F.coalesce(F.try_element_at(kinds, F.lit(QUOTA)), zero),
        }
    )
    c = c.withColumns({"failure_rate": F.coalesce("failed", zero) / F.nullif("attempted", zero), "attempts_per_vote": F.coalesce("attempted", zero) / F.nullif("succeeded", zero)})
    none = F.lit(None).cast("boolean")
    unusable = F.when((F.col("scope") == "none") | F.col("attempted").isNull(), none).when((F.col("quota_failures") > 0) & (F.col("quota_failures") == F.col("failed")), none)
    return c.withColumn("unusable_at_scale", unusable.when(F.col("succeeded") == 0, True).otherwise(F.col("attempts_per_vote") >= UNUSABLE))


def row_counts(votes: DataFrame, tallied: DataFrame | None = None) -> DataFrame:
    """Rows and distinct pairs of each backend; from the votes' tally by backend and pair, if it is there already."""
    if tallied is None:
        return votes.groupBy("backend").agg(F.count("*").alias("rows_on_disk"), F.count_distinct("pair_id").alias("distinct_pairs"))
    return tallied.groupBy("backend").agg(F.sum("n_votes").alias("rows_on_disk"), F.count("pair_id").alias("distinct_pairs"))


def reliability(votes: DataFrame, calls: DataFrame, tallied: DataFrame | None = None) -> DataFrame:
    """Backends with rows or with a call log, never only those with both."""
    rows = row_counts(votes, tallied)
    kinds = error_kinds(calls, "backend").groupBy("backend").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_kind", "calls")))).alias("error_kinds"))
    log = calls.groupBy("backend").agg(F.count_if(F.col("ok") == 1).alias("succeeded"), F.count_if(F.col("ok") == 0).alias("failed"), F.count_distinct("launch").alias("launches")).join(kinds, "backend", "left").withColumn("scope", F.lit("cumulative"))
    both = rows.join(log, "backend", "full_outer")
    zero = F.lit(0).cast("long")
    both = both.withColumns({"rows_on_disk": F.coalesce("rows_on_disk", zero), "distinct_pairs": F.coalesce("distinct_pairs", zero), "scope": F.coalesce("scope", F.lit("none"))})
    return judged_reliability(both)


def manifest_counts(manifests: DataFrame) -> DataFrame:
    """Counts of a manifest: `cumulative` where it says something, else `health`; latencies always from `health`."""
    has = lambda c: F.col(c).isNotNull() & (F.to_json(c) != "{}")
    pick = lambda f: F.when(has("cumulative"), F.col(f"cumulative.{f}")).when(has("health"), F.col(f"health.{f}"))
    scope = F.when(has("cumulative"), "cumulative").when(has("health"), "last-launch").otherwise("none")
    return manifests.select("backend", scope.alias("scope"), pick("calls_ok").alias("succeeded"), pick("calls_failed").alias("failed"), pick("error_kinds").alias("error_kinds"), F.when(has("cumulative"), F.col("cumulative.launches")).alias("launches"), "health.latency_median", "health.latency_p95")


def manifest_reliability(votes: DataFrame, manifests: DataFrame, tallied: DataFrame | None = None) -> DataFrame:
    """`reliability` where the counts come from manifests: backends with rows or with a manifest. Latencies are those of the latest launch."""
    rows = row_counts(votes, tallied)
    both = rows.join(manifest_counts(manifests), "backend", "full_outer")
    zero = F.lit(0).cast("long")
    return judged_reliability(both.withColumns({"rows_on_disk": F.coalesce("rows_on_disk", zero), "distinct_pairs": F.coalesce("distinct_pairs", zero), "scope": F.coalesce("scope", F.lit("none"))}))


def coverage_shapes(votes: DataFrame, order: DataFrame | None = None, total_pairs: int | None = None, source: str = "pairs-file") -> DataFrame:
    """Where each backend's pairs lie in the file. order: (pair_id, rank from 0).

    Ids that the order does not know come after it: backend by backend, then by id.
    """
    seen = votes.select("backend", "pair_id").distinct()
    order = reconstructed_order(votes) if order is None else order
    known = order.agg(F.count("*").alias("n_order"))
    extra = seen.join(order, "pair_id", "left_anti").groupBy("pair_id").agg(F.min("backend").alias("b"))
    tail = placed(extra, [("b", False)], ["pair_id"]).join(F.broadcast(known)).select("pair_id", (F.col("place") - 1 + F.col("n_order")).alias("rank"))
    ranked = order.select("pair_id", F.col("rank").cast("long").alias("rank")).unionByName(tail)
    size = ranked.agg(F.greatest(F.count("*"), F.lit(total_pairs or 0)).alias("total_pairs"))
    ranks = seen.join(order, "pair_id").select("backend", F.col("rank").cast("long").alias("rank")).unionByName(seen.join(tail, "pair_id").select("backend", "rank"))
    by = ranks.groupBy("backend").agg(F.count("*").alias("distinct_pairs"), (F.max("rank") + 1).alias("span")).join(F.broadcast(size))
    short = F.col("distinct_pairs") < F.col("total_pairs")
    prefix = short & (F.col("span") < F.col("total_pairs")) & (F.col("span") <= F.col("distinct_pairs") * PREFIX_SLACK)
    shape = F.when(~short, "complete").when(prefix, "prefix").when(F.col("span") < F.col("total_pairs"), "spread, stopped early").otherwise("scattered gaps")
    return by.withColumns({"is_prefix": prefix, "shape": shape, "order_source": F.lit(source)})


def reconstructed_order(votes: DataFrame) -> DataFrame:
    """File order from the log: first places in the backend that saw most pairs, then what only others saw. votes need `pos`."""
    seen = votes.groupBy("backend", "pair_id").agg(F.min("pos").alias("first"))
    sizes = seen.groupBy("backend").agg(F.count("*").alias("n"))
    ref = sizes.agg(F.min(F.struct((-F.col("n")).alias("n"), "backend"))["backend"].alias("backend"))
    main = seen.join(F.broadcast(ref), "backend").select("pair_id", F.lit(0).alias("part"), F.lit("").alias("b"), "first")
    rest = seen.join(main, "pair_id", "left_anti").groupBy("pair_id").agg(F.min("backend").alias("b")).select("pair_id", F.lit(1).alias("part"), "b", F.lit(0).cast("long").alias("first"))
    both = main.withColumn("first", F.col("first").cast("long")).unionByName(rest).withColumn("range", ranges("first"))
    out = placed(both, [("part", False), ("b", False), ("range", False)], ["first", "pair_id"])
    return out.select("pair_id", (F.col("place") - 1).alias("rank"))


def host_of(url: Column) -> Column:
    """Authority of a URL with its port; without a scheme, what stands before the first slash."""
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.get(F.split(url, "/"), F.lit(0)))


def host_concentration(votes: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Backends per host: the rows' host first, then the manifest's."""
    rows = votes.where("base_url <> ''").groupBy("backend").agg(F.min("base_url").alias("row_url"))
    if manifests is not None:
        rows = rows.join(manifests.select("backend", F.nullif("base_url", F.lit("")).alias("m_url")), "backend", "full_outer")
        rows = rows.withColumn("row_url", F.coalesce("row_url", "m_url")).where("row_url is not null")
    hosts = rows.withColumn("host", host_of(F.col("row_url"))).groupBy("host").agg(F.count("*").alias("backends"), F.array_join(F.array_sort(F.collect_list("backend")), ",").alias("names"))
    return hosts


def completion(votes: DataFrame, roster: DataFrame, votes_per_pair: int, total: DataFrame, manifests: DataFrame | None = None, tallied: DataFrame | None = None) -> DataFrame:
    """Rows per backend against what was asked for; with manifests, also the calls of the latest launch."""
    zero = F.lit(0).cast("long")
    if manifests is not None:
        calls = manifests.select("backend", F.col("health.calls_ok").alias("calls_ok"), F.col("health.calls_failed").alias("calls_failed"))
        return completion(votes, roster, votes_per_pair, total, tallied=tallied).join(calls, "backend", "left")
    by = row_counts(votes, tallied).withColumnsRenamed({"rows_on_disk": "n_rows", "distinct_pairs": "n_pairs"})
    out = roster.join(by, "backend", "left").join(F.broadcast(total.agg(F.count("*").alias("total_pairs"))))
    return out.select("backend", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_pairs", zero).alias("n_pairs"), (F.col("total_pairs") * votes_per_pair).alias("expected_rows"))
