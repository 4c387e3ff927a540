"""Checks that refuse bad input, as one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIG_FIELDS, PROVENANCE_FIELDS, REASONS, VERDICTS


class GuardError(ValueError):
    pass


def in_domain(verdict: Column, reason: Column) -> Column:
    return verdict.isin(*VERDICTS) & reason.isin(*REASONS)


def whole_ruling(truth: Column, reason: Column) -> Column:
    """Truth and reason are known together or not at all."""
    return truth.isNull() == reason.isNull()


def consistent_ruling(truth: Column, reason: Column) -> Column:
    """An approval has the reason `ok` and a rejection has another."""
    return (truth == "approve") == (reason == "ok")


def unchanged(original: Column, enriched: Column) -> Column:
    return original.eqNullSafe(enriched)


def require_ruled(pairs: DataFrame) -> None:
    bad = pairs.where("ground_truth is null")
    first = bad.orderBy("pos").limit(3).collect()
    if first:
        raise GuardError(f"{bad.count()} pairs have no ruling, first: {', '.join(r['id'] for r in first)}")


def config_guard(votes: DataFrame, key: str = "backend") -> DataFrame:
    """Per backend the distinct configurations; a null is a value of config fields and unknown in provenance fields."""
    have = [f for f in (*CONFIG_FIELDS, *PROVENANCE_FIELDS) if f in votes.columns]
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None")) if f in CONFIG_FIELDS else F.col(f)
    by = votes.groupBy(key).agg(*[F.array_sort(F.collect_set(value(f))).alias(f) for f in have])
    mixed = F.array_compact(F.array(*[F.when(F.size(f) > 1, F.lit(f)) for f in have]))
    return by.select(key, *[F.array_join(f, ",").alias(f) for f in have], F.array_join(mixed, ",").alias("mixed_fields"))


def provenance_audit(rows: DataFrame, key: str = "backend", corrupt: str | None = None) -> DataFrame:
    """Distinct provenance of a results file, rows without any, and whether it can be one run."""
    sets = {f: F.array_sort(F.collect_set(f)) if f in rows.columns else F.array().cast("array<string>") for f in PROVENANCE_FIELDS}
    good = F.col(corrupt).isNull() if corrupt else F.lit(True)
    unknown = good & (F.col("code_version").isNull() if "code_version" in rows.columns else F.lit(True)) & F.col("base_url").isNull()
    by = rows.groupBy(key).agg(*[c.alias(f) for f, c in sets.items() if f in rows.columns], F.count_if(unknown).alias("unknown_rows"), F.count_if(~good).alias("malformed_rows"), F.count("*").alias("total_rows"))
    have = [f for f in PROVENANCE_FIELDS if f in rows.columns]
    most = F.greatest(*[F.size(f) for f in have], F.lit(0))
    mixed = (most > 1) | ((F.col("malformed_rows") > 0) & (most > 0)) | ((most == 1) & (F.col("unknown_rows") > 0))
    return by.select(key, *[F.array_join(f, ",").alias(f) for f in have], "unknown_rows", "malformed_rows", "total_rows", mixed.alias("is_mixed"))


def resume_keys(rows: DataFrame, run: dict, manifest_host: str | None = None, allow_unknown: bool = False) -> DataFrame:
    """(pair_id, run_index) already judged under the run's configuration; raises if rows come from another run.

    Config fields must be equal, null included; provenance fields only where both
    know them. Rows that lack what the run knows are unproven: the host of the
    manifest beside them settles it, else the caller must accept them. One aggregate.
    """
    other, unproven = F.lit(False), F.lit(False)
    for f in CONFIG_FIELDS:
        other = other | ~F.col(f).eqNullSafe(F.lit(run.get(f)))
    for f in PROVENANCE_FIELDS:
        if run.get(f) is not None:
            other = other | F.coalesce(F.col(f) != run[f], F.lit(False))
            unproven = unproven | F.col(f).isNull()
    found = rows.agg(F.count_if(other).alias("other"), F.count_if(unproven).alias("unproven")).first()
    if found["other"]:
        raise GuardError(f"{found['other']} rows were judged under another configuration")
    if found["unproven"]:
        known = manifest_host is not None and run.get("base_url") is not None
        if known and manifest_host != run["base_url"]:
            raise GuardError(f"rows without a host were served by {manifest_host}")
        if not known and not allow_unknown:
            raise GuardError(f"{found['unproven']} rows lack provenance and no manifest supplies it")
    return rows.select("pair_id", "run_index").distinct()


def pending_votes(pairs: DataFrame, done: DataFrame, votes: int) -> DataFrame:
    """(pair_id, run_index) still to judge, with file position; order by pos, run_index."""
    todo = pairs.select(F.col("id").alias("pair_id"), "pos", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("run_index"))
    return todo.join(done.select("pair_id", F.col("run_index").cast("int").alias("run_index")), ["pair_id", "run_index"], "left_anti")
