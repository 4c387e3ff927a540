"""Run manifests: what a launch was, how its calls went, and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt_variant
from .reliability import IDENTITY, accumulate, error_kinds, latencies


def health(calls: DataFrame) -> DataFrame:
    """backend, health: the struct that manifests hold."""
    kinds = error_kinds(calls, "backend").groupBy("backend").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_kind", "calls")))).alias("error_kinds"))
    by = latencies(calls, "backend")
    fields = [c for c in by.columns if c != "backend"]
    return by.join(kinds, "backend", "left").select("backend", F.struct(*fields, "error_kinds").alias("health"))


def variants(pairs: DataFrame) -> DataFrame:
    """One row: prompts by the attributes that they name."""
    by = pairs.groupBy(prompt_variant(F.col("brand"), F.col("mpn")).alias("k")).agg(F.count("*").alias("v"))
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("prompt_variants"), F.sum("v").alias("n_pairs"))


def run_manifest(slate: DataFrame, calls: DataFrame, pairs: DataFrame, previous: DataFrame, settings: dict) -> DataFrame:
    """One manifest per backend. previous: backend, identity, launches. A prior launch of another identity is dropped and counted."""
    runs = slate.withColumnRenamed("name", "backend").withColumns({k: F.lit(v) for k, v in settings.items()})
    named = [f for f in IDENTITY if f in runs.columns]
    now = runs.join(health(calls), "backend").select("backend", F.struct(*named).alias("identity"), "health")
    done = accumulate(previous, now)
    total = F.struct(F.col("n_launches").cast("long").alias("launches"), "calls_ok", "calls_failed", "error_kinds", F.col("discarded_prior_launches").cast("long").alias("discarded_prior_launches"))
    out = runs.join(now.select("backend", "health"), "backend").join(done.select("backend", "launches", total.alias("cumulative")), "backend")
    return out.join(F.broadcast(variants(pairs)))  # one row
