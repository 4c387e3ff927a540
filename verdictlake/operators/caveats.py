"""Small queries behind a report's caveats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RETIRED_REASONS
from .reliability import CONTRACT


def retired_votes(votes: DataFrame, n: Column | int = 1) -> DataFrame:
    """Raw votes with a reason that is no longer offered, by prompt version; `n`: the votes that a row stands for."""
    rows = votes.where(F.col("reason").isin(*RETIRED_REASONS))
    return rows.groupBy("prompt_version").agg(F.sum(n if isinstance(n, Column) else F.lit(n)).alias("votes"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"))


def on_retired_axis(confusion: DataFrame) -> DataFrame:
    """Confusion cells of which either reason is retired."""
    return confusion.where(F.col("true_reason").isin(*RETIRED_REASONS) | F.col("reason").isin(*RETIRED_REASONS))


def compliance(counts: DataFrame) -> DataFrame:
    """Replies that broke the contract, by backend, over all launches; none is not listed. counts: backend, error_kinds map, succeeded."""
    n = F.coalesce(F.try_element_at("error_kinds", F.lit(CONTRACT)), F.lit(0).cast("long"))
    return counts.select("backend", n.alias("contract_failures"), "succeeded").where("contract_failures > 0")


def full_coverage(scores: DataFrame) -> DataFrame:
    """Scores with `ranked`: whether every pair was judged, compared as whole numbers."""
    return scores.withColumn("ranked", (F.col("judged") == F.col("total_pairs")) & (F.col("n") > 0))


def manifest_pairs(manifests: DataFrame) -> Column:
    return F.max("n_pairs")


def cohort_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cohort").agg(F.count("*").alias("rows"))


def tied_pairs(tallied: DataFrame) -> DataFrame:
    """Pairs without a verdict, with the tie spelled out."""
    from ..functions.text import tied_values

    counts = F.map_from_arrays(F.array(F.lit("approve"), F.lit("reject")), F.array("n_verdict_approve", "n_verdict_reject"))
    return tallied.where("verdict is null").select("pair_id", tied_values(counts).alias("tie"))
