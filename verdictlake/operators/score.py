"""Scores against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import GuardError
from .ranking import placed, ranges
from .tally import tally


def kappa_of(observed: Column, expected: Column) -> Column:
    """Chance-corrected agreement, with the edge cases of a single label and of no rows."""
    ratio = (observed - expected) / F.nullif(1 - expected, F.lit(0.0))
    return F.when(observed.isNull(), 0.0).when(expected == 1.0, F.when(observed == 1.0, 1.0).otherwise(0.0)).otherwise(ratio)


def cohens_kappa(rows: DataFrame, truth: str, predicted: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key: n and kappa, for any set of labels. The rows are counted once; the rest works on the confusion counts."""
    cells = rows.groupBy(*keys, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    one = F.lit(1).alias("_k")
    cells = cells.select(*keys, one, "t", "p", "c")
    on = [*keys, "_k"]
    total = cells.groupBy(*on).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*on, F.col("t").alias("label")).agg(F.sum("c").alias("a"))
    right = cells.groupBy(*on, F.col("p").alias("label")).agg(F.sum("c").alias("b"))
    chance = left.join(right, [*on, "label"]).groupBy(*on).agg(F.sum(F.col("a") * F.col("b")).alias("chance"))
    out = total.join(chance, on, "left")
    n = F.col("n")
    expected = F.coalesce("chance", F.lit(0)) / (n * n)
    return out.select(*keys, "n", kappa_of(F.col("same") / n, expected).alias("kappa"))


def known_votes(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Votes of known pairs; an error if there are votes and none is of a known pair."""
    known = votes.join(pairs.select(F.col("id").alias("pair_id")), "pair_id", "left_semi")
    if not known.take(1) and votes.take(1):
        raise GuardError("no vote is of a pair with ground truth")
    return known


def judged(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tallied votes of known pairs with their truth; others are dropped (see known_votes)."""
    truth = pairs.select(F.col("id").alias("pair_id"), "pos", "ground_truth", F.col("reason").alias("true_reason"))
    return tally(votes).join(truth, "pair_id")


def reason_confusion(scored: DataFrame) -> DataFrame:
    """True reason by ruled reason, wherever the reason is settled."""
    return scored.where("reason is not null").groupBy("backend", "true_reason", "reason").agg(F.count("*").alias("pairs"))


def per_run_kappas(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Kappa of each vote index over all votes of known pairs, settled or not."""
    rows = votes.join(pairs.select(F.col("id").alias("pair_id"), "ground_truth"), "pair_id")
    return cohens_kappa(rows, "ground_truth", "verdict", ("backend", "run_index"))


def mean_sd(rows: DataFrame, value: str, key: str = "backend") -> DataFrame:
    """Mean and sample deviation; one value deviates by 0."""
    return rows.groupBy(key).agg(F.count("*").alias("n_runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def score_models(votes: DataFrame, pairs: DataFrame, roster: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row per backend; all metrics but kappa come from one aggregate (of `scored`, if the judged pairs are there already). A backend without known votes stays, unscored."""
    settled, flips = F.col("verdict").isNotNull(), ("verdict_flip_rate", "reason_flip_rate")
    reject = settled & (F.col("ground_truth") == "reject")
    by = (judged(votes, pairs) if scored is None else scored).groupBy("backend").agg(
        F.count("*").alias("judged"),
        F.count_if(settled).alias("n"),
        F.count_if(F.col("verdict").isNull()).alias("unsettled_verdict"),
        F.count_if(F.col("reason").isNull()).alias("unsettled_reason"),
        F.avg(F.when(settled, (F.col("verdict") == F.col("ground_truth")).cast("int"))).alias("accuracy"),
        F.coalesce(F.avg(F.when(reject, (F.col("verdict") == "approve").cast("int"))), F.lit(0.0)).alias("false_approve_rate"),
        *[F.avg(F.when(settled, F.col(c))).alias(c) for c in flips],
    )
    total = pairs.agg(F.count("*").alias("total_pairs"))
    out = roster.join(by, "backend", "left").join(F.broadcast(total))  # one row
    return out.withColumn("judged", F.coalesce("judged", F.lit(0).cast("long"))).withColumn("coverage", F.col("judged") / F.nullif(F.col("total_pairs"), F.lit(0)))


def unstable_pairs(scored: DataFrame, tasks: int | None = None) -> DataFrame:
    """Settled pairs with any flip, a row each: backend, pair_id, its place among the backend's in pairs order, and their number n. For `tasks`, see `ranking.placed`."""
    rows = scored.where("verdict is not null and (verdict_flip_rate > 0 or reason_flip_rate > 0)").select("backend", "pair_id", "pos")
    return placed(rows.withColumn("range", ranges("pos")), [("range", False)], ["pos", "pair_id"], keys=("backend",), total="n", tasks=tasks).select("backend", "pair_id", "place", "n")
