"""Vote consolidation: majority of N with an explicit state for no majority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AXES


def _axis(axis: str, domain: tuple[str, ...], n: Column) -> dict[str, Column]:
    """Ruling and flip rate from one count per value: order never matters, ties rule nothing."""
    counts = [F.col(f"n_{axis}_{v}") for v in domain]
    most = F.greatest(*counts)
    at_most = reduce(lambda a, b: a + b, [(c == most).cast("int") for c in counts])
    winner = F.coalesce(*[F.when(c == most, F.lit(v)) for c, v in zip(counts, domain, strict=True)])
    return {axis: F.when((at_most == 1) & (most > 0), winner), f"{axis}_flip_rate": F.when(most > 0, 1 - most / n).otherwise(0.0)}


KEYS = ("backend", "pair_id")
#: Rows of a tally in a task.
ROWS = 196_608


def counters(axes: dict[str, tuple[str, ...]] = AXES) -> list[str]:
    """Names of a tally's counters: of all votes, and of each value."""
    return ["n_votes", *[f"n_{a}_{v}" for a, domain in axes.items() for v in domain]]


def counted(votes: DataFrame, keys: tuple[str, ...] = KEYS, axes: dict[str, tuple[str, ...]] = AXES) -> DataFrame:
    """One row of counters per key."""
    values = [F.count_if(F.col(a) == v).alias(f"n_{a}_{v}") for a, domain in axes.items() for v in domain]
    return votes.groupBy(*keys).agg(F.count("*").alias("n_votes"), *values)


def ruled(counts: DataFrame, axes: dict[str, tuple[str, ...]] = AXES) -> DataFrame:
    """Counters with the ruling and flip rate of each axis."""
    for axis, domain in axes.items():
        counts = counts.withColumns(_axis(axis, domain, F.col("n_votes")))
    return counts


def tally(votes: DataFrame, keys: tuple[str, ...] = KEYS, axes: dict[str, tuple[str, ...]] = AXES, dedupe: bool = False) -> DataFrame:
    """One row per key: n_votes, a count per value, and the ruling and flip rate of each axis.

    One shuffle: values have a fixed domain, so each is a counter of one partial
    hash aggregate and a key with very many votes is summed up before it moves.
    With `dedupe`, repeated run_index values of a key count once.
    """
    if dedupe:
        votes = votes.dropDuplicates([*keys, "run_index"])
    return ruled(counted(votes, keys, axes), axes)


def tally_any(votes: DataFrame, value: str, keys: tuple[str, ...] = ("backend", "pair_id")) -> DataFrame:
    """The same for values without a fixed domain: keys, n, ruling, flip_rate, n_top."""
    by = votes.groupBy(*keys, value).agg(F.count("*").alias("c"))
    top = by.groupBy(*keys).agg(F.sum("c").alias("n"), F.max(F.struct("c", value)).alias("hi"))
    most = by.join(top.select(*keys, F.col("hi.c").alias("mx")), list(keys)).where("c = mx").groupBy(*keys).agg(F.count("*").alias("n_top"))
    out = top.join(most, list(keys))
    return out.select(*keys, "n", F.when(F.col("n_top") == 1, F.col(f"hi.{value}")).alias("ruling"), (1 - F.col("hi.c") / F.col("n")).alias("flip_rate"), "n_top")


def majority_first_seen(votes: DataFrame, value: str, order: list[str], keys: tuple[str, ...] = ("backend", "pair_id")) -> DataFrame:
    """Mode; of equally frequent values the one seen first in `order` wins."""
    by = votes.groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("c")).alias("c"), F.col("first"), F.col(value).alias("v")))
    return by.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.v").alias("ruling"), (-F.col("best.c")).alias("votes"))


def stability(tallied: DataFrame, roster: DataFrame) -> DataFrame:
    """Per backend over all tallied pairs; backends without rows have counts 0 and null rates."""
    unstable = (F.col("verdict_flip_rate") > 0) | (F.col("reason_flip_rate") > 0)
    by = tallied.groupBy("backend").agg(
        F.count("*").alias("pairs"),
        F.max("n_votes").alias("max_votes"),
        F.avg("verdict_flip_rate").alias("verdict_flip"),
        F.avg("reason_flip_rate").alias("reason_flip"),
        F.count_if(unstable).alias("unstable_pairs"),
    )
    zero = F.lit(0).cast("long")
    return roster.join(by, "backend", "left").withColumns({c: F.coalesce(c, zero) for c in ("pairs", "max_votes", "unstable_pairs")})
