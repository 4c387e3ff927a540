"""Percentile bootstrap of kappa and other statistics, and tiers of overlapping intervals."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overlap import overlapping
from .score import kappa_of

SEED, RESAMPLES, ALPHA = 20260806, 1000, 0.05
#: Standard deviations on either side that a table of a binomial holds, and numbers beyond them; what is left out has a chance below 1e-18.
REACH, LEAST_HALF = 9.5, 40
#: (distinct values, how often each was drawn) -> a number
Statistic = Callable[[list[tuple], np.ndarray], float]


def ends(resamples: int, alpha: float = ALPHA) -> tuple[int, int]:
    """Sorted positions (from 0) of the interval's ends."""
    return int(resamples * alpha / 2), min(resamples - 1, int(resamples * (1 - alpha / 2)))


def kappa_statistic(values: list[tuple], counts: np.ndarray) -> float:
    """Kappa of (truth, predicted) values of any labels."""
    n = counts.sum()
    same = sum(c for (t, p), c in zip(values, counts) if t == p) / n
    labels = {x for v in values for x in v}
    side = lambda k, x: sum(c for v, c in zip(values, counts) if v[k] == x) / n
    chance = sum(side(0, x) * side(1, x) for x in labels)
    return (1.0 if same == 1.0 else 0.0) if chance == 1.0 else float((same - chance) / (1 - chance))


def accuracy_statistic(values: list[tuple], counts: np.ndarray) -> float:
    return float(sum(c for (t, p), c in zip(values, counts) if t == p) / counts.sum())


def resampled(items: DataFrame, values: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """How often n draws with replacement hit each distinct value -> backend, n, r, known (structs of `values`, in their order), drawn (as many longs).

    The numbers are multinomial, drawn value by value: of the m draws that are left, the
    next value takes a binomial number. A binomial of m is the sum of one of 2^j for each
    bit j of m, so each value needs a table of the distribution for each power of two,
    whatever is left in a resample, and all draws are made at once: the number of table
    edges at or below a uniform number, which is 52 bits of md5(seed|r|value's place|j).
    Any engine repeats it, in any order. Items are counted first and never move; tables
    hold REACH standard deviations, so the cost grows with the root of n.
    """
    by = Window.partitionBy("backend")
    in_order = by.orderBy(*[F.asc_nulls_first(v) for v in values])
    cells = items.groupBy("backend", *values).agg(F.count("*").alias("c"))
    cells = cells.select("backend", F.struct(*values).alias("value"), F.row_number().over(in_order).alias("k"), "c", F.sum("c").over(by).alias("n"), F.sum("c").over(in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"))
    cells = cells.withColumn("share", F.col("c") / F.col("left"))
    powers = cells.select("backend", "k", "n", "share", (F.col("c") == F.col("left")).alias("rest"), F.posexplode(F.array(*[F.lit(1 << j).cast("long") for j in range(62)])).alias("j", "m")).where("m <= n")
    half = F.ceil(REACH * F.sqrt(F.col("m") * F.col("share") * (1 - F.col("share")))) + LEAST_HALF
    middle = F.floor(F.col("m") * F.col("share"))
    powers = powers.withColumns({"low": F.when(F.col("rest"), F.col("m")).otherwise(F.greatest(F.lit(0).cast("long"), middle - half)), "high": F.least("m", middle + half)})
    one = ["backend", "k", "j"]
    table = Window.partitionBy(*one)
    up_to = table.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = powers.where("not rest").withColumn("x", F.explode(F.sequence("low", "high")))
    step = F.when(F.col("x") == F.col("low"), 0.0).otherwise(F.ln((F.col("m") - F.col("x") + 1) / F.col("x") * (F.col("share") / (1 - F.col("share")))))
    edges = edges.withColumn("w", F.sum(step).over(up_to)).withColumn("w", F.exp(F.col("w") - F.max("w").over(table)))
    edges = edges.withColumn("at", F.sum("w").over(up_to) / F.sum("w").over(table)).where("x < high")
    draws = powers.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "r", "k", "j").cast("binary")), 1, 13)
    draws = draws.select(*one, (F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))).alias("at"), "r", "low")
    # edges and draws in one order: no draw is compared with a whole table
    both = edges.select(*one, "at", F.lit(None).cast("int").alias("r"), F.lit(None).cast("long").alias("low")).union(draws)
    below = F.count(F.when(F.col("r").isNull(), 1)).over(table.orderBy("at", F.asc_nulls_first("r")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = both.withColumn("x", F.col("low") + below).where("r is not null")
    by_power = F.sort_array(F.collect_list(F.struct("j", "x")))
    by_value = hits.groupBy("backend", "r", "k").agg(F.transform(by_power, lambda h: h["x"]).alias("powers"))
    known = cells.groupBy("backend", "n").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("known"))
    rows = by_value.groupBy("backend", "r").agg(F.sort_array(F.collect_list(F.struct("k", "powers"))).alias("powers")).join(known, "backend")
    drawn = """aggregate(powers, struct(n as m, cast(array() as array<bigint>) as out), (a, v) -> transform(array(
      aggregate(zip_with(v.powers, sequence(0, size(v.powers) - 1), (x, j) -> x * (shiftright(a.m, j) & 1)), 0L, (s, x) -> s + x)), x -> struct(a.m - x as m, concat(a.out, array(x)) as out))[0], a -> a.out)"""
    return rows.select("backend", "n", "r", F.transform("known", lambda v: v["value"]).alias("known"), F.expr(drawn).alias("drawn"))


def _ends_of(found: DataFrame, resamples: int, alpha: float) -> DataFrame:
    """(backend, statistic) -> backend, lo, hi: as many numbers a backend as resamples."""
    lo, hi = ends(resamples, alpha)
    held = found.groupBy("backend").agg(F.sort_array(F.collect_list("statistic")).alias("s"))
    return held.select("backend", F.get("s", F.lit(lo)).alias("lo"), F.get("s", F.lit(hi)).alias("hi"))


def bootstrap_kappa(items: DataFrame, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(backend, truth, predicted) of two labels -> backend, lo, hi: from the drawn numbers of the confusion table's four cells alone."""
    label = F.least("truth", "predicted")
    labels = items.groupBy("backend").agg(F.min(label).alias("label"))
    rows = resampled(items, ["truth", "predicted"], resamples, seed).join(labels, "backend")

    def count(of: str) -> Column:
        return F.expr(f"aggregate(zip_with(known, drawn, (v, c) -> if({of}, c, 0L)), 0L, (s, c) -> s + c)")

    rows = rows.select("backend", "n", count("v.truth = label").alias("t"), count("v.predicted = label").alias("p"), count("v.truth = v.predicted").alias("same"))
    n = F.col("n")
    expected = (F.col("t") * F.col("p") + (n - F.col("t")) * (n - F.col("p"))) / (n * n)
    return _ends_of(rows.select("backend", kappa_of(F.col("same") / n, expected).alias("statistic")), resamples, alpha)


def _interval(found: list[float], resamples: int, alpha: float) -> tuple[float, float]:
    lo, hi = ends(resamples, alpha)
    found = sorted(found)
    return found[lo], found[hi]


def bootstrap_ci(items: DataFrame, values: list[str], statistic: Statistic = kappa_statistic, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Any statistic of the columns `values` -> backend, lo, hi; the cost grows with the number of distinct values, not with that of the items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, drawn = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [statistic([tuple(v.values()) for v in k], np.array(d)) for k, d in zip(known, drawn, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["backend", "statistic"])

    rows = resampled(items, values, resamples, seed).select("backend", "known", "drawn")
    return _ends_of(rows.mapInArrow(each, "backend string, statistic double"), resamples, alpha)


def _below(n: int, seed: int, block: int = 1 << 20):
    """The numbers that random.Random(seed).randrange(n) gives, in arrays: the first bits of its 32-bit words, those of n or more left out."""
    words = np.random.MT19937()
    *key, pos = random.Random(seed).getstate()[1]
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
    while True:
        drawn = words.random_raw(block) >> np.uint64(32 - n.bit_length())
        yield drawn[drawn < n].astype(np.int64)


def bootstrap_exact(items: DataFrame, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED, statistic: Statistic = kappa_statistic) -> DataFrame:
    """The same with the draw sequence of a seeded Mersenne Twister over the items in order of `pos`.

    The sequence makes it one task per backend, which holds a small number for each item
    (fewer than 2^32) and counts draws in blocks.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        code, known = pd.factorize(pd.MultiIndex.from_frame(rows[["truth", "predicted"]]))
        n, values = len(code), list(known)
        counts, at = np.zeros(resamples * len(values), np.int64), 0
        for drawn in _below(n, seed):
            drawn = drawn[: resamples * n - at]
            cell = (at + np.arange(drawn.size)) // n * len(values) + code[drawn]
            first = int(cell.min(initial=0)) if drawn.size else 0
            counts[first : first + int(cell.max(initial=0)) - first + 1] += np.bincount(cell - first, minlength=1) if drawn.size else 0
            at += drawn.size
            if at == resamples * n:
                break
        lo, hi = _interval([statistic(values, c) for c in counts.reshape(resamples, -1)], resamples, alpha)
        return pd.DataFrame({"backend": [rows["backend"].iloc[0]], "lo": [lo], "hi": [hi]})

    return items.groupBy("backend").applyInPandas(one, "backend string, lo double, hi double")


def tiers(scores: DataFrame) -> DataFrame:
    """(backend, kappa, lo, hi) -> the same with `tier`, best first.

    Components of overlapping closed intervals are islands in order of `lo`; tiers
    are ordered by their best kappa. One row per backend goes through the window.
    """
    order = Window.orderBy("lo", "hi", "backend")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = scores.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(order))
    best = islands.withColumn("_best", F.max("kappa").over(Window.partitionBy("_island")))
    return best.withColumn("tier", F.dense_rank().over(Window.orderBy(F.col("_best").desc(), "_island")).cast("long")).drop("_new", "_island", "_best")


def tiers_theta(scores: DataFrame) -> DataFrame:
    """Overlapping pairs of backends, of which `tiers` needs none."""
    return overlapping(scores)
