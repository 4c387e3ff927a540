"""Analytics that need no ground truth, all on one tally."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AXES, REASONS
from .ranking import id_ranges, placed, ranges
from .tally import tally

#: Parts of the pairs; 64 pairs of a part share a word of bits, and a billion pairs sort in parts of some 250,000.
PARTS = 1 << 12


def _packed(tallied: DataFrame, axis: str, tasks: int | None = None) -> DataFrame:
    """(left, right) of two backends for each 64 pairs, in both orders: backend and `bits`, a long per value with a bit for each pair so ruled.

    Pairs are numbered within their part, so that one shuffle by part numbers them, packs
    them and brings backends together; no pair meets another backend's row by itself.
    `tasks` is the number of tasks for that; without it, the session's shuffles say it.
    A missing ruling has no bit: two missing rulings must never meet as agreement.
    """
    s = tallied.where(F.col(axis).isNotNull() & F.col("pair_id").isNotNull() & F.col("backend").isNotNull())
    s = s.select("backend", F.col(axis).alias("v"), "pair_id", F.pmod(F.xxhash64("pair_id"), F.lit(PARTS)).alias("part"))
    if tasks and tasks > 1:
        s = s.repartition(tasks, "part")
    nth = F.dense_rank().over(Window.partitionBy("part").orderBy("pair_id")) - 1
    bit = F.expr("shiftleft(1L, n % 64)")
    bits = F.array(*[F.coalesce(F.bit_or(F.when(F.col("v") == v, bit)), F.lit(0).cast("long")) for v in AXES[axis]])
    packed = s.withColumn("n", nth).groupBy("part", F.floor(F.col("n") / 64).alias("word"), "backend").agg(bits.alias("bits"))
    together = packed.groupBy("part", "word").agg(F.collect_list(F.struct("backend", "bits")).alias("all"))  # a roster at most
    return together.select("all", F.explode("all").alias("left")).select("left", F.explode("all").alias("right"))


def _both(a: int, b: int) -> Column:
    """Pairs for which the left backend ruled value number a and the right one value number b."""
    return F.bit_count(F.get("left.bits", F.lit(a)).bitwiseAND(F.get("right.bits", F.lit(b))))


def agreement_matrix(tallied: DataFrame, roster: DataFrame, axis: str = "verdict", tasks: int | None = None) -> DataFrame:
    """Share of equal rulings for every ordered pair of backends; null where no pair is settled in both.

    Rulings are packed, 64 pairs to a word, and counted by AND: the tally is shuffled
    once, and what two backends share is summed up before it moves. The grid is roster
    by roster.
    """
    n = len(AXES[axis])
    equal = sum((_both(k, k) for k in range(n)), F.lit(0))
    settled = [reduce(lambda x, y: x.bitwiseOR(y), [F.get(f"{side}.bits", F.lit(k)) for k in range(n)]) for side in ("left", "right")]
    words = _packed(tallied, axis, tasks).select(F.col("left.backend").alias("backend"), F.col("right.backend").alias("other"), F.bit_count(settled[0].bitwiseAND(settled[1])).alias("shared"), equal.alias("equal"))
    found = words.groupBy("backend", "other").agg(F.sum("shared").alias("shared"), F.sum("equal").alias("equal")).where("shared > 0")
    grid = roster.crossJoin(roster.select(F.col("backend").alias("other")))
    return grid.join(found, ["backend", "other"], "left").select("backend", "other", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"), (F.col("equal") / F.col("shared")).alias("agreement"))


def reason_distribution(tallied: DataFrame) -> DataFrame:
    return tallied.where("reason is not null").groupBy("backend", "reason").agg(F.count("*").alias("pairs"))


def reason_cross_tab(tallied: DataFrame, tasks: int | None = None) -> DataFrame:
    """Settled reasons of two backends on the same pair, each two backends once; packed as in `agreement_matrix`."""
    both = {(x, y): _both(i, j) for i, x in enumerate(REASONS) for j, y in enumerate(REASONS)}
    words = _packed(tallied, "reason", tasks).where("left.backend < right.backend").select(F.col("left.backend").alias("left"), F.col("right.backend").alias("right"), *[n.alias(f"{x} {y}") for (x, y), n in both.items()])
    summed = words.groupBy("left", "right").agg(*[F.sum(f"{x} {y}").alias(f"{x} {y}") for x, y in both])
    cells = F.array(*[F.struct(F.lit(x).alias("left_reason"), F.lit(y).alias("right_reason"), F.col(f"{x} {y}").alias("pairs")) for x, y in both])
    return summed.select("left", "right", F.inline(cells)).where("pairs > 0")


def contention(tallied: DataFrame) -> DataFrame:
    """Per pair over all backends: disagreement between settled rulings, mean flips, unsettled backends, score."""
    across = {}
    for axis, domain in AXES.items():
        counts = [F.count_if(F.col(axis) == v) for v in domain]
        across[axis] = (F.greatest(*counts), F.count(axis))
    by = tallied.groupBy("pair_id").agg(
        F.count("*").alias("n_models"),
        F.count_if(F.col("verdict").isNull() | F.col("reason").isNull()).alias("n_unsettled"),
        *[F.coalesce(1 - top / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(f"x_{axis}") for axis, (top, n) in across.items()],
        F.avg("verdict_flip_rate").alias("mean_verdict_flip"),
        F.avg("reason_flip_rate").alias("mean_reason_flip"),
    )
    score = 2 * F.col("x_verdict") + F.col("x_reason") + F.col("mean_verdict_flip") + 0.5 * F.col("mean_reason_flip") + 2 * F.col("n_unsettled") / F.col("n_models")
    return by.withColumn("contention", score)


def contention_top(tallied: DataFrame, k: int = 40) -> DataFrame:
    """The k most contested pairs: a top-k, not a sort of everything. Scores are rounded so that rounding cannot reorder ties."""
    ranked = contention(tallied).withColumn("contention", F.round("contention", 6)).where("contention > 0")
    return ranked.orderBy(F.col("contention").desc(), "pair_id").limit(k)


def pooled_flips(votes: DataFrame) -> DataFrame:
    """Per pair over all backends and votes: counts by value, models, rulings, flip rate."""
    t = tally(votes, ("pair_id",))
    models = votes.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("models"))
    return t.join(models, "pair_id")


def operator_queue(pairs: DataFrame, flips: DataFrame) -> DataFrame:
    """Rows in the order a person should see them, as a rank column: judged first, undecided before decided, most flips, file order."""
    undecided = (F.col("verdict").isNull() | F.col("reason").isNull()).cast("int")
    rows = pairs.select(F.col("id").alias("pair_id"), "pos").join(flips.select("pair_id", "n_votes", F.round("verdict_flip_rate", 9).alias("flip"), undecided.alias("undecided")), "pair_id", "left")
    rows = rows.select("pair_id", "pos", F.col("n_votes").isNull().cast("int").alias("unjudged"), F.coalesce("undecided", F.lit(0)).alias("undecided"), F.coalesce("flip", F.lit(0.0)).alias("flip"))
    rows = placed(rows.withColumn("range", ranges("pos")), [("unjudged", False), ("undecided", True), ("flip", True), ("range", False)], ["pos"])
    return rows.select("pair_id", "place", "undecided", "flip")


def deadlocks(tallied: DataFrame, leg: str) -> DataFrame:
    """Ties of two votes or more, per axis, with the split as text in value order."""
    parts = []
    for place, (axis, domain) in enumerate(AXES.items()):
        shown = [F.when(F.col(f"n_{axis}_{v}") > 0, F.concat_ws("=", F.lit(v), F.col(f"n_{axis}_{v}").cast("string"))) for v in sorted(domain)]
        parts.append(
            tallied.where((F.col("n_votes") >= 2) & F.col(axis).isNull()).select(F.lit(leg).alias("leg"), "backend", "pair_id", F.lit(place).alias("axis_order"), F.lit(axis).alias("kind"), "n_votes", F.array_join(F.array_compact(F.array(*shown)), ",").alias("split"))
        )
    return parts[0].union(parts[1])


def unsettled_reason_pairs(tallied: DataFrame) -> DataFrame:
    """Pairs without a settled reason, a row each: the number of votes that could not settle it, its place among the backend's by id, and their number n."""
    rows = tallied.where("reason is null").select("backend", "pair_id", "n_votes")
    return placed(rows.withColumn("range", id_ranges("pair_id")), [("range", False)], ["pair_id"], keys=("backend",), total="n").select("backend", "pair_id", "n_votes", "place", "n")


def cache_hits(votes: DataFrame) -> DataFrame:
    """Calls of each backend: those that say whether they hit the cache, those that hit, all."""
    return votes.groupBy("backend").agg(F.count("cached_tokens").alias("measuring"), F.count_if(F.col("cached_tokens") > 0).alias("hits"), F.count("*").alias("total_calls"))


def cache_findings(votes: DataFrame, tallied: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Whether repeated votes look like one cached answer; flips count over pairs voted more than once. `calls`: `cache_hits` of the votes, if it is there already."""
    rep = F.col("n_votes") >= 2
    by = tallied.groupBy("backend").agg(
        F.max("n_votes").alias("max_votes"),
        F.count_if(rep).alias("repeated_pairs"),
        F.coalesce(F.avg(F.when(rep, F.col("verdict_flip_rate"))), F.lit(0.0)).alias("verdict_flip"),
        F.coalesce(F.avg(F.when(rep, F.col("reason_flip_rate"))), F.lit(0.0)).alias("reason_flip"),
    )
    calls = cache_hits(votes) if calls is None else calls
    flat = (F.col("verdict_flip") == 0) & (F.col("reason_flip") == 0)
    status = F.when((F.col("repeated_pairs") == 0) | ~flat, "ok").when(F.col("measuring") == 0, "unverifiable").when(F.col("hits") > 0, "collapse_suspected").otherwise("ok")
    return by.join(calls, "backend").withColumn("status", status)
