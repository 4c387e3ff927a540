"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule holds the point frac(i * golden ratio), mapped through the
cumulative targets to a source. The r-th slot of a source takes the r-th block of
that source's documents, which stand in a fixed shuffled order and are cut into
blocks of equal numbers of words (to one word); after the last block its first one
follows. What the mix takes of a document is the sum over the blocks that it has
words in.

The size of the blocks follows from the whole mix, not from its smallest source: a
source of less than one block is a block of its own. A source takes exactly its
target, to the nearest word: of its last block only what is missing is taken, slots
beyond that are left out, and where the points gave a source too few slots (or
none), the missing ones are put where they fall in an even spread.

No source is dealt to one task: documents meet by (source, range of the shuffle
hash), and only the ranges' sums are ordered by source.

Defined results: null or empty texts have size 0 and nothing is taken of them; a
null source is a source of its own, after the others; rows that repeat a doc_id
are ordered by their size; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, id_keys, in_arrow, save, whole_rows

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Slots of a mix, about, unless its blocks would be longer than MAX_BLOCK words.
SLOTS = 16_384
MAX_BLOCK = 4096
#: Slots that one task numbers.
SLOT_RANGE = 4096
#: Documents in a range of the shuffle order, about; at least 64 ranges.
RANGE_ROWS = 50_000


def n_words(col: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(NOT_SPACE), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size) rows -> one row per source with its words, weight, target.

    Targets are min(cap * words, level * weight). The level follows from the order
    in which sources reach their cap: the first one at which all later sources
    stay at or below theirs.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * cap)
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    by = by.withColumns({"total": F.sum("source_size").over(whole), "full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    by = by.withColumn("level", (F.col("total") * F.lit(share) - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return by.select("source", "source_size", "weight", "rank", target.alias("target"))


def _points(edges: list[float]):
    """Slot numbers -> the rank of the source whose stretch of the cumulative weights holds the slot's point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False)
            point = slot * GOLDEN
            rank = np.searchsorted(np.array(edges), point - np.floor(point), side="right") + 1
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(rank.astype(np.int32))], ["slot", "rank"])

    return run


def schedule(targets: DataFrame, slots: int = SLOTS, max_block: int = MAX_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(slot, rank) rows in slot order, and `targets` with: due (words to take), parts (blocks of a pass), n_slots (of the schedule).

    What is gathered is one row per source, not data of the documents.
    """
    spark = targets.sparkSession
    rows = targets.orderBy("rank").select("rank", "target").collect()
    total = sum(r["target"] for r in rows)
    block = int(max(1, min(max_block, total // slots)))
    edges, at = [], 0.0
    for r in rows:
        at += r["target"] / total if total else 0
        edges.append(at)
    n_slots = round(total / block)
    points = in_arrow(spark.range(n_slots), _points([float(e) for e in edges[:-1]]), "slot long, rank int")
    parts = F.greatest(F.lit(1), F.round(F.col("source_size") / F.lit(block))).cast("long")
    return points, targets.withColumns({"due": F.round("target").cast("long"), "parts": parts, "n_slots": F.lit(n_slots).cast("long")})


def _begin(part: Column) -> Column:
    """Words of the source before a part; the first source_size % parts of them have one word more."""
    size, parts = F.col("source_size"), F.col("parts")
    return part * F.floor(size / parts).cast("long") + F.least(part, size % parts)


def _part_of(word: Column) -> Column:
    size, parts = F.col("source_size"), F.col("parts")
    short, longer = F.greatest(F.lit(1).cast("long"), F.floor(size / parts).cast("long")), size % parts
    edge = longer * (short + 1)
    return F.when(word < edge, F.floor(word / (short + 1))).otherwise(longer + F.floor((word - edge) / short)).cast("long")


def drawn_blocks(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """(slot, rank, turn, part, words, whole): the turn-th slot of a source draws that many words of its part-th block; parts repeat after the last.

    Slots are numbered within source and range of slots, and the ranges' sizes added
    up before, so that no source goes through one task.
    """
    s = slots.withColumn("span", F.floor(F.col("slot") / SLOT_RANGE))
    sizes = s.groupBy("rank", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("rank", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("rank", "span").orderBy("slot")) - 1
    turns = s.withColumn("own", own).join(starts, ["rank", "span"]).select("slot", "rank", (F.col("before") + F.col("own")).alias("turn"))
    of = targets.select("rank", "source_size", "due", "parts", "n_slots")
    turns = turns.join(of, "rank")
    needed = F.ceil(F.col("due") * F.col("parts") / F.greatest(F.lit(1), F.col("source_size"))).cast("long")
    short = of.join(sizes.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "needed": needed}).where("needed > n")
    more = short.withColumn("turn", F.explode(F.sequence("n", F.col("needed") - 1)))
    more = more.withColumn("slot", F.floor((F.col("turn") + 0.5) * F.col("n_slots") / F.col("needed")).cast("long"))
    turns = turns.unionByName(more.select(*turns.columns))
    turns = turns.withColumn("part", F.col("turn") % F.col("parts"))
    size = _begin(F.col("part") + 1) - _begin(F.col("part"))
    left = F.col("due") - F.floor(F.col("turn") / F.col("parts")).cast("long") * F.col("source_size") - _begin(F.col("part"))
    return turns.withColumns({"words": F.least(size, left), "whole": left >= size}).where("words > 0").select("slot", "rank", "turn", "part", "words", "whole")


def placed_documents(docs: DataFrame, range_rows: int = RANGE_ROWS, **how) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's figures and their place in its shuffled order, and the drawn blocks."""
    d = docs.select("doc_id", "source", n_words().alias("size"))
    d = d.withColumn("order", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long"))
    d = save(d, "mix-sizes")
    d = d.withColumn("range", F.col("order") % F.lit(max(64, d.count() // range_rows)))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = save(source_targets(sums.select("source", F.col("words").alias("size"))), "mix-targets")
    slots, targets = schedule(targets, **how)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets.drop("weight"), starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    starts = starts.select(F.col("source").alias("_s"), F.col("range").alias("_r"), "start", "rank", "source_size", "target", "parts")
    within = Window.partitionBy("source", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = placed.join(starts, placed["source"].eqNullSafe(F.col("_s")) & (placed["range"] == F.col("_r")))
    return out.select("doc_id", "rank", "size", "source_size", "target", "parts", (F.col("start") + F.col("at")).alias("at")), drawn_blocks(slots, targets)


def _in_blocks(placed: DataFrame) -> DataFrame:
    """A row for each block that a document has words in: from which word on, how many, and where in the block."""
    last = F.col("at") + F.col("size")
    rows = placed.where("size > 0").withColumn("part", F.explode(F.sequence(_part_of(F.col("at")), _part_of(last - 1))))
    begin, end = F.greatest("at", _begin(F.col("part"))), F.least(last, _begin(F.col("part") + 1))
    return rows.withColumns({"from_word": begin - F.col("at"), "words": end - begin, "place": begin - _begin(F.col("part"))})


def mix(docs: DataFrame, range_rows: int = RANGE_ROWS, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    placed, drawn = placed_documents(docs, range_rows, **how)
    times = drawn.groupBy("rank", "part").agg(F.count_if("whole").alias("times"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("cut"))
    keys = ["doc_id", "rank", "size", "source_size", "target", "at"]  # places differ within a source
    words = F.col("words") * F.col("times") + F.greatest(F.lit(0), F.least("words", F.col("cut") - F.col("place")))
    taken = _in_blocks(placed).join(times, ["rank", "part"], "left").groupBy(*keys).agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"))
    empty = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


def training_order(docs: DataFrame, range_rows: int = RANGE_ROWS, **how) -> DataFrame:
    """The mix slot by slot: slot, rank (of the source), doc_id, from_word, words, place within the slot's block."""
    placed, drawn = placed_documents(docs, range_rows, **how)
    parts = _in_blocks(placed).select("rank", "part", "doc_id", "from_word", F.col("words").alias("held"), "place")
    rows = drawn.join(parts, ["rank", "part"]).where("place < words")
    return rows.select("slot", "rank", "doc_id", "from_word", F.least("held", F.col("words") - F.col("place")).alias("words"), "place")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, all columns, whole texts: each as often as it is taken, to the nearest whole number.

    Only documents at the end of a source's last block are taken in part; empty
    texts, of which nothing can be taken, stay once.
    """
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    took = mix(docs, **how).select(*id_keys(), times.alias("times")).groupBy("id", "none").agg(F.max("times").alias("times"))
    out = whole_rows(docs).join(took.where("times > 0"), ["id", "none"])
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
