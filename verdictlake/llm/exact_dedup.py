"""Exact deduplication with counting quotient filters.

Each partition folds the 64-bit fingerprints of its texts into counting quotient
filters, one for each block of the fingerprint space. Filters of a block merge
without loss, by their sorted remainders, into the corpus-wide filter. Only
fingerprints that it counts more than once are looked at again: their texts are
compared byte for byte (grouped by the text itself), which settles collisions.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null doc_id is never the row that stays unless its whole group has
none; rows that repeat both doc_id and text count in group_size and share their
flags; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_keys, in_arrow, save, text_or_empty, whole_rows

#: Blocks are 2^bits: more of them for larger inputs, so that one block's filters fit into a task's memory.
LEAST_BITS, MOST_BITS, BYTES_A_BLOCK = 10, 16, 1 << 27


def block_bits_for(df: DataFrame) -> int:
    """From the optimizer's estimate of the input's size, which costs no job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 62  # rows that are in memory only have no estimate
    return min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_BLOCK).bit_length() if known else 0))


class CountingQuotientFilter:
    """Multiset of fingerprints of one block: run lengths by quotient, then remainders and counts.

    A fingerprint of `bits` bits is split into a quotient (high `q` bits) and a
    remainder. Remainders of a quotient form a sorted run; a count goes with each.
    """

    def __init__(self, bits: int, q: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.q, self.runs, self.remainders, self.counts = bits, q, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """fingerprints: sorted, distinct."""
        q = max(1, min(bits - 1, int(fingerprints.size).bit_length()))
        shift = np.uint64(bits - q)
        runs = np.bincount((fingerprints >> shift).astype(np.int64), minlength=1 << q).astype("<u4")
        remainders = fingerprints & ((np.uint64(1) << shift) - np.uint64(1))
        return cls(bits, q, runs, remainders.astype("<u8"), counts.astype("<u8"))

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(1 << self.q, dtype=np.uint64), self.runs)
        return (quotients << np.uint64(self.bits - self.q)) | self.remainders

    def dump(self) -> bytes:
        head = np.array([self.bits, self.q, self.remainders.size], "<u8")
        more = np.flatnonzero(self.counts > 1).astype("<u4")  # most counts are 1
        return b"".join(x.tobytes() for x in (head, self.runs, self.remainders, more, self.counts[more]))

    @classmethod
    def load(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, n = (int(x) for x in np.frombuffer(raw, "<u8", 3))
        at = 24
        runs = np.frombuffer(raw, "<u4", 1 << q, at)
        at += runs.nbytes
        remainders = np.frombuffer(raw, "<u8", n, at)
        at += remainders.nbytes
        k = (len(raw) - at) // 12
        counts = np.ones(n, "<u8")
        counts[np.frombuffer(raw, "<u4", k, at)] = np.frombuffer(raw, "<u8", k, at + 4 * k)
        return cls(bits, q, runs, remainders, counts)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: runs are merged in order, counts of equal remainders add up."""
        if len(filters) == 1:
            return filters[0]
        fps = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(fps, kind="stable")
        fps, counts = fps[order], counts[order]
        first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]]) if fps.size else np.zeros(0, np.int64)
        return cls.of(fps[first], np.add.reduceat(counts, first) if fps.size else counts, filters[0].bits)


def _build(block_bits: int, flush_at: int = 1 << 22):
    bits = 64 - block_bits

    def filters(held: list[np.ndarray]) -> pa.RecordBatch:
        fps, counts = np.unique(np.concatenate(held), return_counts=True)
        block = (fps >> np.uint64(bits)).astype(np.int64)
        low = fps & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))
        edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), fps.size]
        raw = [CountingQuotientFilter.of(low[a:b], counts[a:b], bits).dump() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]].astype(np.int32)), pa.array(raw, pa.binary())], ["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
            if n >= flush_at:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    return run


def _merge(block_bits: int, least: int):
    bits = 64 - block_bits

    def counted(block: int, raw: list[bytes]) -> pa.RecordBatch:
        f = CountingQuotientFilter.merge([CountingQuotientFilter.load(x) for x in raw])
        keep = f.counts >= least
        fps = (f.fingerprints()[keep] | np.uint64(block) << np.uint64(bits)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.array(f.counts[keep].astype(np.int64))], ["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raw = None, []
        for batch in batches:  # sorted by block
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at and raw:
                    yield counted(at, raw)
                    raw = []
                at = block
                raw.append(x)
        if raw:
            yield counted(at, raw)

    return run


def repeated_fingerprints(fps: DataFrame, block_bits: int | None = None, least: int = 2) -> DataFrame:
    """`fps` (one column, long) -> (fp, n) of the fingerprints that the merged filter counts `least` times or more."""
    block_bits = block_bits or block_bits_for(fps)
    parts = in_arrow(fps, _build(block_bits), "block int, filter binary")
    return in_arrow(parts.repartition("block").sortWithinPartitions("block"), _merge(block_bits, least), "fp long, n long")


def exact_dedup(docs: DataFrame, block_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    d = docs.select("doc_id", text_or_empty().alias("text")).withColumn("fp", F.xxhash64("text"))
    repeated = save(repeated_fingerprints(d.select("fp"), block_bits).select("fp"), "dedup-repeated")
    # byte verification: texts of these fingerprints meet as grouping keys, summed up before the shuffle
    same = (
        d.join(repeated, "fp", "left_semi")
        .groupBy("fp", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2(F.col("text"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    same = save(same, "dedup-groups")
    rows = d.select("doc_id", "fp", F.sha2(F.col("text"), 256).alias("text_sha256"))
    out = rows.join(same, ["fp", "text_sha256"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat a kept doc_id and text, one stays."""
    keys = ["id", "none", "sha"]
    kept = exact_dedup(docs).where("kept").select(*id_keys(), F.col("text_sha256").alias("sha"))
    return whole_rows(docs, sha=F.sha2(text_or_empty(), 256)).join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
