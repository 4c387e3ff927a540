"""SimHash near-duplicates with covering locality-sensitive hashing.

For radius r every bit position gets a vector m(i) of r + 1 bits, and each of the
2^(r+1) - 1 nonzero vectors v keeps the bits whose inner product with v is 1.
Any r positions span at most r dimensions, so some v is orthogonal to all of them:
two fingerprints that differ in at most r bits agree on all the bits that this v
keeps, whatever the positions. No pair within the radius is missed in all tables.

Buckets are summed up (count, least, largest) before anything is gathered:
buckets of two are decided by these alone. The members of larger ones, up to
`dense`, meet in one place and give a spanning forest, not all pairs. Fingerprints
of still larger buckets are linked through the points within r / 2 bits of them
instead, at a fixed number of points each: two fingerprints are within r exactly
if they share such a point, so the first at a point stands for all of them. A pair
with one end outside the large buckets shares a bucket that is not large.

Defined results: a null or wordless text has fingerprint 0 and is linked like any
other; fewer than four words are one shingle; rows that repeat a doc_id share the
class of all their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_keys, in_arrow, save, whole_rows
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Members of a bucket that are compared in one place; beyond it, points are used.
DENSE = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """Majority of the bits of all shingles' hashes; unsigned."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + 4096)].tolist(), last[at : at + 4096].tolist())], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprints, "doc_id long, fp long")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Signed masks, one for each nonzero v. m(i) deals positions evenly over the nonzero vectors."""
    dims = radius + 1
    vectors = [i % ((1 << dims) - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, 1 << dims)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def _tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(k).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    return fps.select("fp", F.inline(keys).alias("t", "key"))


def _forest(radius: int):
    """Sorted (t, key, fp) rows -> edges that link what is within the radius in each bucket."""

    def edges(fps: list[int]) -> list[tuple[int, int]]:
        x = np.unique(np.array(fps, np.int64)).view(np.uint64)
        left, out = np.arange(x.size), []
        while left.size:  # grow a tree from the first one left; each member is compared once with those still left
            queue, left = [left[0]], left[1:]
            while queue and left.size:
                i = queue.pop()
                near = np.bitwise_count(x[left] ^ x[i]) <= radius
                found, left = left[near], left[~near]
                out += [(int(x[i].view(np.int64)), int(y)) for y in x[found].view(np.int64)]
                queue += found.tolist()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, out = None, [], []
        for batch in batches:
            for t, key, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (t, key) != at and fps:
                    out += edges(fps)
                    fps = []
                at = (t, key)
                fps.append(fp)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        out += edges(fps) if fps else []
        if out:
            yield _pairs(out)

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _points(fps: DataFrame, radius: int) -> DataFrame:
    """Every point within half the radius, of one bit or two: a fixed number for each fingerprint."""
    one = lambda c: F.expr(f"shiftleft(1L, {c})")
    places = F.sequence(F.lit(0), F.lit(BITS - 1))
    out = fps.select("fp", F.explode(places).alias("i"))
    if radius == 2:
        flipped = out.select("fp", F.col("fp").bitwiseXOR(one("i")).alias("point"))
    elif radius == 4:  # i = j flips one bit
        out = out.select("fp", "i", F.explode(F.sequence(F.col("i"), F.lit(BITS - 1))).alias("j"))
        flipped = out.select("fp", F.col("fp").bitwiseXOR(one("i").bitwiseOR(one("j"))).alias("point"))
    else:
        raise ValueError("points are made for radius 2 and 4")
    return flipped.union(fps.select("fp", F.col("fp").alias("point")))


def _near_points(fps: DataFrame, radius: int) -> DataFrame:
    """Links through shared points within half the radius: (fp, least fp at that point)."""
    points = _points(fps, radius)
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    return points.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_edges(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Distinct fingerprints -> edges whose components are those of all links within the radius."""
    masks = covering_masks(BITS, radius)
    rows = _tables(fps, masks)
    # of fingerprints in a bucket of two, only those are linked that are near
    buckets = save(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "lsh-buckets")
    twos = buckets.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    more = buckets.where(f"n > 2 and n <= {dense}").select("t", "key")
    met = rows.select("t", "key", "fp").join(more, ["t", "key"], "left_semi")
    some = in_arrow(met.repartition("t", "key").sortWithinPartitions("t", "key"), _forest(radius), "u long, v long")
    found = twos.union(some)
    if buckets.where(f"n > {dense}").limit(1).count():
        large = rows.join(buckets.where(f"n > {dense}").select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
        found = found.union(_near_points(save(large, "lsh-large"), radius))
    return found


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_classes(docs: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, fp."""
    rows = save(fingerprints(docs), "simhash")
    distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_edges(distinct.select("fp"), radius, dense))
    members = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = save(members.join(classes, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(of_fp, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id", "fp")


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, of which each class keeps the document with its least doc_id."""
    keys = ["id", "none"]
    keep = near_classes(docs, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*id_keys())
    return whole_rows(docs).join(keep, keys, "left_semi").dropDuplicates(keys).select("row.*")
