"""Hard negatives by k-means inverted lists, exact by a bound on each list.

All vectors are put into lists: by nearest centroid and by label (modulo LABELS), with
the list's centroid and its radius, the largest distance from it. By Cauchy-Schwarz no
member of a list scores above q.c + |q| r or below q.c - |q| r against an anchor q. An
anchor visits the lists of highest bound first and keeps its best k; after that it
visits the others, except those whose bound is strictly below its kth score, or which
lie outside the window of scores asked for. So the result is that of comparing with
every row, whatever the centroids; they decide only how many lists are visited.

Anchors go to lists in blocks: a list, cut into parts of bounded size, is read once and
held as a matrix while the anchors that visit it stream by, each with its window.

The centroids are fitted on the SAMPLE rows that come first by a hash of vec_id; every
row is indexed. Centroids, radii and counts are at most MOST_LISTS x LABELS rows, which
is what each task gets.

Defined results: rows with a null vec_id, a null label, a null vector, or a null or
non-finite component take no part, nor do those with a component of 2^19 or more in
magnitude, whose scores might not fit a long; a shorter vector counts as filled up with
zeros; of rows that repeat a vec_id the one with the least label, then vector, counts;
an empty vector scores 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, save

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 4, 5  # a negative scores between LOW / HIGH of the positive's score and all of it
ANCHORS, RELABELLED, CLASSES, SCALE = 100, 7, 10, 256
#: Rows that the centroids are fitted on, rows a centroid is to stand for, most centroids, rounds of fitting, label groups.
SAMPLE, A_CENTROID, MOST_LISTS, ROUNDS, LABELS = 16_384, 64, 256, 8, 16
#: Rows of a list held as one matrix, anchors that travel together, and lists that an anchor visits before it has a kth score.
PART, BLOCK, FIRST = 4096, 128, 4
LARGEST = 1 << 19
_EXACT = 1 << 53


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, relabelled, with whole components."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False)))
    e = e.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    e = e.withColumn("label", F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")))
    e = e.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")))
    return e.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


@dataclass
class Lists:
    """Centroids (a matrix), and of each list its centroid, label group, rows, parts and radius."""

    centroids: np.ndarray
    centroid: np.ndarray
    group: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each list against each anchor, with room for rounding."""
        to = (q @ self.centroids.T)[:, self.centroid]
        reach = np.linalg.norm(q, axis=1)[:, None] * self.radius[None, :]
        room = 1e-9 * (np.abs(to) + reach) + 1e-3
        return to - reach - room, to + reach + room


def _matrix(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: v.size] = v
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def fit(sample: np.ndarray, most: int = MOST_LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds, begun with rows spread evenly over it."""
    k = max(1, min(most, sample.shape[0] // A_CENTROID))
    centroids = sample[np.linspace(0, sample.shape[0] - 1, k).astype(int)]
    for _ in range(rounds):
        near = _nearest(sample, centroids)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None, :] - 2 * (x @ centroids.T), axis=1)


def _assign(centroids: np.ndarray):
    dim = centroids.shape[1]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                part = batch.slice(a, PART)
                x = _matrix(_vectors(part.column(2)), dim)
                near = _nearest(x, centroids)
                far = np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))
                group = np.mod(part.column(1).to_numpy(), LABELS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((near * LABELS + group).astype(np.int32)), pa.array(far), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())], ["vec_id", "label", "list", "far", "v"])

    return go


def index(rows: DataFrame, sample: int = SAMPLE, most: int = MOST_LISTS, part: int = PART) -> tuple[DataFrame, Lists | None]:
    """All rows with their list and part, (vec_id, label, list, part, v), and what is known of the lists."""
    rows = save(rows, "lists-rows")
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return rows, None
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    centroids = fit(_matrix(_vectors(chosen), max(1, dim)), most)
    put = save(in_arrow(rows, _assign(centroids), "vec_id long, label long, list int, far double, v binary"), "lists-put")
    stats = sorted(put.groupBy("list").agg(F.count("*"), F.max("far")).collect())  # at most most x LABELS rows
    of, counts, radius = (np.array(c) for c in zip(*stats, strict=True))
    known = np.zeros(centroids.shape[0] * LABELS, np.int64)
    known[of] = -(-counts // part)
    lists = Lists(centroids, np.arange(known.size) // LABELS, np.arange(known.size) % LABELS, np.zeros(known.size), known)
    lists.radius[of] = radius
    parts = F.element_at(F.lit(np.maximum(known, 1).tolist()), F.col("list") + 1)
    return put.select("vec_id", "label", "list", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), "v"), lists


def _visits(lists: Lists, same: bool, first: int, again: bool):
    """Anchors (vec_id, label, v, window tops, least scores so far) -> (list, part, anchors) of the lists to visit.

    Without `again`, the `first` lists of highest bound; with it, all others that the least scores leave open.
    """

    def chosen(labels: np.ndarray, q: np.ndarray, tops: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = lists.bounds(q)
        fits = (lists.parts > 0)[None, :] & ((lists.group[None, :] == np.mod(labels, LABELS)[:, None]) if same else True)
        in_window = np.zeros_like(high, bool)
        still = np.zeros_like(high, bool)
        for i in range(tops.shape[1]):  # a list counts for an anchor if it does for one of its windows
            top = tops[:, i, None]
            inside = fits & (low <= top) & (HIGH * high >= LOW * top if not same else True)
            in_window |= inside & ~np.isnan(top)
            still |= inside & (high >= least[:, i, None])
        ranked = np.argsort(np.argsort(np.where(in_window, -high, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
        early = in_window & (ranked < first)
        return np.nonzero(still & ~early if again else early)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids, labels = (part.column(c).to_numpy() for c in (0, 1))
                q = np.stack([np.frombuffer(v, "<i4") for v in part.column(2).to_pylist()]).astype(float)
                width = max(part.column(3).value_lengths().to_pylist())
                tops, least = (np.array([r + [np.nan] * (width - len(r)) for r in part.column(c).to_pylist()]) for c in (3, 4))
                anchor, of = chosen(labels, q, tops, least)
                by_list = np.argsort(of, kind="stable")
                anchor, of = anchor[by_list], of[by_list]
                edges = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), of.size]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    who, copies = anchor[x:y], int(lists.parts[of[x]])
                    packed = [ids[who].astype("<i8"), labels[who].astype("<i8"), q[who].astype("<i4"), tops[who].astype("<f8")]
                    cols = [pa.array(np.full(copies, of[x], np.int32)), pa.array(np.arange(copies))] + [pa.array([c.tobytes()] * copies, pa.binary()) for c in packed]
                    yield pa.RecordBatch.from_arrays(cols, ["list", "part", "ids", "labels", "q", "tops"])

    return go


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id; ids are sorted."""
    at = np.arange(scores.size)
    if scores.size > k:
        at = np.flatnonzero(scores >= np.partition(scores, scores.size - k)[scores.size - k])
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where all sums stay below 2^53, else in longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < _EXACT else q.astype(np.int64) @ x.T.astype(np.int64)


def _scan(dim: int, same: bool, k: int):
    """A part's rows, then the anchors that visit it -> the k best of each anchor and window."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4)]
            q_column, tops_column = batch.column(5), batch.column(6)
            out: list[list] = [[] for _ in range(4)]
            for r, (of, part, visit, ids, labels) in enumerate(zip(*columns, strict=True)):
                if (of, part) != at:
                    at, held, ready = (of, part), [], None
                if not visit:
                    held.append((ids, labels, q_column[r].as_py()))
                    continue
                if ready is None:
                    own = np.array([np.frombuffer(i, "<i8")[0] for i, _, _ in held], np.int64)
                    order = np.argsort(own, kind="stable")
                    own_labels = np.array([np.frombuffer(x, "<i8")[0] for _, x, _ in held], np.int64)[order]
                    x = np.stack([np.frombuffer(v, "<i4") for _, _, v in held])[order] if held else np.zeros((0, dim), "<i4")
                    held, ready = [], (own[order], own_labels, x)
                own, own_labels, x = ready
                anchors, anchor_labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                scores = products(np.frombuffer(q_column[r].as_py(), "<i4").reshape(-1, dim), x)
                tops = np.frombuffer(tops_column[r].as_py(), "<f8").reshape(anchors.size, -1)
                for i in range(anchors.size):
                    fits = (own_labels == anchor_labels[i]) & (own != anchors[i]) if same else own_labels != anchor_labels[i]
                    for w in range(tops.shape[1]):
                        top = tops[i, w]
                        if np.isnan(top):
                            break
                        inside = np.flatnonzero(fits if same else fits & (scores[i] <= top) & (HIGH * scores[i] >= LOW * top))
                        best = inside[_best(scores[i, inside], own[inside], k)]
                        for c, v in zip(out, (np.full(best.size, anchors[i]), np.full(best.size, w, np.int32), scores[i, best], own[best]), strict=True):
                            c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor_id", "slot", "score", "vec_id"])

    return go


_FOUND = "anchor_id long, slot int, score long, vec_id long"


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot, ranked; each task leaves out the others before they are shuffled."""
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(rows: DataFrame, lists: Lists, anchors: DataFrame, same: bool, k: int, first: int) -> DataFrame:
    """`anchors` (vec_id, label, v, tops) -> (anchor_id, slot, score, vec_id, rank): the k best rows of each window."""
    dim = lists.centroids.shape[1]

    def scan(asked: DataFrame, again: bool) -> DataFrame:
        visits = in_arrow(asked, _visits(lists, same, first, again), "list int, part long, ids binary, labels binary, q binary, tops binary")
        own = in_arrow(rows, _packed, "list int, part long, visit int, ids binary, labels binary, q binary, tops binary")
        both = own.union(visits.select("list", "part", F.lit(1).alias("visit"), "ids", "labels", "q", "tops"))
        return in_arrow(both.repartition("list", "part").sortWithinPartitions("list", "part", "visit"), _scan(dim, same, k), _FOUND)

    none = F.transform("tops", lambda _: F.lit(float("-inf")))
    early = save(_top(scan(anchors.withColumn("least", none), False), k).drop("rank"), "lists-early")
    kth = early.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    kth = kth.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("low").cast("double")))).alias("kth"))  # POSITIVES slots at most
    asked = anchors.join(kth, "vec_id", "left").select(*anchors.columns, F.transform("tops", lambda _, i: F.coalesce(F.col("kth")[i], F.lit(float("-inf")))).alias("least"))
    return _top(early.union(scan(asked, True)), k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, list, part, v) in the form of visits."""
    for batch in batches:
        ids, labels = ([x.tobytes() for x in batch.column(c).to_numpy().astype("<i8")] for c in (0, 1))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(3), pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.binary()), pa.array(labels, pa.binary()), batch.column(4), pa.nulls(n, pa.binary())],
            ["list", "part", "visit", "ids", "labels", "q", "tops"],
        )


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, first: int = FIRST, sample: int = SAMPLE, most: int = MOST_LISTS, part: int = PART) -> DataFrame:
    """Of each anchor (vec_id divisible by ANCHORS) and each of its positives, the best negatives within the window.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows, lists = index(usable(embeddings), sample, most, part)
    if lists is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0).select("vec_id", "label", "v")
    near = save(_search(rows, lists, anchors.withColumn("tops", F.array(F.lit(float("inf")))), True, positives, first), "lists-positives")
    tops = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"].cast("double")).alias("tops"))
    found = _search(rows, lists, anchors.join(tops, "vec_id"), False, negatives, first)
    pairs = found.withColumn("place", F.col("slot") + 1).join(near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "place"])
    return pairs.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
