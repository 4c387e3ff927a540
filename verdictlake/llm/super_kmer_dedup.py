"""Removal of words that lie in a window of words which an earlier document has.

Super-k-mer partitioning: a window of `window` words has `window - mer + 1` runs of
`mer` words, and the least of their hashes is its minimiser. Equal windows have equal
minimisers, so a minimiser is the key by which windows meet; consecutive windows that
share one travel as one packed string (their words, each sent once) rather than as so
many windows; the strings of a stretch of the input that go to one bucket are compressed
together. In a bucket the windows are sorted, compared word by word, and each one's
least doc_id is found; the other documents' windows are repeats.

Minimisers with very many strings (a line or a passage that a third of all documents
have) are counted first and spread over salts, and a bucket that is too large is worked
off in pieces of bounded size. Windows that may lie in several salts or pieces stay open
there: only the first document's window of each goes on to one more aggregation, by the
window itself, which settles it exactly. So neither a bucket nor a salt has to fit in
memory, and no result depends on the bounds.

Defined results: a null text has no words; a null doc_id counts as larger than all
others, and nulls as equal; rows that repeat a doc_id are one document when they are
compared, whatever their texts; a window that only its own document repeats stays;
texts shorter than a window lose nothing; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, save, text_or_empty
from .exact_dedup import repeated_fingerprints
from .suffix_dedup import Hashes, _slide, mixed

WINDOW, MER = 13, 3
#: Bytes of text that are cut together, windows of a longer text cut at once, bytes of strings packed together, and most bytes sorted together.
CHUNK, PIECE, FLUSH, SORTED = 1 << 19, 1 << 16, 1 << 25, 1 << 23
#: Buckets are a power of two, by the size of the input as it is stored.
BYTES_A_BUCKET, LEAST_BITS, MOST_BITS = 1 << 19, 6, 24
#: Minimisers of more strings than HOT_ROWS are spread over SALTS; at most HOT_KEYS of them, those with most, so that they can be broadcast.
HOT_ROWS, HOT_KEYS, SALTS = 2000, 50_000, 64

_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_KEYS = "id long, none boolean, h int"


def normalised(text: bytes, chunk: int = CHUNK) -> bytes:
    """The words of a text, one space between them."""
    if len(text) <= chunk:
        return b" ".join(text.split())  # of bytes, this splits at ASCII white space alone
    parts, a = [], 0
    while a < len(text):
        found = _SPACES.search(text, a + chunk)
        b = found.start() if found else len(text)
        parts.append(b" ".join(text[a:b].split()))
        a = b
    return b" ".join(p for p in parts if p)


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a normalised text."""
    space = np.flatnonzero(data == 32)
    return (np.r_[0, space + 1], np.r_[space, data.size]) if data.size else (space, space)


class Cutter:
    """Cuts normalised texts into super-k-mers."""

    def __init__(self, window: int, mer: int, chunk: int = CHUNK, piece: int = PIECE):
        self.window, self.mer, self.chunk, self.piece, self.hashes = window, mer, chunk, piece, Hashes()
        self.turns = mixed(np.arange(1, mer + 1, dtype=np.uint64)) | np.uint64(1)

    def minimisers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rolling = self.hashes(data.size, least=2 * self.chunk)
        word = rolling.of(rolling.prefix(data), start, end - start)
        n = word.size - self.mer + 1
        run = sum(word[j : j + n] * self.turns[j] for j in range(self.mer))
        return _slide(mixed(run), self.window - self.mer + 1, np.minimum)

    def _pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (text number, first word, words), pieces of long texts overlapping by less than a window."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) < 2 * self.window - 1:
                continue
            parts = [(i, 0, text)]
            if len(text) > self.piece:
                start, end = _edges(np.frombuffer(text, np.uint8))
                last = start.size - self.window
                parts = [(i, a, text[start[a] : end[min(a + self.piece - 1, last) + self.window - 1]]) for a in range(0, last + 1, self.piece)]
            for part in parts:
                held.append(part)
                size += len(part[2]) + 1
                if size >= self.chunk:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def __call__(self, texts: list[bytes], strings: bool = True) -> Iterator[tuple]:
        """(text number, first word, minimiser, begin, end) of each super-k-mer and the words they lie in, or minimisers alone."""
        for group in self._pieces(texts):
            raw = b" ".join(g[2] for g in group)
            data = np.frombuffer(raw, np.uint8)
            start, end = _edges(data)
            if start.size < self.window:
                continue
            least = self.minimisers(data, start, end)
            at = np.searchsorted(start, np.cumsum([0] + [len(g[2]) + 1 for g in group]))
            piece = np.repeat(np.arange(len(group)), np.diff(at))
            whole = np.flatnonzero(piece[: least.size] == piece[self.window - 1 :])
            if not whole.size:
                continue
            new = np.r_[True, (least[whole[1:]] != least[whole[:-1]]) | (whole[1:] != whole[:-1] + 1)]
            first, last = whole[new], whole[np.r_[np.flatnonzero(new)[1:] - 1, whole.size - 1]]
            if not strings:
                yield (least[first],)
                continue
            of = piece[first]
            offset = np.array([g[1] for g in group])
            yield np.array([g[0] for g in group])[of], first - at[of] + offset[of], least[first], start[first], end[last + self.window - 1], raw


def _texts(column: pa.Array) -> list[bytes]:
    return [normalised(t) for t in column.cast(pa.binary()).to_pylist()]


def _minimisers(*how):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(*how)
        for batch in batches:
            for (least,) in cutter(_texts(batch.column(0)), strings=False):
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64))], ["least"])

    return go


def _pack(keys: tuple[np.ndarray, ...], row: np.ndarray, first: np.ndarray, packed: list[bytes]) -> bytes:
    """Super-k-mers of one bucket, compressed: the documents they come from, then document, first word and words of each."""
    docs, of = np.unique(row, return_inverse=True)
    head = np.array([docs.size, row.size], "<u4").tobytes()
    columns = [k[docs].tobytes() for k in keys] + [of.astype("<u4").tobytes(), first.astype("<u4").tobytes()]
    raw = b"".join([head, *columns, b"\n".join(packed)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n_docs, n = np.frombuffer(raw, "<u4", 2).tolist()
    at, columns = 8, []
    for kind, size in (("<i8", n_docs), ("?", n_docs), ("<i4", n_docs), ("<u4", n), ("<u4", n)):
        columns.append(np.frombuffer(raw, kind, size, at))
        at += columns[-1].nbytes
    id_, none, h, of, first = columns
    return id_[of], none[of], h[of], first.astype(np.int64), raw[at:].split(b"\n")


def _strings(window: int, mer: int, hot: np.ndarray, buckets: int):
    """(id, none, h, text) -> super-k-mers, those of one bucket and a stretch of the input together; the strings of hot minimisers are dealt over SALTS."""

    def blobs(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.cumsum([0] + [t[0][0].size for t in held])
        keys = tuple(np.concatenate([t[0][k] for t in held]) for k in range(3))
        row = np.concatenate([t[1] + n for t, n in zip(held, sizes[:-1], strict=True)])
        first, least = (np.concatenate([t[k] for t in held]) for k in (2, 3))
        raw = b"".join(t[6] for t in held)
        shift = np.cumsum([0] + [len(t[6]) for t in held])
        begin, end = (np.concatenate([t[k] + n for t, n in zip(held, shift[:-1], strict=True)]) for k in (4, 5))
        is_hot = np.isin(least, hot)
        salt = np.where(is_hot, mixed(keys[0][row].view(np.uint64) ^ first.astype(np.uint64)) % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
        bucket = (mixed(least + salt) % np.uint64(buckets)).astype(np.int64) * 2 + is_hot
        order = np.lexsort((least, bucket))  # like strings lie together
        edges = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist(), order.size]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = order[a:b]
            out.append(_pack(keys, row[i], first[i], [raw[x:y] for x, y in zip(begin[i].tolist(), end[i].tolist(), strict=True)]))
        at = order[np.array(edges[:-1], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at] // 2), pa.array(is_hot[at]), pa.array(out, pa.binary())], ["bucket", "hot", "strings"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, size = Cutter(window, mer), [], 0
        for batch in batches:
            keys = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for found in cutter(_texts(batch.column(3))):
                held.append((keys, *found))
                size += int((found[4] - found[3]).sum())
                if size >= FLUSH:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    return go


def _same_as_before(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each place has the words of the one before it in `at`."""
    same = np.ones(at.size, bool)
    same[:1] = False
    for j in range(window):
        w = words[at + j]
        same[1:] &= w[1:] == w[:-1]
    return same


def _classes(words: np.ndarray, at: np.ndarray, window: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The windows `at`, sorted so that equal ones are neighbours, and whether each is the first of its kind."""
    rolling = hashes(words.size)
    key = rolling.of(rolling.prefix(words.astype(np.uint64)), at, window)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new, like = np.r_[True, key[1:] != key[:-1]], _same_as_before(words, at, window)
    if (~new & ~like).any():  # two windows of one hash: sort those by their words
        bounds = np.r_[np.flatnonzero(new), at.size]
        for k in np.unique(np.searchsorted(bounds, np.flatnonzero(~new & ~like), side="right") - 1):
            a, b = bounds[k], bounds[k + 1]
            part = words[at[a:b, None] + np.arange(window)]
            at[a:b] = at[a:b][np.lexsort(part.T[::-1])]
        like = _same_as_before(words, at, window)
        new |= ~like
    return at, new


def _repeats(window: int, most_bytes: int):
    """Super-k-mers sorted by bucket -> spans of repeated words (a, b), and open windows (a, b, their words)."""

    def work(blobs: list[bytes], settled: bool, hashes: Hashes) -> Iterator[pa.RecordBatch]:
        ids, none, h, first, packed = zip(*map(_unpack, blobs), strict=True)
        ids, none, h, first = map(np.concatenate, (ids, none, h, first))
        parts = [p for part in packed for p in part]
        raw = b" ".join(parts) + b" "
        start = np.r_[0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1]
        text = pa.Array.from_buffers(pa.large_binary(), start.size - 1, [None, pa.py_buffer(start.astype(np.int64).tobytes()), pa.py_buffer(raw)])
        words = text.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)  # equal numbers: equal words
        at = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
        count = np.diff(at) - window + 1
        row = np.repeat(np.arange(count.size), count)
        place = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)  # of the window in its string
        known = np.where(none, 0, ids)
        by_id = np.lexsort((known, none))
        rank = np.empty(ids.size, np.int64)
        rank[by_id] = np.cumsum(np.r_[0, (known[by_id[1:]] != known[by_id[:-1]]) | (none[by_id[1:]] != none[by_id[:-1]])])
        number = np.full(words.size, -1, np.int64)  # of the window that starts at a word
        number[at[row] + place] = np.arange(row.size)
        sorted_at, new = _classes(words, at[row] + place, window, hashes)
        of = number[sorted_at]
        begin = np.flatnonzero(new)
        earliest = np.repeat(np.minimum.reduceat(rank[row[of]], begin), np.diff(np.r_[begin, of.size]))
        repeat = np.zeros(row.size, bool)
        repeat[of] = rank[row[of]] > earliest

        def out(i: np.ndarray, a: np.ndarray, b: np.ndarray, texts: list[bytes] | None) -> pa.RecordBatch:
            cols = [pa.array(ids[i]), pa.array(none[i]), pa.array(h[i]), pa.array(a), pa.array(b), pa.array(texts, pa.binary()) if texts is not None else pa.nulls(i.size, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["id", "none", "h", "a", "b", "words"])

        hit = np.flatnonzero(repeat)
        if hit.size:
            cut = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]
            x, y = hit[cut], hit[np.r_[np.flatnonzero(cut)[1:] - 1, hit.size - 1]]
            yield out(row[x], first[row[x]] + place[x], first[row[x]] + place[y] + window, None)
        left = np.flatnonzero(~repeat) if not settled else hit[:0]
        for k in range(0, left.size, 1 << 16):
            i = left[k : k + (1 << 16)]
            w = at[row[i]] + place[i]
            texts = [raw[p : q - 1] for p, q in zip(start[w].tolist(), start[w + window].tolist(), strict=True)]
            yield out(row[i], first[row[i]] + place[i], first[row[i]] + place[i] + window, texts)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, settled, hashes = None, [], 0, True, Hashes()
        for batch in batches:
            for bucket, hot, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, more = (bucket, hot), int.from_bytes(blob[:8], "little")
                if part != at or size + more > most_bytes:
                    settled &= part != at  # else the bucket goes on
                    if held:
                        yield from work(held, settled, hashes)
                    settled = not hot if part != at else False
                    at, held, size = part, [], 0
                held.append(blob)
                size += more
        if held:
            yield from work(held, settled, hashes)

    return go


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> words, removed words, hash of the rest."""
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        spans = batch.column(2)
        for r in range(batch.num_rows):
            text = normalised(batch.column(1).slice(r, 1).cast(pa.binary())[0].as_py())
            start, end = _edges(np.frombuffer(text, np.uint8))
            gone = 0
            digest = hashlib.sha256()
            if spans[r].is_valid:
                a, b = (x.to_numpy(zero_copy_only=False) for x in spans.slice(r, 1).flatten().flatten())
                depth = np.zeros(start.size + 1, np.int64)
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                stays = np.diff((np.cumsum(depth[:-1]) == 0).astype(np.int8), prepend=0, append=0)
                x, y = np.flatnonzero(stays == 1), np.flatnonzero(stays == -1)
                gone = start.size - int((y - x).sum())
                digest.update(b" ".join(text[p:q] for p, q in zip(start[x].tolist(), end[y - 1].tolist(), strict=True)))
            else:
                digest.update(text)
            n_words.append(start.size)
            n_removed.append(gone)
            digests.append(digest.hexdigest())
        cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def buckets_for(docs: DataFrame) -> int:
    """From the optimizer's estimate of the input's size, which costs no job; a wrong one only costs time."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 62
    return 1 << min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_BUCKET).bit_length() if known else 0))


def repeated_words(d: DataFrame, window: int = WINDOW, mer: int = MER, hot_rows: int = HOT_ROWS, sorted_bytes: int = SORTED, buckets: int | None = None) -> DataFrame:
    """(id, none, h, text) -> (id, none, h, spans): spans (a, b) of words that lie in windows an earlier document has."""
    if not 0 < mer <= window:
        raise ValueError("a minimiser has at least one word, and not more than a window")
    buckets = buckets or buckets_for(d)
    long = d.where(F.octet_length("text") >= 2 * window - 1)
    often = repeated_fingerprints(in_arrow(long.select("text"), _minimisers(window, mer), "least long"), least=hot_rows + 1)
    often = save(often, "skm-often", free=True).orderBy(F.desc("n")).limit(HOT_KEYS)
    hot = np.sort(np.array([r.fp for r in often.select("fp").collect()], np.int64)).view(np.uint64)  # at most HOT_KEYS
    strings = in_arrow(long, _strings(window, mer, hot, buckets), "bucket long, hot boolean, strings binary")
    met = strings.repartition("bucket", "hot").sortWithinPartitions("bucket", "hot")
    found = save(in_arrow(met, _repeats(window, sorted_bytes), f"{_KEYS}, a long, b long, words binary"), "skm-found", free=True)
    open_ = found.where("words is not null")
    known = F.struct("none", F.when(~F.col("none"), F.col("id")).alias("id"))
    earliest = open_.groupBy("words").agg(F.min(known).alias("earliest"), F.max(known).alias("latest")).where("latest > earliest")
    later = open_.join(earliest, "words").where(known > F.col("earliest")).select("id", "none", "h", "a", "b")
    spans = found.where("words is null").select("id", "none", "h", "a", "b").union(later).distinct()
    return spans.groupBy("id", "none", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, none, h, text): rows are told apart by doc_id and 32 bits of the text's hash, those without doc_id by 96 bits."""
    text = docs.select("doc_id", text_or_empty().alias("text"))
    none = F.col("doc_id").isNull()
    id_ = F.when(none, F.xxhash64(F.lit("none"), "text")).otherwise(F.col("doc_id").cast("long"))
    return text.select("doc_id", id_.alias("id"), none.alias("none"), F.hash("text").alias("h"), "text")


def super_kmer_dedup(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot_rows: int = HOT_ROWS, sorted_bytes: int = SORTED, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    d = _keyed(docs)
    spans = save(repeated_words(d.drop("doc_id"), window, mer, hot_rows, sorted_bytes, buckets), "skm-spans", free=True)
    rows = d.join(spans, ["id", "none", "h"], "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return in_arrow(rows, _kept, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
