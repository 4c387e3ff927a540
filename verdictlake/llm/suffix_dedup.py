"""Removal of repeated passages by prefix-free parsing.

Rolling-hash triggers (positions whose k-gram hash is the least of some run of
`run` k-grams) cut every text into phrases. Whether a position is a trigger is
decided by the run of bytes around it alone, so equal strings are cut alike.
Every string of `match` bytes belongs to one trigger: the first one that lies a
run or more behind its start, which the string itself decides. The strings of one
trigger start within one phrase, and all contain the same core around it.

Corpus order is needed to the depth of `match` bytes only, and only where strings
repeat, so the parse is first reduced to that:

1. cores are counted over the corpus in counting quotient filters; one that occurs
   once ends the search for all strings of its trigger.
2. the dictionary: triggers with equal context (all bytes of all their strings, at
   equal places) are one entry. An entry that occurs twice settles all its strings.
3. where a core has several entries and some of them occur once, one text each
   stands for the entry. The suffix array of the dictionary (what stands before the
   trigger, read towards it) and that of the parse (what follows it) are built for
   the entries of a shard, and combine into corpus order for every length x before
   the trigger: by class of the last x bytes, then by rank of what follows. Strings
   are equal exactly if neighbours in that order are, by the smallest LCP between.

Entries of one core meet in one shard, up to `entries` of them; a core with more
lists the strings of each entry by hash instead, dealt string by string.

Entries are compared by core, context and a check, 64 bits each: the context's hash
is a rolling hash of its own (other base, other symbol values), so that strings
count as equal by 128 independent bits. Rows move as hashes and offsets; texts move
only where entries are taken or spans are cut out of them. Joins on a core or an
entry spread those with very many rows over salts (`semi`).

The same search runs over words in place of bytes (`shared_passages`): a symbol is
then the hash of a word, and a string counts where another document has it too.

Defined results: a null text is empty; texts shorter than `match` bytes lose
nothing; rows that repeat a text lose it all if it is long enough; rows are told
apart by doc_id and text, so a row that repeats both is the same document to
`shared_passages`; an empty table gives no rows; other columns are ignored.
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

MATCH, GRAM, RUN = 400, 16, 128
#: The same in words: passages of over 50 words.
PASSAGE, PASSAGE_GRAM, PASSAGE_RUN = 51, 2, 16
#: Bytes hashed at once; longer texts are cut into pieces that overlap.
CHUNK = 1 << 18
#: Dictionary entries of one core that meet in one place, and entries whose arrays are built together.
ENTRIES, SHARD = 8192, 8192
#: Ids, about 16 bytes each, that are broadcast to leave out texts ahead of a shuffle; with more of them all texts move.
BROADCAST_IDS = 1 << 20
#: Keys with more rows than HOT_ROWS are spread over SALTS; at most HOT_KEYS of them, those with most rows, so that they can be broadcast.
HOT_ROWS, HOT_KEYS, SALTS = 2000, 50_000, 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PACK = 1 << 16


class Rolling:
    """Hashes of all substrings of one length, from prefix sums modulo 2^64. Symbols are bytes, or 64-bit numbers."""

    def __init__(self, size: int, which: int = 0):
        def powers(base: int) -> np.ndarray:
            out = np.full(size + 1, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.size = size
        self.up, self.down = powers(_BASES[which]), powers(pow(_BASES[which], -1, 1 << 64))
        self.table = np.random.default_rng(20_240_501 + which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.turn = np.uint64(which * 0xA24BAED4963EE407)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(data.size + 1, np.uint64)
        values = self.table[data] if data.dtype == np.uint8 else mixed(data + self.turn)
        np.cumsum(values * self.up[: data.size], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((prefix[start + length] - prefix[start]) * self.down[start])


class Hashes:
    """Two rolling hashes that grow with what they are asked for."""

    def __init__(self):
        self.held: list[Rolling | None] = [None, None]

    def __call__(self, size: int, which: int = 0, least: int = 0) -> Rolling:
        if (held := self.held[which]) is None or held.size < size:
            held = self.held[which] = Rolling(max(size, least), which)
        return held


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _starts(text: bytes) -> np.ndarray:
    """Offsets of the words of a text."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(np.diff(space.astype(np.int8), prepend=1) == -1)


def words(text: bytes, hashes: Hashes, chunk: int) -> np.ndarray:
    """A hash for each word; words longer than `chunk` are hashed apart, so that memory stays bounded."""

    def short(piece: bytes) -> np.ndarray:
        data = np.frombuffer(piece, np.uint8)
        edge = np.diff(_SPACE[data].astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        rolling = hashes(data.size, least=3 * chunk)
        return rolling.of(rolling.prefix(data), start, end - start)

    out, a = [], 0
    while a < len(text):
        b = a + chunk
        if b < len(text):
            after = _SPACES.search(text, b)
            b = after.start() if after else len(text)
            first = a + chunk
            while first > a and not _SPACE[text[first - 1]]:
                first -= 1
            if b - first > chunk:
                out.append(short(text[a:first]))
                out.append(np.frombuffer(hashlib.blake2b(text[first:b], digest_size=8).digest(), np.uint64))
                a = b
                continue
        out.append(short(text[a:b]))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Units:
    """How texts are cut into symbols: bytes or words."""

    def __init__(self, by_words: bool, chunk: int):
        self.by_words, self.chunk, self.hashes = by_words, chunk, Hashes()
        self.kind = np.dtype(np.uint64 if by_words else np.uint8)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.frombuffer(t, np.uint8) for t in texts]
        out: list[np.ndarray] = []
        a = 0
        while a < len(texts):  # short texts together
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) < self.chunk:
                size += len(texts[b]) + 1
                b += 1
            found = words(b" ".join(texts[a:b]), self.hashes, self.chunk)
            if b - a == 1:
                out.append(found)
            else:
                ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
                out += np.split(found, np.searchsorted(_starts(b" ".join(texts[a:b])), ends[:-1]))
            a = b
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _slide(x: np.ndarray, run: int, pick) -> np.ndarray:
    """Least (or largest) of each `run` values in a row."""
    width = 1
    while width < run:
        step = min(width, run - width)
        x = pick(x[: x.size - step], x[step:])
        width += step
    return x


def triggers(rolling: Rolling, prefix: np.ndarray, gram: int, run: int) -> np.ndarray:
    n = prefix.size - gram
    if n < run:
        return np.zeros(0, np.int64)
    h = (mixed((prefix[gram:] - prefix[:n]) * rolling.down[:n]) >> np.uint64(32)).astype(np.uint32)
    low = _slide(h, run, np.minimum)
    pad = np.zeros(run - 1, np.uint32)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), run, np.maximum) == h)


def parse(texts: list[np.ndarray], match: int, gram: int, run: int, chunk: int, hashes: Hashes, cores_only: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, symbols before the trigger, core, context, check) of each trigger that strings belong to."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, np.ndarray, int]] = []  # text, offset, symbols, number of starts

    def flush() -> None:
        if not group:
            return
        data = np.concatenate([g[2] for g in group])
        rolling = hashes(data.size, least=chunk + 2 * match)
        prefix = rolling.prefix(data)
        at = np.cumsum([0] + [g[2].size for g in group])
        t = triggers(rolling, prefix, gram, run)
        before = np.r_[-1, t[:-1]]
        part = np.searchsorted(at, t, side="right") - 1
        low, starts = at[part], np.array([g[3] for g in group])[part]
        first = np.maximum(np.maximum(before - run + 2, t - 2 * run + 2), low)
        last = np.minimum(t - run + 1, low + starts - 1)
        ok = first <= last
        t, first, last, part = t[ok], first[ok], last[ok], part[ok]
        number, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        cols = [number[part], first - at[part] + offset[part], last - first + 1, t - first, rolling.of(prefix, t - run + 1, match - run + 1).view(np.int64)]
        if not cores_only:
            place = mixed(((t - first) * _PACK + (last - first)).astype(np.uint64))
            other = hashes(data.size, 1, chunk + 2 * match)
            context = mixed(other.of(other.prefix(data), first, last - first + match) ^ place)
            cols += [context.view(np.int64), rolling.of(prefix, first, last - first + match).view(np.int64)]
        found.append(tuple(cols))
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        for c in range(0, text.size - match + 1, chunk):
            starts = min(chunk, text.size - match + 1 - c)
            group.append((i, c, text[c : c + starts + match - 1], starts))
            held += starts
            if held >= chunk:
                flush()
                held = 0
    flush()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5 if cores_only else 7))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _cores(by_words: bool, match: int, gram: int, run: int, chunk: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(by_words, chunk)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                texts = units(_utf8(batch.column(0).slice(a, 512)))
                rows = parse(texts, match, gram, run, chunk, units.hashes, cores_only=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows[4])], ["core"])

    return go


def _triggers(by_words: bool, match: int, gram: int, run: int, chunk: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(by_words, chunk)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                i, first, n, lead, core, context, check = parse(units(_utf8(part.column(2))), match, gram, run, chunk, units.hashes)
                doc, h = (part.column(c).to_numpy(zero_copy_only=False)[i] if i.size else i for c in (0, 1))
                cols = [core, context, check, doc, h, first.astype(np.int64), n.astype(np.int32), lead.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["core", "context", "check", "k", "h", "first", "n", "lead"])

    return go


def _entries(by_words: bool, match: int, chunk: int):
    """(k, h, text, list of core, first, n, lead, times) -> a row for each dictionary entry, with its symbols."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(by_words, chunk)
        for batch in batches:
            for r in range(batch.num_rows):
                text = units([batch.column(2).slice(r, 1).cast(pa.binary())[0].as_py()])[0]
                flat = batch.column(3).slice(r, 1).flatten()
                core, first, n, lead, times = flat.flatten()
                size = len(flat)
                part = [text[a : a + b + match - 1].tobytes() for a, b in zip(first.to_pylist(), n.to_pylist(), strict=True)]
                k, h = (pa.array(np.full(size, batch.column(c)[r].as_py(), np.int64)) for c in (0, 1))
                single = pa.array(times.to_numpy(zero_copy_only=False) == 1)
                yield pa.RecordBatch.from_arrays([core, k, h, first, n, lead, single, pa.array(part, pa.binary())], ["core", "k", "h", "first", "n", "lead", "single", "part"])

    return go


def _sorted_common(core: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the parts (by core, then by symbols) and common lengths of neighbours; -1 between cores."""
    cores, keys = core.tolist(), [p.tobytes() for p in parts]
    order = np.array(sorted(range(len(parts)), key=lambda i: (cores[i], keys[i])), np.int64)
    kind = parts[0].dtype
    width = max(1, max(p.size for p in parts))
    rows = np.frombuffer(b"".join(keys[i].ljust(width * kind.itemsize, b"\0") for i in order.tolist()), kind).reshape(-1, width)
    unlike = rows[1:] != rows[:-1]
    length = np.array([p.size for p in parts])[order]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    return order, np.where(core[order[1:]] == core[order[:-1]], common, -1)


class RangeLeast:
    """Least value of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << len(self.levels) - 1) * 2 <= values.size:
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Over [start, end), start < end."""
        level = np.frexp((end - start).astype(float))[1] - 1
        out = np.empty(start.size, np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][end[at] - (1 << k)])
        return out


def equal_strings(core: np.ndarray, parts: list[np.ndarray], lead: np.ndarray, n: np.ndarray, match: int, doc: np.ndarray | None = None) -> np.ndarray:
    """Entries x lengths before the trigger (from the least of all): whether that string of the entry is one of another entry too.

    With `doc`, of an entry of another document; -1 stands for entries that several documents have.
    """
    by_left, left_common = _sorted_common(core, [p[:a][::-1] for p, a in zip(parts, lead.tolist(), strict=True)])
    by_right, right_common = _sorted_common(core, [p[a:] for p, a in zip(parts, lead.tolist(), strict=True)])
    rank = np.empty(core.size, np.int64)
    rank[by_right] = np.arange(core.size)
    least = RangeLeast(right_common)
    low = int((lead - n + 1).min())
    out = np.zeros((core.size, int(lead.max()) - low + 1), bool)
    for x in range(low, low + out.shape[1]):
        kind = np.empty(core.size, np.int64)
        kind[by_left] = np.r_[0, np.cumsum(left_common < x)]
        i = np.flatnonzero((x <= lead) & (x > lead - n))
        i = i[np.lexsort((rank[i], kind[i]))]  # corpus order of the strings with x symbols before the trigger
        if i.size < 2:
            continue
        equal = np.zeros(i.size - 1, bool)
        same = np.flatnonzero(kind[i[:-1]] == kind[i[1:]])
        if same.size:
            equal[same] = least.of(rank[i[same]], rank[i[same + 1]]) >= match - x
        begin = np.flatnonzero(np.r_[True, ~equal])
        size = np.diff(np.r_[begin, i.size])
        hit = size > 1
        if doc is not None:
            hit &= (np.minimum.reduceat(doc[i], begin) != np.maximum.reduceat(doc[i], begin)) | (np.minimum.reduceat(doc[i], begin) < 0)
        out[i, x - low] = np.repeat(hit, size)
    return out


def _corpus_order(by_words: bool, match: int, shard: int):
    """Entries sorted by core -> packed spans of the strings of single entries that another entry (by words: document) has too."""
    unit = np.dtype(np.uint64 if by_words else np.uint8)

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        core, k, h, first, n, lead, single, parts = (list(c) for c in zip(*rows, strict=True))
        core, k, h, first, n, lead, single = (np.array(c, np.int64) for c in (core, k, h, first, n, lead, single))
        doc = np.where(single > 0, np.unique(np.stack([k, h]), axis=1, return_inverse=True)[1].reshape(-1), -1) if by_words else None
        hit = equal_strings(core, [np.frombuffer(p, unit) for p in parts], lead, n, match, doc) & (single > 0)[:, None]
        low = int((lead - n + 1).min())
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # lengths low + a .. low + b - 1
        start = first[i] + lead[i] - (low + b - 1)
        return pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(h[i]), pa.array(first[i]), pa.array(start * _PACK + (b - a - 1) + match)], ["k", "h", "entry", "span"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= shard and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield spans(rows)

    return go


def _strings(by_words: bool, match: int, chunk: int):
    """(k, h, text, list of core, first, n, lead, times) -> a row for each string: core, two hashes, k, h, its entry, start, single."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(by_words, chunk)
        for batch in batches:
            for r in range(batch.num_rows):
                data = units([batch.column(2).slice(r, 1).cast(pa.binary())[0].as_py()])[0]
                flat = batch.column(3).slice(r, 1).flatten()
                core, first, n, _, times = (f.to_numpy(zero_copy_only=False) for f in flat.flatten())
                order = np.argsort(first)
                core, first, n, times = core[order], first[order], n[order], times[order]
                a = 0
                while a < first.size:  # as many as lie within one chunk
                    b = max(a + 1, int(np.searchsorted(first, first[a] + chunk)))
                    base = int(first[a])
                    piece = data[base : int(first[b - 1] + n[b - 1]) + match]
                    each = n[a:b].astype(np.int64)
                    ends = np.cumsum(each)
                    start = np.repeat(first[a:b] - base - ends + each, each) + np.arange(ends[-1])
                    pair = [x.of(x.prefix(piece), start, match).view(np.int64) for x in (units.hashes(piece.size, w, chunk + 4 * match) for w in (0, 1))]
                    k, h = (np.full(start.size, batch.column(c)[r].as_py(), np.int64) for c in (0, 1))
                    cols = [np.repeat(core[a:b], each), *pair, k, h, np.repeat(first[a:b], each), start + base, np.repeat(times[a:b] == 1, each)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["core", "string", "check", "k", "h", "entry", "first", "single"])
                    a = b

    return go


def _runs(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of packed spans; touching spans are one run."""
    packed = np.sort(packed)
    a, b = packed // _PACK, packed // _PACK + packed % _PACK
    reach = np.maximum.accumulate(b)
    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return a[new], reach[np.r_[new[1:] - 1, a.size - 1]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, h, text, packed spans) -> removed bytes, runs, hash of the rest."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for r in range(batch.num_rows):
            text = batch.column(2).slice(r, 1).cast(pa.binary())[0].as_py()
            a, b = _runs(batch.column(3).slice(r, 1).flatten().to_numpy(zero_copy_only=False))
            digest, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                digest.update(text[at:x])
                at = y
            digest.update(text[at:])
            for c, v in zip(cols, (batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), int((b - a).sum()), a.size, digest.hexdigest()), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "h", "n_removed", "n_spans", "kept_sha256"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, h, packed spans) -> words in runs, runs."""
    for batch in batches:
        runs = [_runs(batch.column(2).slice(r, 1).flatten().to_numpy(zero_copy_only=False)) for r in range(batch.num_rows)]
        cols = [batch.column(0), batch.column(1), pa.array([int((b - a).sum()) for a, b in runs], pa.int64()), pa.array([a.size for a, _ in runs], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["k", "h", "shared_words", "shared_passages"])


def semi(rows: DataFrame, keys: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """`rows` with a key in the saved table `keys` (`on` and `times`, the key's number of rows), with hot keys spread over salts.

    Keys count as hot above hot_rows and above total / HOT_KEYS, so there are at most HOT_KEYS of them.
    """
    total = keys.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") > max(hot_rows, total // HOT_KEYS)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    marked = rows.join(F.broadcast(keys.where(hot).select(*on, F.lit(True).alias("_hot"))), on, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("k", "h", "first"), F.lit(SALTS))).otherwise(0)
    return marked.withColumn("_salt", salt.cast("int")).join(keys.select(*on, F.explode(salts).alias("_salt")), [*on, "_salt"], "left_semi").select(*rows.columns)


def texts_of(d: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """Texts ahead of an inner join on (k, h): only those of the saved `ids`, if a count of them allows a broadcast."""
    return d.join(F.broadcast(ids), "k", "left_semi") if ids.count() <= broadcast_ids else d


def repeated_spans(d: DataFrame, match: int, gram: int, run: int, chunk: int, entries: int, broadcast_ids: int, by_words: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(k, h, text) -> (k, h, spans): start * 2^16 + length of spans that cover all repeated strings (by words: those that another document has)."""
    if 3 * run > match - gram + 3:
        raise ValueError("run is too long for match: a string might hold no trigger of its own")
    how = (by_words, match, gram, run, chunk)
    cores = save(repeated_fingerprints(in_arrow(d.select("text"), _cores(*how), "core long")).select(F.col("fp").alias("core"), F.col("n").alias("times")), "pfp-cores")
    rows = in_arrow(d, _triggers(*how), "core long, context long, check long, k long, h long, first long, n int, lead int")
    rows = save(semi(rows, cores, ["core"], hot_rows), "pfp-rows")
    entry = ["core", "context", "check"]
    one = F.struct("k", "h", "first", "n", "lead")
    times = F.count("*")
    if by_words:  # an entry of one document alone does not settle anything
        times = F.when(F.min(F.struct("k", "h")) == F.max(F.struct("k", "h")), 1).otherwise(times)
    classes = save(rows.groupBy(*entry).agg(times.alias("times"), F.count("*").alias("places"), F.min(one).alias("one")), "pfp-dictionary")
    settled = semi(rows, save(classes.where("times > 1").select(*entry, "times"), "pfp-settled"), entry, hot_rows)
    spans = settled.select("k", "h", (F.col("first") * _PACK + F.col("n") + (match - 1)).alias("span"))
    # cores with an entry that occurs once beside others
    unsure = classes.groupBy("core").agg(F.count("*").alias("size"), F.min("times").alias("least")).where("size > 1 and least = 1").select("core", "size")
    ones = save(classes.join(unsure, "core").select(*entry, "size", "times", "places", "one.*"), "pfp-open")
    texts = texts_of(d, save(ones.select("k").distinct(), "pfp-ids"), broadcast_ids)

    def taken(of: str, function, schema: str) -> DataFrame:
        listed = ones.where(of).groupBy("k", "h").agg(F.collect_list(F.struct("core", "first", "n", "lead", "times")).alias("of"))
        return in_arrow(texts.join(listed, ["k", "h"]).select("k", "h", "text", "of"), function, schema)

    found = taken(f"size <= {entries}", _entries(by_words, match, chunk), "core long, k long, h long, first long, n int, lead int, single boolean, part binary")
    found = in_arrow(found.repartition("core").sortWithinPartitions("core"), _corpus_order(by_words, match, SHARD), "k long, h long, entry long, span long")
    if ones.where(f"size > {entries}").limit(1).count():
        strings = taken(f"size > {entries}", _strings(by_words, match, chunk), "core long, string long, check long, k long, h long, entry long, first long, single boolean")
        strings = save(strings, "pfp-strings")
        string = ["core", "string", "check"]
        again = F.max(~F.col("single")) | (F.min(F.struct("k", "h")) != F.max(F.struct("k", "h"))) if by_words else F.count("*") > 1
        again = save(strings.groupBy(*string).agg(F.count("*").alias("times"), again.alias("again")).where("again").select(*string, "times"), "pfp-again")
        hits = semi(strings.where("single"), again, string, hot_rows)
        found = found.union(hits.select("k", "h", "entry", (F.col("first") * _PACK + match).alias("span")))
    if by_words:  # the other places of an entry that one document has several times
        found = save(found, "pfp-found")
        several = ones.where("times = 1 and places > 1").select(*entry, F.col("first").alias("entry"))
        others = rows.join(several, entry).where("first <> entry").select("k", "h", "entry", "first")
        moved = found.join(others, ["k", "h", "entry"]).select("k", "h", "entry", (F.col("span") + (F.col("first") - F.col("entry")) * _PACK).alias("span"))
        found = found.union(moved)
    return spans.union(found.select("k", "h", "span")).groupBy("k", "h").agg(F.collect_set("span").alias("spans"))  # copies of a row add nothing


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", text_or_empty().alias("text"))
    return d.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "h": F.xxhash64("text")})


def shared_passages(docs: DataFrame, match: int = PASSAGE, gram: int = PASSAGE_GRAM, run: int = PASSAGE_RUN, chunk: int = CHUNK, entries: int = ENTRIES, broadcast_ids: int = BROADCAST_IDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Documents that share passages: k (doc_id, or -1), h (xxhash64 of the text), shared_words, shared_passages.

    Words are what ASCII white space separates. A word counts if it lies in a string of
    `match` words that another document has too; passages are maximal runs of such words.
    """
    keyed = _keyed(docs).where(F.octet_length("text") >= 2 * match - 1).select("k", "h", "text")
    spans = repeated_spans(keyed, match, gram, run, chunk, entries, broadcast_ids, by_words=True, hot_rows=hot_rows)
    return in_arrow(spans, _summed, "k long, h long, shared_words long, shared_passages long")


def suffix_dedup(docs: DataFrame, match: int = MATCH, gram: int = GRAM, run: int = RUN, chunk: int = CHUNK, entries: int = ENTRIES, broadcast_ids: int = BROADCAST_IDS, hot_rows: int = HOT_ROWS, passages: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `passages` also shared_words and shared_passages (0 where none)."""
    d = _keyed(docs)
    keyed = d.where(F.octet_length("text") >= match).select("k", "h", "text")
    spans = save(repeated_spans(keyed, match, gram, run, chunk, entries, broadcast_ids, hot_rows=hot_rows), "pfp-spans")
    texts = texts_of(keyed, save(spans.select("k").distinct(), "pfp-cut"), broadcast_ids).dropDuplicates(["k", "h"])
    cut = texts.join(spans, ["k", "h"]).select("k", "h", "text", "spans")
    done = save(in_arrow(cut, _cut, "k long, h long, n_removed long, n_spans long, kept_sha256 string"), "pfp-done")
    counts = ["n_removed", "n_spans"]
    if passages:
        done = done.join(save(shared_passages(docs, broadcast_ids=broadcast_ids), "pfp-shared"), ["k", "h"], "full_outer")
        counts += ["shared_words", "shared_passages"]
    rows = d.select("doc_id", "k", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("whole"))
    number = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    return rows.join(done, ["k", "h"], "left").select("doc_id", "n_bytes", *number[:2], F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *number[2:])
