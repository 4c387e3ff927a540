"""Super-k-mer dedup, prefix trie and hard negatives against brute force on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import hard_negatives, prefix_trie, super_kmer_dedup
from verdictlake.llm.suffix_dedup import Hashes

CLASHES = ("id", "none", "h", "spans", "a", "b", "words", "len", "low", "depth", "x", "y", "list", "part", "v", "rank", "score", "owner")


def clashing(df):
    return df.withColumns({n: F.lit("clash") for n in CLASHES})


# 11: super-k-mers


def brute_words(rows, window=13):
    """(n_words, n_removed, hash) for each (doc_id or None, text), in the order given."""
    docs = [(math.inf if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, math.inf), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    line = [f"w{rng.randrange(9)}" for _ in range(40)]
    texts = [None, "", " \t\n", "one", "a " * 500, "b " * 5000, "é ü　ñ " * 20, "x\0y " * 30, "same thirteen words " * 4]
    for _ in range(n):
        own = [rng.choice(["p", "q", "rr", "é", " "]) + str(rng.randrange(40)) for _ in range(rng.randrange(60))]
        a = rng.randrange(20)
        texts.append(rng.choice([" ", "  ", "\n"]).join(own[:20] + line[a : a + rng.randrange(30)] + own[20:]))
    return texts


@pytest.mark.parametrize(("mer", "hot_rows", "sorted_bytes", "buckets"), [(3, 2000, 1 << 25, None), (1, 2, 1 << 25, 2), (13, 1, 300, 1), (2, 3, 1, 3)])
def test_super_kmers(spark, mer, hot_rows, sorted_bytes, buckets):
    texts = passages(mer)
    rows = list(enumerate(texts))
    random.Random(7).shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in super_kmer_dedup.super_kmer_dedup(df, mer=mer, hot_rows=hot_rows, sorted_bytes=sorted_bytes, buckets=buckets).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_words(rows)))


@pytest.mark.parametrize("sorted_bytes", [1 << 25, 200])
def test_super_kmers_of_null_and_repeated_ids(spark, sorted_bytes):
    t, u = " ".join(map(str, range(30))), " ".join(map(str, range(10, 50)))
    rows = [(None, t), (None, u), (None, t), (4, u), (4, u), (4, t), (2**63 - 1, t), (-(2**63), u + " more")] + [(None, u)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in super_kmer_dedup.super_kmer_dedup(df, hot_rows=3, sorted_bytes=sorted_bytes).collect())
    assert got == sorted((str(i), *v) for (i, _), v in zip(rows, brute_words(rows)))


def test_super_kmers_of_an_empty_table(spark):
    assert super_kmer_dedup.super_kmer_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="minimiser"):
        super_kmer_dedup.super_kmer_dedup(spark.createDataFrame([], "doc_id long, text string"), mer=14)


def test_long_texts_are_cut_alike():
    """Super-k-mers of a text cut into pieces hold the windows of the whole, each once."""
    text = " ".join(random.Random(3).choice("abcdefg") for _ in range(3000)).encode()
    found = []
    for piece in (64, 1 << 20):
        cutter, windows = super_kmer_dedup.Cutter(13, 3, chunk=500, piece=piece), []
        for _, first, _, begin, end, raw in cutter([text]):
            for a, x, y in zip(first.tolist(), begin.tolist(), end.tolist()):
                w = raw[x:y].split()
                windows += [(a + k, tuple(w[k : k + 13])) for k in range(len(w) - 12)]
        found.append(sorted(windows))
    assert found[0] == found[1]
    assert len(found[0]) == 2988
    assert super_kmer_dedup.normalised(b"a  b\tc\n" * 100, chunk=5) == b" ".join([b"a b c"] * 100)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(super_kmer_dedup, "Hashes", Hashes)
    hashes = lambda size: type("Same", (), {"prefix": lambda self, d: d, "of": lambda self, p, s, n: np.zeros(len(s), np.uint64)})()
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4])
    at, new = super_kmer_dedup._classes(words, np.arange(7), 3, hashes)
    kinds = np.cumsum(new)
    by = defaultdict(set)
    for a, k in zip(at.tolist(), kinds.tolist()):
        by[k].add(tuple(words[a : a + 3].tolist()))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({tuple(words[a : a + 3].tolist()) for a in range(7)})


# 12: prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_of(spark, rows):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df).collect())


def test_prefix_trie(spark):
    rng = random.Random(5)
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 40, 99, 100, 101, 150, 205, 207, -3, -250, 2**62]:
        for turn in rng.sample([None, 0, 1, 1, 2, 3, 4, 5, 6, 7], rng.randrange(1, 10)):
            rows.append((c, turn, rng.choice([None, "user", "", "assistant"]), rng.choice([None, "", "a", "bb", "é😀", "long " * 500])))
    rows += rows[:5] + [(None, 1, "user", "nobody's")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_prefix_trie_of_deep_and_equal_conversations(spark):
    """Two conversations that part at turn 90, hundreds that are equal, and some without turns."""
    rows = [(c, t, "user", f"turn {t}" if t < 90 or c != 103 else "else") for c in (100, 101, 102, 103) for t in range(130)]
    rows += [(c, t, "user", "hello") for c in range(1000, 1400) for t in range(4)]
    rows += [(c, 0, "user", "only") for c in range(2001, 2040)]  # the block's first one is absent
    got = trie_of(spark, rows)
    assert got == brute_trie(rows)
    assert any(depth == 0 and parent is None for _, depth, parent, *_ in got)


def test_prefix_trie_of_an_empty_table(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []


# 13: hard negatives


def brute_negatives(rows, positives=5, negatives=5):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**19 for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        known[i] = min(known.get(i, row), row)
    out = []
    for a, (label, q) in known.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in known.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def negatives_of(spark, rows, **how):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **how).collect())


@pytest.mark.parametrize("how", [{}, {"first": 1, "most": 4, "part": 7, "sample": 50}, {"first": 3, "most": 64, "part": 1000}])
def test_hard_negatives(spark, how, monkeypatch):
    monkeypatch.setattr(hard_negatives, "A_CENTROID", 4)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(700 + i, [0.25] * 8, 1 + i % 2) for i in range(60)]  # ties
    rows += [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (1004, [1.0] * 8, None), (None, [1.0] * 8, 1), (1100, [], 1), (1200, [9.0] * 3, 2), (1300, [600_000.0] * 8, 1)]
    rows += [(1401, [500_000.0] * 8, 1), (1500, [400_000.0] * 8, 1), (1502, [450_000.0] * 8, 2)] + rows[:40] + [(5, [1.0] * 8, 0)]
    got = negatives_of(spark, rows, **how)
    assert got == brute_negatives(rows)
    assert len(got) > 50


def test_hard_negatives_without_rows(spark):
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(0, None, 1)]) == []
    assert negatives_of(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 3)]) == []  # vec_id 0 is relabelled, and has no positive then
    assert negatives_of(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == [(100, 1, 1, 2, 65536, 65536)]


def test_bounds_hold_and_lists_are_skipped():
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal(size=(2000, 16)) * 30 + np.repeat(rng.normal(size=(20, 16)) * 300, 100, axis=0))
    centroids = hard_negatives.fit(x, most=20)
    near = hard_negatives._nearest(x, centroids)
    radius = np.array([np.sqrt(((x[near == k] - c) ** 2).sum(axis=1)).max(initial=0) for k, c in enumerate(centroids)])
    lists = hard_negatives.Lists(centroids, np.arange(len(centroids)), np.zeros(len(centroids), int), radius, np.ones(len(centroids), int))
    q = x[::50]
    low, high = lists.bounds(q)
    scores = q @ x.T
    for k in range(len(centroids)):
        if (near == k).any():
            assert (scores[:, near == k] <= high[:, k, None]).all()
            assert (scores[:, near == k] >= low[:, k, None]).all()
    kth = np.sort(scores, axis=1)[:, -6]
    assert (high < kth[:, None]).mean() > 0.5
