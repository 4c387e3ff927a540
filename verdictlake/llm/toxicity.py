"""Toxic spans and document scores from a linear-chain conditional random field.

Fitting (driver, on a bounded sample of labelled rows, whole texts):

* two thirds of the sample give each word and each word beginning (4 to 6
  letters) the smoothed log-odds of standing in a toxic document;
* in the other third, tokens of toxic documents whose log-odds are high are
  labelled toxic and all others clean. A two-state chain is fitted to these
  labelled tokens; its features are the token's log-odds by word and by beginning,
  in bins. Bins that chance fills appear as often in clean documents and so count
  for little;
* a logistic regression maps sums and maxima of the marginals to the label.

Scoring runs forward-backward over the whole text of every document, many
documents side by side, in one pass without a shuffle.

Defined results: a null text counts as empty; a text without letters has the
score of an empty one; without labels of both classes every score is the share of
toxic labels; rows that repeat a doc_id are scored each for itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, in_arrow, text_or_empty

FOLDS, HELD_OUT = 5, 0
#: Labelled rows of each class that the model is fitted on, at most, and characters of their texts; longer ones are not fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 200_000
PRIOR = 10.0
EDGES = np.array([-1.0, -0.5, 0.3, 0.6, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0])
NEUTRAL = int(np.searchsorted(EDGES, 0.0))
BINS = EDGES.size + 1
LABEL_AT = 1.0
BEGINNINGS = (6, 5, 4)
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Words of the text as it stands, each lower-cased by itself, so that a token's number finds its place in the text."""
    return [w.lower() for w in _TOKEN.findall(text)]


class Lexicon:
    """Log-odds bins of words and of beginnings; what is not in it is neutral."""

    def __init__(self, texts: list[str], toxic: list[int]):
        n = [toxic.count(0), toxic.count(1)]
        words, starts = (Counter(), Counter()), (Counter(), Counter())
        for t, y in zip(texts, toxic, strict=True):
            found = set(tokens(t))
            words[y].update(found)
            starts[y].update({w[:k] for w in found for k in BEGINNINGS if len(w) >= k})
        self.words = self._bins(words, n)
        self.starts = self._bins(starts, n)

    @staticmethod
    def _bins(seen: tuple[Counter, Counter], n: list[int]) -> dict[str, int]:
        base = n[1] / sum(n)
        out = {}
        for key in seen[1].keys() | seen[0].keys():
            a, b = seen[1][key], seen[0][key]
            if a + b > 1:
                p = (a + PRIOR * base) / (a + b + PRIOR)
                k = int(np.searchsorted(EDGES, math.log(p / (1 - p)) - math.log(base / (1 - base))))
                if k != NEUTRAL:
                    out[key] = k
        return out

    def features(self, word: str) -> tuple[int, int]:
        start = NEUTRAL
        for k in BEGINNINGS:
            if len(word) >= k and (found := self.starts.get(word[:k])) is not None and abs(found - NEUTRAL) > abs(start - NEUTRAL):
                start = found
        return self.words.get(word, NEUTRAL), start


class Chain:
    """Two-state chain: emission log-odds for state 1, transition and start weights."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: float):
        self.emission, self.transition, self.start = emission, transition, start

    def posterior(self, odds: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """odds: sequences x places, log-odds of state 1. Marginals of state 1; with pairs, sums of pair marginals.

        Places past a sequence's end are ignored.
        """
        n, size = odds.shape
        move = np.exp(self.transition - self.transition.max())
        boost = np.exp(np.clip(odds, -30, 30))
        ahead = np.zeros((size, n, 2))
        a = np.stack([np.ones(n), np.exp(self.start) * boost[:, 0]], axis=1) if size else None
        for t in range(size):
            if t:
                a = a @ move
                a[:, 1] *= boost[:, t]
            a /= a.sum(axis=1, keepdims=True)
            ahead[t] = a
        out, b = np.zeros((n, size)), np.ones((n, 2))
        both = np.zeros((2, 2))
        for t in range(size - 1, -1, -1):
            inside = (t < lengths)[:, None]
            joint = ahead[t] * b
            joint /= joint.sum(axis=1, keepdims=True)
            out[:, t] = joint[:, 1] * inside[:, 0]
            if t:
                c = b.copy()
                c[:, 1] *= boost[:, t]
                if pairs:
                    x = ahead[t - 1][:, :, None] * move * c[:, None, :]
                    x /= x.sum(axis=(1, 2), keepdims=True)
                    both += (x * inside[:, :, None]).sum(axis=0)
                b = np.where(inside, c @ move.T, 1.0)
                b /= b.sum(axis=1, keepdims=True)
        return (out, both) if pairs else out

    @classmethod
    def fit(cls, words: np.ndarray, starts: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 60, rate: float = 0.3, penalty: float = 1.0) -> Chain:
        """Maximum likelihood with an L2 penalty, by Adam. All arrays: sequences x places."""
        inside = np.arange(words.shape[1]) < lengths[:, None]
        index = [words, BINS + starts]
        size = 2 * BINS + 1 + 4 + 1  # bins, bias, transitions, start
        hard = np.zeros((2, 2))
        np.add.at(hard, (labels[:, :-1][inside[:, 1:]], labels[:, 1:][inside[:, 1:]]), 1)
        x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        x[2 * BINS] = -2.0
        for step in range(1, steps + 1):
            odds = x[index[0]] + x[index[1]] + x[2 * BINS]
            chain = cls(x[: 2 * BINS + 1], x[2 * BINS + 1 : -1].reshape(2, 2), x[-1])
            p, both = chain.posterior(odds, lengths, pairs=True)
            gap = np.where(inside, labels - p, 0.0)
            g = np.zeros(size)
            for i in index:
                g[: 2 * BINS] += np.bincount(i.ravel(), gap.ravel(), minlength=2 * BINS)
            g[2 * BINS], g[2 * BINS + 1 : -1], g[-1] = gap.sum(), (hard - both).ravel(), gap[:, 0].sum()
            g = (g - penalty * x) / max(1.0, labels.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return cls(x[: 2 * BINS + 1], x[2 * BINS + 1 : -1].reshape(2, 2), float(x[-1]))


class ToxicityModel:
    def __init__(self, texts: list[str], toxic: list[int], segment: int = 40):
        self.share = sum(toxic) / max(1, len(toxic))
        self.lexicon = self.chain = None
        self.memo: dict[str, float] = {}
        if len(set(toxic)) < 2:
            return
        part = [i % 3 < 2 for i in range(len(texts))]
        self.lexicon = Lexicon([t for t, p in zip(texts, part) if p], [y for y, p in zip(toxic, part) if p])
        words, starts, labels, lengths = [], [], [], []
        label_bin = int(np.searchsorted(EDGES, LABEL_AT, side="right"))
        for text, y in ((t, y) for t, y, p in zip(texts, toxic, part) if not p):
            f = np.array([self.lexicon.features(w) for w in tokens(text)], np.int64).reshape(-1, 2)
            for a in range(0, len(f), segment):
                piece = f[a : a + segment]
                pad = ((0, segment - len(piece)), (0, 0))
                piece = np.pad(piece, pad, constant_values=NEUTRAL)
                words.append(piece[:, 0])
                starts.append(piece[:, 1])
                labels.append(((piece.max(axis=1) >= label_bin) & bool(y)).astype(np.int64))
                lengths.append(min(segment, len(f) - a))
        if not words:
            self.lexicon = None
            return
        self.chain = Chain.fit(np.array(words), np.array(starts), np.array(labels), np.array(lengths))
        rows = [i for i, p in enumerate(part) if not p]
        x = np.stack([self.summary(p) for p in self.marginals([texts[i] for i in rows])])
        self.top = _logistic(x, np.array([toxic[i] for i in rows], float), self.share)
        self.memo = {}

    def odds(self, words: list[str]) -> np.ndarray:
        """Emission log-odds of each token, remembered by word."""
        memo = self.memo
        out = [memo.get(w) for w in words]
        if None in out:
            w = self.chain.emission
            if len(memo) > 400_000:
                memo.clear()
            for word in {x for x, o in zip(words, out) if o is None}:
                a, b = self.lexicon.features(word)
                memo[word] = float(w[a] + w[BINS + b] + w[2 * BINS])
            out = [o if o is not None else memo[x] for x, o in zip(words, out)]
        return np.array(out, np.float64)

    def marginals(self, texts: list[str], side_by_side: int = 256) -> list[np.ndarray]:
        odds = [self.odds(tokens(t)) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: odds[i].size)
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        a = 0
        while a < len(order):
            b = min(len(order), a + side_by_side)
            while b > a + 1 and odds[order[b - 1]].size * (b - a) > 2_000_000:  # long texts: fewer at once
                b -= max(1, (b - a) // 2)
            rows = order[a:b]
            lengths = np.array([odds[i].size for i in rows])
            block = np.zeros((len(rows), lengths[-1]))
            for r, i in enumerate(rows):
                block[r, : lengths[r]] = odds[i]
            p = self.chain.posterior(block, lengths)
            for r, i in enumerate(rows):
                out[i] = p[r, : lengths[r]]
            a = b
        return out

    @staticmethod
    def summary(p: np.ndarray) -> np.ndarray:
        """Of the marginals: what is above a half, the largest, the sum of the two largest, and their density."""
        if not p.size:
            return np.zeros(4)
        strong = p[p > 0.5].sum()
        two = np.sort(p)[-2:].sum()
        return np.array([math.log1p(strong), p.max(), two, math.log1p(1000 * strong / (p.size + 20))])

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.chain is None:
            return np.full(len(texts), self.share), [np.zeros(0)] * len(texts)
        p = self.marginals(texts)
        x = np.stack([self.summary(q) for q in p]) if p else np.zeros((0, 4))
        w, mean, scale = self.top
        return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[1:] + w[0], -30, 30))), p


def _logistic(x: np.ndarray, y: np.ndarray, share: float, steps: int = 50):
    """Newton steps with an L2 penalty; classes weigh alike. Weights (bias first), mean, scale."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, weight = np.zeros(z.shape[1]), np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    ridge = np.diag([1e-6] + [0.5] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        w = w + np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ w)
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    known = labels.where((fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, F.lit(sample_rows / max(1, counts.get(1, 0)))).otherwise(F.lit(sample_rows / max(1, counts.get(0, 0))))
    # at most about 2 * sample_rows ids
    picked = known.where(place < share)
    rows = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id")
    # of rows that repeat a doc_id one text
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).toArrow().sort_by([("doc_id", "ascending")])
    return ToxicityModel(rows["text"].to_pylist(), [int(y) for y in rows["toxic"].to_pylist()])


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                texts = part.column(2).to_pylist()
                scores, p = model.score(texts)
                spans = []
                for text, q in zip(texts, p, strict=True):
                    hot = set(np.flatnonzero(q > 0.5).tolist())
                    spans.append([x for i, m in enumerate(_TOKEN.finditer(text)) if i in hot for x in m.span()] if hot else [])
                cols = [part.column(0), part.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "offsets"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, offsets (begin and end of each toxic token, in characters)."""
    model = model or fit(docs, labels, sample_rows)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return in_arrow(d, _score(model), "doc_id long, held_out boolean, score double, predicted int, offsets array<int>")
