"""Language identification in two levels: family first, then one-versus-one linear SVMs.

Features are hashed n-grams of 1 to 3 UTF-8 bytes of the lower-cased text, with
everything but letters folded to one blank, as shares of all n-grams. A linear
support vector machine for each pair of families votes on the family; one for
each pair of languages of that family votes on the language. Scoring is one pass
without a shuffle: weights are gathered per n-gram and summed per document.

The machines are fitted on the driver, on at most `sample_rows` labelled rows of up to
SAMPLE_CHARS characters (about equally many of each language, taken by a hash of the
id; whole texts). At most MOST_LANGS languages are learned, those with most rows; where
more than FAMILY_SIZE of them are of no known family, families of FAMILY_SIZE are made of
those in the order of their codes. So neither the sample nor the number of machines grows
with what `lang` holds.

Defined results: a null text or one without a letter is `und` with score 0; with
no labelled row at all every text is `und`; repeated rows get equal results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, in_arrow

# Language families.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "nb", "nn", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "pa", "ur"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

DIM = 1 << 12
SAMPLE_ROWS, SAMPLE_CHARS = 2400, 200_000
MOST_LANGS, FAMILY_SIZE = 100, 8
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram of all texts, one after another, and where each text begins (and the last ends)."""
    parts = [b"  " + _NOT_LETTERS.sub(" ", t.lower()).strip().encode("utf-8", "replace") + b"  " for t in texts]
    at = np.cumsum([0] + [len(p) for p in parts])
    b = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    one, two = b[:-2], b[:-2] << np.uint32(8) | b[1:-1]
    three = two << np.uint32(8) | b[2:]
    mix = np.uint32(0x9E3779B1)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    # three features for each byte; two blanks begin and end each text, so that its last n-grams are the same whatever text follows
    grams = np.stack([one * mix >> shift, (two + np.uint32(0x10000000)) * mix >> shift, (three + np.uint32(0x20000000)) * mix >> shift], axis=1)
    return grams, at


def shares(texts: list[str]) -> np.ndarray:
    """Texts x DIM, roots of the shares of each feature."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        grams, _ = ngrams([t])
        out[i] = np.bincount(grams.ravel(), minlength=DIM) / grams.size
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 200.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and L2 penalty, by accelerated gradient steps. y: -1 or 1."""
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-12)).astype(np.float32)  # frequent n-grams must not drown the others
    scale = np.maximum(scale, np.median(scale[scale > 2e-6]) if (scale > 2e-6).any() else 1)
    z = (x - x.mean(axis=0)) / scale
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), 0.0
    lip = 1 / c + 2 * float((weight * ((z * z).sum(axis=1) + 1)).sum())
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v + vb))
        g = -2 * weight * y * slack
        w2, b2 = v - (z.T @ g + v / c) / lip, vb - float(g.sum()) / lip
        beta = k / (k + 3)
        v, vb = w2 + beta * (w2 - w), b2 + beta * (b2 - b)
        w, b = w2, b2
    w = w / scale
    return w, float(b - x.mean(axis=0) @ w)


def families_of(langs: set[str]) -> dict[str, str]:
    """Family of each language; one of no known family is its own, unless there are many."""
    others = sorted(x for x in langs if x not in FAMILY_OF)
    few = len(others) <= FAMILY_SIZE
    return {x: FAMILY_OF[x] for x in langs if x in FAMILY_OF} | {x: f"only {x}" if few else f"others {i // FAMILY_SIZE:03d}" for i, x in enumerate(others)}


@dataclass
class LanguageModel:
    """pairs: (group, negative class, positive class); weights: DIM x pairs. group is "" for families."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> LanguageModel:
        families: dict[str, list[str]] = {}
        family_of = families_of(set(langs))
        for lang in sorted(set(langs)):
            families.setdefault(family_of[lang], []).append(lang)
        family = np.array([family_of[x] for x in langs], dtype=object)
        lang = np.array(langs, dtype=object)
        names = sorted(families)
        pairs = [("", a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        pairs += [(f, a, b) for f in names for i, a in enumerate(families[f]) for b in families[f][i + 1 :]]
        x = shares(texts)
        weights, bias = np.zeros((DIM, len(pairs)), np.float32), np.zeros(len(pairs), np.float32)
        for k, (group, a, b) in enumerate(pairs):
            of = lang if group else family
            rows = np.flatnonzero((of == a) | (of == b))
            weights[:, k], bias[k] = fit_svm(x[rows], np.where(of[rows] == b, 1.0, -1.0).astype(np.float32))
        return cls(families, pairs, weights, bias)

    def margins(self, texts: list[str]) -> np.ndarray:
        grams, at = ngrams(texts)
        out = np.zeros((len(texts), len(self.pairs)), np.float64)
        for k in range(len(self.pairs)):
            w = self.weights[:, k]
            per_byte = w[grams[:, 0]] + w[grams[:, 1]]
            per_byte += w[grams[:, 2]]
            out[:, k] = np.add.reduceat(per_byte.astype(np.float64), at[:-1]) if len(texts) else 0
        return out / (3 * np.maximum(1, np.diff(at)))[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score: the product of the family's and the language's weakest winning chance."""
        chance = 1 / (1 + np.exp(-np.clip(2 * self.margins(texts), -30, 30)))
        langs, scores = [], np.zeros(len(texts))
        for i in range(len(texts)):
            family, s = self._vote("", sorted(self.families), chance[i])
            lang, t = self._vote(family, self.families[family], chance[i])
            langs.append(lang)
            scores[i] = s * t
        return langs, scores

    def _vote(self, group: str, among: list[str], chance: np.ndarray) -> tuple[str, float]:
        votes = {c: [0, 0.0, 1.0] for c in among}  # wins, sum and least of the winning chances
        for k, (g, a, b) in enumerate(self.pairs):
            if g == group:
                for c, p in ((a, 1 - chance[k]), (b, chance[k])):
                    votes[c][0] += p > 0.5
                    votes[c][1] += p
                    votes[c][2] = min(votes[c][2], p)
        best = max(among, key=lambda c: (votes[c][0], votes[c][1]))
        return best, float(votes[best][2])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on labelled rows outside the held-out fold; None if there are none."""
    rows = docs.where((fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike(r"\p{L}"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(MOST_LANGS, sample_rows))
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return None
    each = sample_rows // len(counts)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.15 * each / n))).otherwise(share)
    place = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    held = rows.where(place < share).select("doc_id", "text", "lang").toArrow().sort_by([("doc_id", "ascending")])
    texts, langs, seen = [], [], dict.fromkeys(counts, 0)
    for text, lang in zip(held["text"].to_pylist(), held["lang"].to_pylist(), strict=True):
        if seen[lang] < each:
            seen[lang] += 1
            texts.append(text)
            langs.append(lang)
    return LanguageModel.fit(texts, langs) if texts else None


def _score(model: LanguageModel | None):
    letter = re.compile(r"[^\W\d_]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).to_pylist()
                known = [i for i, t in enumerate(texts) if model and t is not None and letter.search(t) and any(map(str.isalpha, t))]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    for i, lang, s in zip(known, *model.predict([texts[i] for i in known]), strict=True):
                        langs[i], scores[i] = lang, s
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = model or fit(docs, sample_rows)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return in_arrow(d, _score(model), "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, whose text gets a language; in one pass over the rows.

    Where no labelled row allows a model, a text with a letter stays: nothing speaks against it.
    """
    model = fit(docs, **how)
    schema, at = docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for a in range(0, batch.num_rows, 500):
                texts = batch.column(at).slice(a, 500).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
                found = model.predict([texts[i] for i in known])[0] if known and model else [""] * len(known)
                langs = dict(zip(known, found, strict=True))
                mask += [langs.get(i, UNKNOWN) != UNKNOWN for i in range(len(texts))]
            if any(mask):
                yield batch.filter(pa.array(mask, pa.bool_()))

    return in_arrow(docs, keep, schema)
