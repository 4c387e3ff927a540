"""Every query against its SQL, and the rest against plain Python."""

import hashlib
import random
from collections import Counter
from fractions import Fraction
from itertools import accumulate
from math import comb

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdictlake.plans import catalog
from verdictlake.sources.fixtures import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    def one(x):
        if pd.isna(x):
            return "null"
        return str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool_" else f"{float(x):.6f}" if type(x).__name__ not in ("Timestamp", "str") else str(x)

    out = df[cols].astype(object)
    for c in cols:
        out[c] = out[c].map(one)
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got, cols), normal(want, cols))


def plain_kappa(sample):
    n = len(sample)
    same = sum(t == p for t, p in sample) / n
    chance = sum((sum(t == x for t, _ in sample) / n) * (sum(p == x for _, p in sample) / n) for x in ("approve", "reject"))
    return (1.0 if same == 1.0 else 0.0) if chance == 1.0 else (same - chance) / (1 - chance)


def test_bootstrap_exact_is_the_plain_loop(spark, sf):
    for backend in ("m0", "m3"):
        items = catalog.items(spark, sf).where(F.col("backend") == backend).orderBy("pos").collect()
        data, draw = [(r["truth"], r["predicted"]) for r in items], random.Random(20260806)
        found = sorted(plain_kappa([data[draw.randrange(len(data))] for _ in data]) for _ in range(1000))
        row = catalog.QUERIES["bootstrap_exact_ci"](spark, sf).where(F.col("backend") == backend).first()
        assert (row["lo"], row["hi"]) == pytest.approx((found[25], found[975]))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_words_of_the_twister_are_randrange(n):
    draw, got = random.Random(5), np.concatenate([x for x, _ in zip(catalog.bootstrap._below(n, 5, 700), range(4))])
    assert got.tolist() == [draw.randrange(n) for _ in range(got.size)]


def plain_resamples(counts, resamples, seed=20260806):
    """Multinomial numbers of the counts, value by value and bit by bit, from tables of exact binomials."""
    n, out = sum(counts), []
    tables = {}
    for r in range(resamples):
        left, of, drawn = n, n, []
        for k, c in enumerate(counts, 1):
            x = 0
            for j in range(n.bit_length()):
                u = int(hashlib.md5(f"{seed}|{r}|{k}|{j}".encode()).hexdigest()[:13], 16) / 2**52
                if (k, j) not in tables:
                    p = Fraction(c, of)
                    pmf = [comb(1 << j, x) * p**x * (1 - p) ** ((1 << j) - x) for x in range((1 << j) + 1)]
                    tables[k, j] = [float(v) for v in accumulate(pmf)]
                if left >> j & 1:
                    x += sum(edge <= u for edge in tables[k, j][:-1])
            drawn.append(x)
            left, of = left - x, of - c
        out.append(drawn)
    return out


def test_resamples_are_those_of_exact_tables(spark):
    """Against binomials in fractions; also where one value is all there is."""
    counts = {"a": [3, 40, 1, 60], "b": [5], "c": [1, 1]}
    items = spark.createDataFrame([(b, x) for b, cs in counts.items() for x, c in enumerate(cs) for _ in range(c)], "backend string, x int").repartition(3)
    rows = catalog.bootstrap.resampled(items, ["x"], 60).collect()
    for b, cs in counts.items():
        got = {r.r: list(r.drawn) for r in rows if r.backend == b}
        assert [got[r] for r in range(60)] == plain_resamples(cs, 60)
    assert all(sum(r.drawn) == r.n for r in rows)


def test_resamples_are_multinomial(spark):
    """Means and spreads of 3,000 resamples of a million items, of which 20 are of one value."""
    counts = np.array([20, 300_000, 699_980])
    items = spark.range(int(counts.sum())).select(F.lit("a").alias("backend"), F.when(F.col("id") < 20, 0).when(F.col("id") < 300_020, 1).otherwise(2).alias("x"))
    drawn = np.array([r.drawn for r in catalog.bootstrap.resampled(items, ["x"], 3000, seed=3).collect()])
    n, p = counts.sum(), counts / counts.sum()
    assert (drawn.sum(axis=1) == n).all()
    assert np.abs(drawn.mean(axis=0) - counts).max() < 4 * np.sqrt(n * p * (1 - p) / 3000).max()
    assert drawn.var(axis=0) == pytest.approx(n * p * (1 - p), rel=0.12)
    assert np.corrcoef(drawn[:, 1], drawn[:, 2])[0, 1] == pytest.approx(-1, abs=0.01)


def test_bootstraps_take_every_judged_pair_and_1000_resamples(spark, sf):
    judged = catalog.QUERIES["score_models"](spark, sf).where("n > 0").collect()
    items = catalog.items(spark, sf).collect()
    assert {r.backend: r.n for r in judged} == Counter(r.backend for r in items)
    assert catalog.items(spark, "/root/testdata/sf0.01").where("pos >= 200").count() > 0
    got = {r.backend: (r.lo, r.hi) for r in catalog.QUERIES["bootstrap_kappa_ci"](spark, sf).collect()}
    exact = {r.backend: (r.lo, r.hi) for r in catalog.QUERIES["bootstrap_exact_ci"](spark, sf).collect()}
    assert got.keys() == exact.keys()
    for b, ends in exact.items():
        assert got[b] == pytest.approx(ends, abs=0.15 * (ends[1] - ends[0]) + 1e-9)
    known = [("approve", "approve"), ("approve", "reject"), ("reject", "approve"), ("reject", "reject")]
    data = Counter((r.truth, r.predicted) for r in items if r.backend == "m0")
    cells = [c for c in known if data[c]]
    found = sorted(plain_kappa([c for c, k in zip(cells, drawn) for _ in range(k)]) for drawn in plain_resamples([data[c] for c in cells], 1000))
    assert got["m0"] == pytest.approx((found[25], found[975]), abs=1e-6)
    assert {r.backend: (r.lo, r.hi) for r in catalog.QUERIES["separability_tiers"](spark, sf).collect()} == got


def test_bootstrap_of_any_statistic(spark):
    """A mean of known spread: the interval is the normal one, and the seed repeats it."""
    rng = random.Random(1)
    rows = [("a", rng.choice([0, 1, 2, 5])) for _ in range(4000)] + [("b", 3)] * 10
    items = spark.createDataFrame(rows, "backend string, x int")
    mean = lambda values, counts: float(sum(v[0] * c for v, c in zip(values, counts)) / counts.sum())
    got = {r.backend: (r.lo, r.hi) for r in catalog.bootstrap.bootstrap_ci(items, ["x"], mean).collect()}
    x = [v for b, v in rows if b == "a"]
    m, half = np.mean(x), 1.96 * np.std(x) / len(x) ** 0.5
    assert got["b"] == (3.0, 3.0) and got["a"] == pytest.approx((m - half, m + half), abs=0.15 * half)
    assert got == {r.backend: (r.lo, r.hi) for r in catalog.bootstrap.bootstrap_ci(items.repartition(5), ["x"], mean).collect()}
    kappas = {r.backend: (r.lo, r.hi) for r in catalog.bootstrap.bootstrap_kappa(items.withColumns({"truth": F.lit("approve"), "predicted": F.when(F.col("x") > 1, "reject").otherwise("approve")})).collect()}
    assert kappas["b"] == (0.0, 0.0)


def test_notes_are_whole(spark, sf):
    last = {}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: r.turn):
        if r.role != "system" and r.turn % 5 != 4 and r.text:
            last[r.conv_id, f"p{len(r.text) % 3}"] = r.text
    got = {(r.session, r.pair_id): r.notes for r in catalog.QUERIES["journal_notes"](spark, sf).collect()}
    assert got == last and max(map(len, got.values())) > 20


def plain_replay(records):
    order, history = [], {}
    for r in records:
        if r["action"] == "rule":
            if r["pair_id"] in order:
                order.remove(r["pair_id"])
            order.append(r["pair_id"])
            history.setdefault(r["pair_id"], []).append((r["ground_truth"], r["reason"]))
        elif r["action"] == "undo" and order:
            pair = order.pop()
            history[pair].pop()
            if history[pair]:
                order.append(pair)
    return [(p, *history[p][-1]) for p in order]


def test_journal_replay_is_the_plain_fold(spark, sf):
    rows = catalog.records(spark, sf).orderBy("session", "seq").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["session"], []).append(r)
    want = {(s, i, *x) for s, rs in by.items() for i, x in enumerate(plain_replay(rs))}
    got = {(r["session"], r["place"], r["pair_id"], r["ground_truth"], r["reason"]) for r in catalog.QUERIES["journal_replay"](spark, sf).collect()}
    assert got == want and len(want) > 10


def test_word_diff_query(spark, sf):
    from verdictlake.functions.text import diff_words

    rows = catalog.QUERIES["word_diff"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count()
    assert diff_words("a b", "a b") == "  (no change)" and diff_words("", "x") == "  - \n  + [x]"
    rng = random.Random(4)

    def blocks(a, b, lo_a=0, lo_b=0):
        """The longest run of both sides, of several the first in a, then in b; the same on either side of it."""
        runs = [(i, j, k) for i in range(len(a)) for j in range(len(b)) for k in range(1, 1 + min(len(a) - i, len(b) - j)) if a[i : i + k] == b[j : j + k]]
        if not runs:
            return []
        i, j, k = min(runs, key=lambda r: (-r[2], r[0], r[1]))
        return [*blocks(a[:i], b[:j], lo_a, lo_b), *[(lo_a + i + x, lo_b + j + x) for x in range(k)], *blocks(a[i + k :], b[j + k :], lo_a + i + k, lo_b + j + k)]

    for _ in range(300):
        a, b = ([rng.choice("aAbBcd") for _ in range(rng.randint(0, 7))] for _ in range(2))
        places = blocks([w.lower() for w in a], [w.lower() for w in b])
        for line, words, kept in zip(diff_words(" ".join(a) + " |", " ".join(b) + " !").splitlines(), (a, b), zip(*places) if places else ((), ())):
            marks = line[4:]
            flat = marks.replace("[", "").replace("]", "").replace("~", "").split()
            assert flat[:-1] == words and "] [" not in marks
            assert [w.strip("~") for part in marks.split("[") for w in part.split("]")[-1].split()] == [words[i] for i in kept]
    long = [str(rng.randint(0, 5_000)) for _ in range(20_000)]
    changed = [w if i % 50 else "new" for i, w in enumerate(long)]
    assert diff_words(" ".join(long), " ".join(changed)).splitlines()[1].count("[new]") == 400
    assert diff_words("red SHOE box", "Red shoe crate") == "  - ~red~ ~SHOE~ [box]\n  + ~Red~ ~shoe~ [crate]"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
