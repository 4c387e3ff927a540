"""Properties over generated votes."""

from collections import Counter, defaultdict

import pytest

from verdictlake.operators.score import cohens_kappa
from verdictlake.operators.tally import tally
from verdictlake.schema import REASONS, VERDICTS


def generated(seed: int, n: int = 400) -> list[tuple]:
    import random

    r = random.Random(seed)
    return [(r.choice("abc"), f"p{r.randrange(40)}", i, r.choice(VERDICTS), r.choice(REASONS)) for i in range(n)]


def settled(values: list[str]) -> tuple[str | None, float]:
    counts = Counter(values)
    most = max(counts.values())
    top = [v for v, c in counts.items() if c == most]
    return (top[0] if len(top) == 1 else None), 1 - most / len(values)


@pytest.mark.parametrize("seed", range(5))
def test_tally_equals_plain_counting(spark, seed):
    rows = generated(seed)
    by = defaultdict(list)
    for b, p, _, v, r in rows:
        by[b, p].append((v, r))
    got = {(x.backend, x.pair_id): x for x in tally(spark.createDataFrame(rows, "backend string, pair_id string, run_index long, verdict string, reason string").repartition(seed + 1)).collect()}
    assert set(got) == set(by)
    for k, votes in by.items():
        (v, vf), (r, rf) = (settled([x[i] for x in votes]) for i in (0, 1))
        x = got[k]
        assert (x.n_votes, x.verdict, x.reason) == (len(votes), v, r)
        assert (x.verdict_flip_rate, x.reason_flip_rate) == pytest.approx((vf, rf))


@pytest.mark.parametrize("seed", range(5))
def test_kappa_equals_the_formula(spark, seed):
    rows = [(v, VERDICTS[i % 2] if i % 3 else v) for i, (_, _, _, v, _) in enumerate(generated(seed))]
    n = len(rows)
    same = sum(a == b for a, b in rows) / n
    chance = sum(sum(a == x for a, _ in rows) * sum(b == x for _, b in rows) for x in VERDICTS) / n**2
    assert cohens_kappa(spark.createDataFrame(rows, "t string, p string"), "t", "p").first().kappa == pytest.approx((same - chance) / (1 - chance))
