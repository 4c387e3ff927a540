"""Properties over generated inputs, without Spark where none is needed."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from verdictlake.llm import packing, simhash_dedup, suffix_dedup
from verdictlake.llm.exact_dedup import CountingQuotientFilter


@given(st.lists(st.integers(0, (1 << 54) - 1), min_size=1, max_size=200), st.lists(st.integers(0, 50), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_filters_merge_without_loss(a, b):
    parts = [np.unique(np.array(x, np.uint64), return_counts=True) for x in (a, b, a)]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.load(CountingQuotientFilter.of(f, c, 54).dump()) for f, c in parts])
    whole = {}
    for f, c in parts:
        for x, n in zip(f.tolist(), c.tolist()):
            whole[x] = whole.get(x, 0) + n
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist())) == whole


@given(st.integers(1, 1 << 20), st.integers(0, 12))
@settings(deadline=None)
def test_pieces_are_powers_of_two(n, bits):
    pieces = packing.binary_lengths(n, 1 << bits)
    assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 1 << bits for p in pieces)
    assert len([p for p in pieces if p < 1 << bits]) <= bits


@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=4))
@settings(max_examples=300, deadline=None)
def test_some_mask_hides_any_four_bits(x, places):
    y = x ^ sum(1 << p for p in places)
    assert any((x & m) == (y & m) for m in simhash_dedup.covering_masks())


@given(st.lists(st.text("ab", min_size=20, max_size=60), min_size=2, max_size=8), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_corpus_order_finds_equal_strings(texts, before):
    """Entries that share a core: every string of each, against all strings of the others."""
    match, core = 16, "abba" * 3
    lead = np.array([before + i % 3 for i in range(len(texts))])
    n = np.array([1 + i % (before + 1) for i in range(len(texts))])
    parts = [(t[:k].ljust(k, "a") + core + t + "b" * 40)[: k + 30].encode() for t, k in zip(texts, lead.tolist())]
    arrays = [np.frombuffer(p, np.uint8) for p in parts]
    got = suffix_dedup.equal_strings(np.zeros(len(texts), np.int64), arrays, lead, n, match)
    doc = np.array([i % 2 if i else -1 for i in range(len(texts))])
    across = suffix_dedup.equal_strings(np.zeros(len(texts), np.int64), arrays, lead, n, match, doc)
    low = int((lead - n + 1).min())
    own = [{x: p[k - x : k - x + match] for x in range(k - m + 1, k + 1)} for p, k, m in zip(parts, lead.tolist(), n.tolist())]
    for i, strings in enumerate(own):
        for x, s in strings.items():
            assert got[i, x - low] == any(o.get(x) == s for j, o in enumerate(own) if j != i)
            docs = {doc[j] for j, o in enumerate(own) if o.get(x) == s}
            assert not got[i, x - low] or across[i, x - low] == (len(docs) > 1 or -1 in docs)


@given(st.lists(st.integers(-5, 50), min_size=1, max_size=80), st.data())
@settings(deadline=None)
def test_range_least(values, data):
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a + 1, len(values)))
    assert suffix_dedup.RangeLeast(np.array(values)).of(np.array([a]), np.array([b]))[0] == min(values[a:b])
