import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest

from rollspan.llm import elias_fano, ngram_trie


@pytest.mark.parametrize("top, n", [(1, 1), (10, 50), (10**6, 3000), (2**40, 700), (0, 4)])
def test_elias_fano_against_searchsorted(top, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
    seq = elias_fano.Sequence(elias_fano.encode(values))
    at = np.arange(n)
    assert (seq.access(at) == values).all()
    target = np.concatenate([values, rng.integers(0, top + 2, 500).astype(np.uint64)])
    lo = rng.integers(0, n, len(target))
    hi = np.maximum(lo, rng.integers(0, n + 1, len(target)))
    want = [a + np.searchsorted(values[a:b], t) for t, a, b in zip(target, lo, hi)]
    assert (seq.successor(target, lo, hi) == want).all()


def model(docs):
    toks = [(i, brute.WORD.findall(brute.lower(t or "")) + [None]) for i, t in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c, pairs, ctx, n = (collections.Counter() for _ in range(4))
    for i, words in toks:
        if not held(i):
            c.update(words)
            for u, w in zip(["<"] + words, words):
                n[u] += (u, w) not in pairs
                pairs[u, w] += 1
                ctx[u] += 1
    total, size = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (total + 0.1 * (size + 1))

    def p(u, w):
        if not ctx[u]:
            return p1(w)
        return max(pairs[u, w] - 0.75, 0) / ctx[u] + 0.75 * n[u] / ctx[u] * p1(w)

    return [
        (i, held(i), len(words), sum(c[w] > 0 for w in words), total,
         sum(math.log10(p1(w)) for w in words),
         sum(math.log10(p(u, w)) for u, w in zip(["<"] + words, words)))
        for i, words in toks
    ]


def compare(got, want):
    got = sorted(map(tuple, got), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) <= w[2] / ngram_trie.STEPS + 1e-6


def test_scores_against_a_plain_model(table, odd_rows, monkeypatch):
    monkeypatch.setattr(ngram_trie, "HELD_WORDS", 40)
    monkeypatch.setattr(ngram_trie, "RUN_TOKENS", 100)
    rng = random.Random(4)
    words = ["The", "the", "a"] * 20 + [f"w{i}" for i in range(150)]
    docs = [(10 + i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(200)]
    docs += [r for r in odd_rows if r[0] != 4] + [(4, odd_rows[5][1][:20_000])]
    compare(ngram_trie.score_documents(table(docs)).collect(), model(docs))


def test_no_rows_and_no_training_rows(table):
    assert ngram_trie.score_documents(table([])).count() == 0
    docs = [(i, "only held out") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    compare(ngram_trie.score_documents(table(docs)).collect(), model(docs))
