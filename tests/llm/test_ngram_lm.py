"""Scores against the smoothing formula; lists against sorted arrays."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cwescope.llm import ngram_lm as lm
from cwescope.llm.eliasfano import BigramTrie, EliasFano


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return lower.encode().split() + [None]


def brute(rows):
    """Unquantised scores."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for h, (_, t) in zip(held, rows):
        if not h:
            w = tokens(t)
            one.update(w)
            two.update(zip([None] + w, w))
    n, v = sum(one.values()), len(one)

    def p(w):
        return (one[w] + 0.5) / (n + 0.5 * (v + 1))

    out = []
    for h, (i, t) in zip(held, rows):
        w = tokens(t)
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((two[a, b] + lm.MU * p(b)) / (one[a] + lm.MU)) for a, b in zip([None] + w, w))
        out.append((i, h, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def check(spark, rows, got):
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    got = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
        assert abs(g[6] - w[6]) <= 0.05 * w[2] + 1e-6  # quantisation
    assert sum(abs(g[6] - w[6]) for g, w in zip(got, want)) <= 0.02 * sum(w[2] for w in want)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_WORDS", 200)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 100)
    rng = random.Random(6)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["É", "Up", "the"] * 40
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, k=rng.choice([1, 3, 30, 200]))))
            for i in range(200)]
    rows += [(None, "a b"), (900, None), (901, ""), (902, " \n"), (903, "the " * 3000), (904, "x\x1cy z"),
             (7, "the the"), (7, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(spark, rows, lm.score(df).collect())


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = lm.score(docs).collect()
    check(spark, rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(docs.limit(0)).count() == 0


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (5, 3), (1000, 10), (1000, 10**6), (3000, 10**15)):
        x = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano.build(x)
        assert (e.access(np.arange(n)) == x.astype(np.uint64)).all()
        q = np.concatenate([x, rng.integers(0, top + 2, 300), x + 1, [0, top * 3 + 7]])
        assert (e.find(q) == np.searchsorted(x, q)).all()
    key = np.unique(rng.integers(0, 300, 9000) * 1000 + rng.integers(0, 900, 9000))
    p = -7 * rng.random(len(key))
    trie = BigramTrie(key // 1000, key % 1000, p, str(tmp_path))
    asked = np.arange(0, 310_000)
    got = trie.query(np.arange(310), np.full(310, 1000), asked % 1000)
    assert (np.flatnonzero(~np.isnan(got)) == key).all()
    assert np.abs(got[key] - p).max() <= 7 / 255 / 2 + 1e-9
