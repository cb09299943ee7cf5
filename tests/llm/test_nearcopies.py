"""Classes against all pairs; the signature against exact similarity."""

import random
from collections import Counter

import numpy as np

from cwescope.llm import nearcopies as nc


def lower(w):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


def bag(text):
    w = [lower(x.decode()) for x in (text or "").encode().split()]
    if not w:
        return Counter()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows, least):
    rank = [nc.LAST_ID if i is None else i for i, _ in rows]
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= least - 1e-12:
                root[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        ids[find(i)] = min(ids.get(find(i), rank[i]), rank[i])
    out = []
    for i, (d, _) in enumerate(rows):
        c = ids[find(i)]
        out.append((d, (None if c == nc.LAST_ID else c) if bags[i] else d))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)] + ["É", "Nine", "x\x1cy"]
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, ""), (3, " \n"), (4, "Hi there"), (5, "hi THERE"),
            (6, "hi there you"), (7, "x " * 300), (8, "x " * 250), (9, "x " * 100), (9, "other text of some words"),
            (10, "A B c d E f")]
    at = 100
    for n in (8, 20, 60, 200, 700):
        for _ in range(6):
            base = rng.choices(vocab, k=n)
            for _ in range(rng.randint(1, 8)):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 2, n // 40])):
                    w[rng.randrange(n)] = rng.choice(vocab)
                rows.append((at, " ".join(w)))
                at += 1
    chain = rng.choices(vocab, k=200)  # each like the one before it
    for k in range(30):
        rows.append((at + k, " ".join(chain[4 * k:] + rng.choices(vocab, k=0) + chain[:4 * k])))
    return rows


def test_classes(spark, monkeypatch):
    monkeypatch.setattr(nc, "FEW", 1)
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, nc.MIN_SIMILARITY)
    found = nc.near_report(df).collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == want
    kept = nc.keep_one(df.selectExpr("*", "doc_id as node", "'z' as lang")).collect()
    classes = {c for d, c in want if d not in (1, 2, 3)}
    assert len(kept) == len(classes) + 3 + 1  # two classes have the repeated id 9
    assert {r.doc_id for r in kept} >= {1, 2, 3} and set(kept[0].asDict()) == {"doc_id", "text", "node", "lang"}


def test_signature_is_unbiased_for_weights():
    rng = np.random.default_rng(2)
    m, pairs = 4000, []
    for _ in range(6):
        elements = rng.integers(0, 2**48, 30).astype(np.uint64)
        pairs.append((elements, rng.integers(0, 12, 30), rng.integers(0, 12, 30)))
    pairs.append((np.arange(1, dtype=np.uint64), np.array([300]), np.array([200])))
    for elements, a, b in pairs:
        doc = np.repeat([0, 1], [len(a), len(b)])
        weight, element = np.concatenate([a, b]), np.concatenate([elements, elements])
        on = weight > 0
        first = nc.bag_min_hash(doc[on], element[on], weight[on], 2, m)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert np.isfinite(first).all()
        assert abs((first[0] == first[1]).mean() - want) < 5 * (0.25 / m) ** 0.5


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.class_id) for r in nc.near_report(docs).collect()), key=str)
    assert got == brute(rows, nc.MIN_SIMILARITY)
    assert nc.near_report(docs.limit(0)).count() == 0


def test_slices_of_a_batch_give_the_same_words():
    import pyarrow as pa

    rng = random.Random(1)
    texts = pa.array([" ".join(rng.choices([f"W{i}" for i in range(50)], k=rng.choice([0, 1, 3, 8, 40])))
                      for _ in range(300)] + [None])
    _, doc, values, _ = nc.shingles(texts)
    for lo in range(0, 301, 43):
        part = texts.slice(lo, 43)
        _, d, v, _ = nc.shingles(part)
        for k in range(len(part)):
            assert sorted(values[doc == lo + k].tolist()) == sorted(v[d == k].tolist())
