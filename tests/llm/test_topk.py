"""Top-k against all inner products."""

import math
import random

import numpy as np

from cwescope.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        for dim in {len(v) for i, v in good if i == q}:
            own = min(v for i, v in good if i == q and len(v) == dim)
            hits = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == dim)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = random.Random(1)
    hot = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(1, 330)]
    rows += [(400, None), (None, hot), (420, []), (440, [1.0, None, 2.0, 0.0, 0.0, 0.0]),
             (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, [0.0] * 6), (520, [0.25] * 3),
             (521, [0.5] * 3), (40, hot), (40, hot), (41, hot), (7, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == brute(rows, 20)


def test_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([(20, [0.5, 0.5], 1), (21, [1.0, -1.0], 2)], "vec_id long, embedding array<float>, dim int")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(20, 1, 21, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.choice([2e7, -1e7, 2.5, 0.25]) * rng.random())) for _ in range(3)])
            for i in range(1, 90)] + [(100, [2e7, 1.0, 0.0]), (101, [6.0, 1.5e7, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == brute(rows, 20)
