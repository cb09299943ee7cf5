"""Vector codes against plain nearest entries, and the SQL form."""

import hashlib
import math
import random

import numpy as np
import pytest

from cwescope.llm import codes
from cwescope.plans.check import compare, duck

INF = float("inf")


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error, digest) in plain Python integers."""
    kept = [(i, lab, [math.floor(scale * x) if abs(x) < 2 ** 52 else int(x) * scale for x in v]) for i, v, lab in rows
            if v is not None and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for *_, v in kept}:
        own = [r for r in kept if len(r[2]) == dim]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        d = dim // parts
        cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for *_, v in own]
        book = [[c[p] for c in cut[:entries]] for p in range(parts)]

        def assign(book=book, cut=cut):
            return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(book[p]))
                     for p in range(parts)] for c in cut]

        for _ in range(rounds):
            got = assign()
            for p in range(parts):
                for k in range(len(book[p])):
                    mine = [c[p] for c, g in zip(cut, got) if g[p][1] == k]
                    if mine:
                        book[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
        digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
        out += [(i, lab, "".join(f"{k:02x}" for _, k in g), min(sum(f for f, _ in g), 2 ** 63 - 1), digest)
                for (i, lab, _), g in zip(own, assign())]
    sums = {}
    for _, lab, _, e, _ in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, min(sums[lab], 2 ** 63 - 1), h) for i, lab, c, e, h in out), key=str)


def run(spark, rows, kind="float", extra=""):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int{extra}").repartition(3)
    return sorted((tuple(r) for r in codes.code_report(df).collect()), key=str)


def test_nearest_entries():
    rng = np.random.default_rng(1)
    for d in (1, 3, 4):
        points, entries = rng.integers(-4, 5, (300, d)), rng.integers(-4, 5, (20, d))
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = codes.nearest(points, entries)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_against_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_BYTES", 32 * 8 * 7)
    rng = random.Random(2)
    hot = [rng.uniform(-1, 1) for _ in range(32)]
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(32)], None if i % 4 else i % 5)
            for i in range(150)]
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [INF] * 32, 1), (503, [float("nan")] * 32, 1),
             (7, [0.5] * 32, 1), (7, [0.5] * 32, 1), (7, [0.25] * 32, 2), (None, [0.125] * 32, 2),
             (504, [0.5] * 31, 1), (505, [0.5] * 16, 1), (506, [0.75] * 16, 3), (507, [], 3)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(codes, "BROADCAST_BYTES", -1)
    assert run(spark, rows) == want


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.choice([1e8, -3e10, 2.5, 1e25, 3e38]) * rng.random())) for _ in range(16)], i % 3)
            for i in range(90)]
    assert run(spark, rows) == brute(rows)
    wide = [(i, [rng.choice([1e300, 1.7e308, -2.0, 1e15 + 0.25]) for _ in range(16)], 0) for i in range(70)]
    assert run(spark, wide, "double") == brute(wide)


def test_few_rows_other_columns_and_no_rows(spark):
    rows = [(3, [0.5] * 16, None, 9, "a"), (1, [0.25] * 16, None, 9, "b")]
    extra = ", dim int, code string"
    assert [r[:3] for r in run(spark, rows, extra=extra)] == [(1, "00" * 16, 0), (3, "01" * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + extra).limit(0)
    assert codes.code_report(df).count() == 0


@pytest.mark.parametrize("name", ["/root/testdata/sf0.001"])
def test_sql(spark, name):
    df = codes.code_report(spark.read.parquet(f"{name}/embeddings.parquet"))
    assert not compare(df, duck(name), codes.ORACLE)
