"""Targets, takes and positions against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from cwescope.llm import mixing


def fair_targets(sizes, extra=1.5, most=2):
    """Reshare by weight, round by round, until no target is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = extra * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return target


def documents(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))),
             rng.choice(["b", "a", "a", "a", "é", "Z", None, "zz"])) for i in range(700)]
    rows += [(900, None, "a"), (None, "x y z", "b"), (5, "twin words", "a"), (5, "twin words", "a"), (6, "", "empty")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_report(spark):
    rows, df = documents(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fair_targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: int(t + 1e-9) for s, t in want.items()}
    again = mixing.mix_report(df.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    places = [r.position for r in again if r.position is not None]
    assert places == sorted(places)


def test_positions_follow_the_integrated_weights(spark):
    rows = [(i, "w " * 20, s) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    uses = mixing.mix(df).select("place", "target", F.explode("uses").alias("u")).collect()
    for place, knots in enumerate(mixing.SCHEDULES):
        own = [u for u in uses if u.place == place]
        for t in (0.2, 0.5, 0.8):
            got = sum(u.u.words for u in own if u.u.position <= t) / own[0].target
            steps = 2000
            area = total = 0.0
            for i in range(steps):
                x = (i + 0.5) / steps
                (t0, w0), (t1, w1) = next((a, b) for a, b in zip(knots, knots[1:]) if a[0] <= x <= b[0])
                w = w0 + (w1 - w0) * (x - t0) / (t1 - t0)
                total += w
                area += w if x <= t else 0
            assert got == pytest.approx(area / total, abs=0.02)


def test_rows_of_the_mix(spark):
    rows, df = documents(spark)
    out = mixing.mixed_rows(df.withColumn("size", F.lit("clash"))).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert sum(r.words for r in out) == sum(r.taken for r in mixing.mix(df).collect())
    assert all(0 < r.words <= len(r.text.split()) and r.size == "clash" for r in out)
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed_rows(df.withColumn("epoch", F.lit(1)))
