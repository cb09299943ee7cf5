"""Groups of similar pairs in crowded buckets, without their squares."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from cwescope.llm import nearcopies as nc
from cwescope.llm.components import linked


def counted(similar):
    """A ``verify`` that counts its pairs."""
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.withColumn("similar", similar)
    return verify, asked


def roots_of(df):
    return {r["node"]: r["root"] for r in df.collect()}


def test_ten_thousand_members_that_are_not_similar(spark):
    members = spark.range(10_000).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"))
    verify, asked = counted(F.lit(False))
    seen = []

    def resolve(crowded):
        seen.append(crowded.count())
        return crowded.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)

    assert linked(members, verify, resolve=resolve).count() == 0
    assert sum(asked) <= 7 * 10_000 and seen == [10_000]


def test_mostly_similar_group_with_single_members(spark):
    # pairs of unequal residue modulo 3 are similar, so a third of the checks fail
    members = spark.range(3_000).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"))
    alone = (F.col("a") % 100 == 7) | (F.col("b") % 100 == 7)
    verify, asked = counted(~alone & (F.col("a") % 3 != F.col("b") % 3))
    got = roots_of(linked(members, verify, resolve=lambda crowded: crowded.select(
        F.col("node").alias("a"), F.col("root").alias("b")).limit(0)))
    assert {r for n, r in got.items() if n % 100 != 7} == {0} and not any(n % 100 == 7 for n in got if n != got[n])
    assert sum(n % 100 != 7 for n in got) == 2_970 and sum(asked) < 12 * 3_000


def test_without_blocks_no_candidate_is_lost(spark):
    rng = random.Random(5)
    rows = [(b, n) for b in range(12) for n in rng.sample(range(120), rng.choice([3, 20, 60]))]
    near = {(a, a + rng.randint(1, 9)) for a in range(0, 120, 2)}
    want = {}

    def find(x):
        while want.setdefault(x, x) != x:
            x = want[x]
        return x

    groups = {}
    for b, n in rows:
        groups.setdefault(b, set()).add(n)
    for a, b in near:
        if any({a, b} <= g for g in groups.values()):
            x, y = sorted((find(a), find(b)))
            want[y] = x
    table = spark.createDataFrame(sorted(near), "a long, b long").withColumn("yes", F.lit(True))

    def verify(pairs):
        return pairs.join(table, ["a", "b"], "left").select("a", "b", F.coalesce("yes", F.lit(False)).alias("similar"))

    got = roots_of(linked(spark.createDataFrame(rows, "bucket long, node long"), verify))
    assert got == {x: find(x) for x in list(want)}


def crowd(rng, n=90):
    """Texts of one template whose pairs are about as often similar as not."""
    base = [f"b{i % 40}" for i in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = f"e{rng.randrange(400)}"
        out.append(" ".join(words))
    return out


def multiset(text):
    words = text.split()
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_members_compared_as_matrices(monkeypatch):
    monkeypatch.setattr(nc, "MATRIX", 90 * 7)
    texts = [*crowd(random.Random(6)), "a a a a a a a", "a a a a a a", "x", "x", "y z", ""]
    sets = [multiset(t) if len(t.split()) > 4 else Counter([tuple(t.split())] if t else []) for t in texts]
    got = nc.similar_members(pa.array(texts), 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and i != j:
                assert got[i, j] == (similarity(a, b) >= 0.8 - 1e-12)


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nc, "FEW", 0)
    monkeypatch.setattr(nc, "STAR_ROUNDS", 0)
    monkeypatch.setattr(nc, "BLOCK_NODES", 13)
    texts = crowd(random.Random(7))
    sets = [multiset(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nc.near_report(df).collect()}
    want = {i: find(i) for i in range(len(texts))}
    assert got == want and 1 < len(set(want.values())) < len(texts)


def test_kept_rows_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, True, "x"), (2, "a b c d e f", 6, False, "y"), (3, None, 7, True, "z"),
                                (4, "g", 8, None, "z")], "doc_id long, text string, _row int, _worded boolean, `a.b` string")
    got = nc.keep_one(df)
    assert got.columns == df.columns and sorted((r[0], r[2], r[4]) for r in got.collect()) == [
        (1, 5, "x"), (3, 7, "z"), (4, 8, "z")]


def test_a_group_of_pairs_takes_a_link_a_member(spark):
    """All pairs of 60 nodes, each a bucket of its own: similar ones take about a
    check a member; of unequal ones each pair is verified."""
    pairs = [(a * 100 + b, n) for a in range(60) for b in range(a + 1, 60) for n in (a, b)]
    members = spark.createDataFrame(pairs, "bucket long, node long")
    verify, asked = counted(F.lit(True))
    assert roots_of(linked(members, verify, rationed=True)) == dict.fromkeys(range(60), 0)
    assert sum(asked) < 3 * 60
    verify, asked = counted((F.col("a") == 17) & (F.col("b") == 43))
    assert roots_of(linked(members, verify, rationed=True)) == {17: 17, 43: 17}
    assert sum(asked) == 60 * 59 / 2
