"""Weights against a plain count; separation on held-out labels; sampling."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cwescope.llm import quality as ql

M64 = (1 << 64) - 1


def finalise(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def grams(text):
    tokens = [xxhash.xxh64_intdigest(t) for w in (text or "").lower().encode().split()
              for t in (re.findall(r"\w+|[^\w\s]+", w.decode()) or [w.decode()])]
    tokens = [7 if i and t == tokens[i - 1] else t for i, t in enumerate(tokens)]
    out, seen = [], Counter()
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else 1
        for b in (finalise(t), finalise((before * int(ql.GOLD) + t) & M64)):
            b &= ql.BUCKETS - 1
            seen[b] += 1
            n = seen[b]
            if n & (n - 1) == 0:
                out.append(b if n == 1 else finalise((b + n * int(ql.GOLD)) & M64) & (ql.BUCKETS - 1))
    return out


def brute(docs, target):
    """docs: (id, text); weight of each row."""
    bags = [grams(t) for _, t in docs]
    raw, good = Counter(), Counter()
    for (i, _), b in zip(docs, bags):
        raw.update(b)
        if i in target:
            good.update(b)
    share = sum(good.values()) / max(1, sum(raw.values()))
    ratio = {}
    for b, c in raw.items():
        r = math.log((good[b] + 1) / (c * share + 1)) if good else 0
        ratio[b] = r if abs(r) >= 1 and abs(good[b] - c * share) >= ql.Z * math.sqrt(c * share + 1) else 0
    return [sum(ratio[b] for b in bag) / (len(bag) + ql.SHORT) * ql.REFERENCE for bag in bags], bags


def tables(spark, sf):
    return (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_weights_and_selection(spark, sf):
    docs, labels = tables(spark, sf)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (None, "x y"), (-4, "% % %"), (-4, "% % %")],
                                  "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = {r.doc_id for r in ql.target_ids(labels).collect()}
    assert target == {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    want, bags = brute(rows, target)
    got = ql.weights(docs, labels)
    assert sorted((str(r.doc_id), r.n_grams, round(r.log_weight, 3)) for r in got.collect()) == sorted(
        (str(i), len(b), round(w, 3)) for (i, _), w, b in zip(rows, want, bags))
    keyed = ql.keys(got.where("n_grams > 0")).collect()
    cut = np.quantile([r.log_weight for r in keyed if r.wanted], 1 - ql.KEEP)
    k = sum(r.log_weight >= cut for r in keyed)
    least = sorted((r.key for r in keyed), reverse=True)[k - 1]
    assert sorted(str(r.doc_id) for r in ql.sample(got).collect()) == sorted(
        str(r.doc_id) for r in keyed if r.key >= least)
    assert ql.sample(got, k=0).count() == 0


def test_held_out_labels(spark):
    """Half of the labels train; the others are judged."""
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    known = labels.where("doc_id % 2 = 0")
    kept = ql.sample(ql.weights(docs, known)).select("doc_id").withColumn("kept", F.lit(1))
    judged = labels.where("doc_id % 2 = 1").join(kept, "doc_id", "left")
    share = {(r.quality, r.toxic): r.share for r in judged.groupBy("quality", "toxic").agg(
        (F.count("kept") / F.count("*")).alias("share")).collect()}
    assert share[1, 0] > 0.97 and share[0, 0] < 0.03 and share[1, 1] < 0.5


def test_few_toxic_words_do_not_hide_in_long_texts(spark):
    """Held-out labels again, by the worst passage and not only by the mean."""
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    kept = ql.quality_report(docs, labels.where("doc_id % 2 = 0")).select("doc_id").withColumn("kept", F.lit(1))
    words = docs.select("doc_id", F.size(F.split("text", r"\s+")).alias("words"))
    judged = labels.where("doc_id % 2 = 1 and quality = 1").join(words, "doc_id").join(kept, "doc_id", "left")
    share = {(r.toxic, r.long): r.share for r in judged.groupBy("toxic", (F.col("words") >= 200).alias("long")).agg(
        (F.count("kept") / F.count("*")).alias("share")).collect()}
    assert share[1, True] < 0.1 and share[1, False] < 0.15
    assert share[0, True] > 0.97 and share[0, False] > 0.97


def test_worst_passage(spark):
    doc = np.array([0] * 120 + [2] * 3)
    evidence = np.zeros(123)
    evidence[[0, 49, 50, 119, 122]] = [1, 2, 4, 5, 7]
    assert ql.worst_passages(doc, evidence, 4).tolist() == [6, 0, 7, 0]
    assert not ql.harm_ratio(np.zeros(4), np.ones(4)).any() and not ql.harm_ratio(np.ones(4), np.zeros(4)).any()


def test_kth_largest_and_gumbel_frequencies(spark):
    values = [1.0] * 500 + [2.0] * 3 + [i / 7 for i in range(300)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 5, 250, 500, len(values)):
        assert ql.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    # weight e against 1: the heavier row comes first with probability e / (e + 1)
    two = spark.range(4000).selectExpr("id", "explode(array(0.0D, 1.0D)) as log_weight") \
        .withColumn("row", F.xxhash64("id", "log_weight"))
    won = ql.keys(two).groupBy("id").agg(F.max_by("log_weight", "key").alias("w")).agg(F.avg("w")).first()[0]
    assert won == pytest.approx(math.e / (math.e + 1), abs=0.03)


def test_empty_tables_and_columns(spark, sf):
    docs, labels = tables(spark, sf)
    assert ql.quality_report(docs.limit(0), labels).count() == 0
    assert ql.quality_report(docs, labels.limit(0)).count() == docs.count()
    odd = docs.withColumn("row", F.lit(1)).withColumn("wanted", F.lit("x")).limit(40)
    assert ql.select(odd, labels).columns == odd.columns


def test_a_task_holds_few_documents_at_a_time():
    """Memory of a Python worker follows the rows whose n-grams it holds."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a b"] * 3001)], names=["text"])
    assert [b.num_rows for b in ql._parts([batch])] == [500] * 6 + [1]
