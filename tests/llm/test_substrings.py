"""Window removal against a direct reading of its definition."""

import hashlib
import random

from cwescope.llm import substrings


def brute(rows, length):
    """rows: (doc_id, text); ids may repeat or be None."""
    words = [(t or "").encode().split() for _, t in rows]
    rank = [substrings.NO_ID if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(rank, words):
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            first[k] = min(first.get(k, (i, s)), (i, s))
    gone = {}
    for i, w in zip(rank, words):
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < (i, s):
                gone.setdefault(i, set()).update(range(s, s + length))
    out = []
    for (i, _), r, w in zip(rows, rank, words):
        left = [x for k, x in enumerate(w) if k not in gone.get(r, ())]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def report(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                   for r in substrings.substring_report(df, length).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 300)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)] + ["é", "Ü\x1cx", "\xa0"]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(4, 30))) for _ in range(12)]
    rows = [(None, passages[0]), (None, "x " + passages[0]), (3, None), (4, ""), (5, " \n\t "), (6, "a b"),
            (7, "a " * 60), (8, "a " * 61), (9, passages[1]), (9, passages[1]), (9, "q " + passages[1])]
    rows += [(20 + i, "\n".join(rng.choices(passages, k=rng.randint(1, 4)) + rng.choices(vocab, k=9)))
             for i in range(60)]
    for length in (1, 3, 5, 20):
        assert report(spark, rows, length) == brute(rows, length), length


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in substrings.substring_report(docs).collect()), key=str)
    assert got == brute(rows, 20)
    assert substrings.substring_report(docs.limit(0)).count() == 0


def test_extra_columns_and_intervals(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 1, "b"), (2, "z " + text + " y", 2, "c")],
                               "doc_id long, text string, found int, bucket string")
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert got[1].intervals == [] and got[2].kept == "z y"
    assert [(s.start, s.end) for s in got[2].intervals] == [(1, 31)]
