"""Spelling variants against a plain one-edit comparison of all words."""

import random
import re
import zlib
from collections import Counter

from cwescope.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    seen = words_of(docs)
    near = {w: [v for v in seen if one_edit(w, v)] for w in seen}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-seen[v], v), default=None)
        form[w] = best if best is not None and seen[best] >= 10 * seen[w] else None
    out = []
    for w in seen:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, seen[w], len(near[w]), seen.get(form[w])))
    return sorted(out)


def run(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    rows = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in rows)


def edited(rng, w):
    i = rng.randrange(len(w))
    c = rng.choice("abeostÀé")
    return rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w + c])


def sample(seed, n=150):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeost") for _ in range(rng.randrange(6, 11))) for _ in range(25)]
    stems += ["station" + s for s in ("s", "en", "er", "ary")] + ["aaaaaaaa", "aaaaaaa", "abababab", "babababa"]
    docs = []
    for i in range(n):
        some = []
        for _ in range(rng.randrange(80)):
            w = rng.choice(stems[:1 + int(len(stems) * rng.random() ** 2)])
            for _ in range(rng.choice([0] * 12 + [1, 1, 2, 3])):
                w = edited(rng, w)
            some.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "1", "–"]).join(some)))
    return docs


def test_against_all_pairs(spark, monkeypatch):
    docs = sample(1) + [(None, "Stations stations STATIONS"), (900, None), (901, ""), (7, "stations, staTions")]
    docs += [(950 + i, "chained " * 60 + "chainedd " * 5 + "chaineddd " * (i % 2)) for i in range(5)]
    want = brute(docs)
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    assert run(spark, docs) == want
    # many shards, many blocks, several index blocks and steps
    monkeypatch.setattr(spelling, "BLOCK_POINTS", 300)
    monkeypatch.setattr(spelling, "INDEX_BITS", 100 * 80)
    monkeypatch.setattr(spelling, "STEP_WORDS", 4)
    assert run(spark, docs) == want


def test_hot_beginning_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_POINTS", 400)
    rng = random.Random(3)
    words = ["pre" + "".join(rng.choice("ab") for _ in range(5)) for _ in range(400)]
    docs = [(i, " ".join(words[i::7])) for i in range(7)] * 2
    assert run(spark, docs) == brute(docs)


def test_long_runs_and_ties(spark):
    long_ = "ab" * 3000
    docs = [(1, f"{long_} {long_} {long_}c {long_}c"), (2, "abcdefg abcdefg abcdefgh abcdefgh abcdefgi abcdefgi")]
    assert run(spark, docs) == brute(docs)


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    seen = words_of(docs)
    assert {r.word: r.n for r in rows} == seen
    # near words by dropped letters: a plain join that the operator does not use
    holes = {}
    for w in seen:
        for key in {(len(w) - 1, w[:i] + w[i + 1:]) for i in range(len(w))} | {(len(w), w)} | {
                (len(w), i, w[:i] + "\0" + w[i + 1:]) for i in range(len(w))}:
            holes.setdefault(key, set()).add(w)
    near = {w: set() for w in seen}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    assert {r.word: r.n_near for r in rows} == {w: len(x) for w, x in near.items()}


def test_other_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "stations stations", 5, "x")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in spelling.variants(df).collect()] == [("stations", None, "stations", 2, 0, None)]
    assert spelling.variants(df.limit(0)).count() == 0
