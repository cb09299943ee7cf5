"""Windows against a direct search; index, proximity and cleaning."""

import hashlib
import random
import re

from cwescope.llm import decontam as dc


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, length=10):
    windows = {}
    for i, t in items:
        w = tokens(t)
        k = min(length, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, named = tokens(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit.update(range(s, s + k))
                    named |= windows[tuple(w[s:s + k])]
        ids = sorted(str(i) for i in named if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "The", "0"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([3, 9, 10, 11, 25, 40, 1, 12])]
    items += [(20, None), (21, ""), (22, "?!"), (23, items[4][1]), (4, "another text of item four x1 x2 x3 x4 x5 x6"),
              (None, "null item words y1 y2 y3"), (24, "a a a a a a a a a a a a")]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.choice([0, 4, 30, 80]))
        for _ in range(rng.choice([0, 1, 2])):
            t = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(t) - 5))
            at = rng.randint(0, len(w))
            w[at:at] = t[a:a + rng.choice([5, 10, 14, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n", " - "]).join(w).title()))
    docs += [(500, None), (None, items[4][1]), (501, "a " * 50), (7, items[5][1].upper()), (7, items[5][1].upper()),
             (7, "other text")]
    return docs, items


def test_report(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.decontam_report(d, b).collect()), key=str)
    assert got == brute(docs, items)
    kept = dc.clean(d.selectExpr("*", "1 as n_words_", "'x' as doc"), b)
    assert kept.columns == ["doc_id", "text", "n_words_", "doc"]
    assert kept.count() == sum(not r[-1] for r in brute(docs, items))
    assert dc.decontam_report(d.limit(0), b).count() == 0
    assert dc.decontam_report(d, b.limit(0)).where("contaminated").count() == 0


def test_phrases_and_proximity(spark):
    text = " ".join(f"t{i}" for i in range(30))
    near = " ".join(f"t{i}" if i != 14 else "gap" for i in range(30))
    d = spark.createDataFrame([(1, "x " + text + " y"), (2, near), (3, "t3 t9")], "doc_id long, text string")
    b = spark.createDataFrame([(5, text)], "item_id long, text string")
    index = dc.build_index(d, b)
    assert sorted((r.start, r.end) for r in dc.phrase_matches(index).collect()) == [(0, 14), (1, 31), (15, 30)]
    docs = {r.doc for r in dc.proximity_matches(index).collect()}
    keys = {r.doc_id: r.doc for r in d.select("doc_id", dc.doc_key().alias("doc")).collect()}
    assert docs >= {keys[1], keys[2]} and keys[3] not in docs
