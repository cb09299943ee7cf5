"""Packing: every id once, gapless sequences, ids of the tokenizer, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cwescope.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def own_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, docs, capacity=1024):
    """``pieces``: (doc_id, start, length, crc, doc_tokens, sequence, offset); ids of ``docs`` differ."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
    want = dict(zip((i for i, _ in docs), own_ids([t for _, t in docs])))
    assert set(by_doc) == set(want)
    for doc, found in by_doc.items():
        ids, at = np.array(want[doc], "<u4"), 0
        for _, start, length, crc, total, _, _ in sorted(found, key=lambda p: p[1]):
            assert start == at and length > 0 and total == len(ids)
            at += length
            assert crc == zlib.crc32(ids[start:at].tobytes())
        assert at == len(ids)
    padded = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(1, sum(p[2] for p in pieces))


def test_encoder_equals_the_library():
    encode = packing.Encoder(open(PATH, encoding="utf-8").read())
    assert encode.fast is not None
    rng = random.Random(4)
    letters = "abcs't'd'll   \n\t 12é.,;-ÀΩ語  <|>\r\x85\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += ["", " ", "a<|endoftext|>b", " " * 5000, "x" * 5000, "ab " * 3000, "﻿​", "😀" * 50]
    assert [[*encode(t).tolist(), 0] for t in texts] == own_ids(texts)


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 40)
    encode = packing.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc   \n'st 1,") for _ in range(600)) for _ in range(60)] + ["a" * 500, " " * 500]
    assert any(len(packing.stretches(t)) > 3 for t in texts) and all("".join(packing.stretches(t)) == t for t in texts)
    assert [[*encode(t).tolist(), 0] for t in texts] == own_ids(texts)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pieces = [tuple(r) for r in packing.pack_report(docs.repartition(2)).collect()]
    assert check(pieces, rows) < 0.01
    total = packing.padding(packing.pack(docs)).first()
    assert total["tokens"] == sum(p[2] for p in pieces) and total["padded"] < 0.01 * total["tokens"]


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["one", "two", "zwölf"]) for _ in range(rng.choice([0, 1, 5, 300, 3000]))), i, "s")
            for i in range(60)] + [(100, None, 1, "s"), (101, "", 1, "s"), (102, "a<|endoftext|>b", 1, "s")]
    schema = "doc_id long, text string, start int, sequence_id string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    assert check([tuple(r) for r in packing.pack_report(df).collect()], [r[:2] for r in rows]) < 0.01
    twins = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "c"), (5, "c")], "doc_id long, text string")
    got = packing.pack_report(twins).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2 + 2 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack_report(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([16, 100, 1024]))
def test_classes(sizes, capacity):
    packer = packing.Packer(0, capacity)
    for i, n in enumerate(sizes):
        lengths = packing.piece_lengths(n, capacity)
        assert sum(lengths) == n and all(0 < x <= capacity for x in lengths)
        packer.add(i, np.arange(n, dtype=np.uint32))
    closed = len(packer.rows)
    fill = defaultdict(list)
    for r in packer.rows:
        fill[r[5]].append(r[2])
    for found in fill.values():  # k pieces of class k, nearly full
        assert len({capacity // x for x in found}) == 1 and len(found) == capacity // found[0]
        assert sum(found) * (packing.SLACK + 1) >= capacity * packing.SLACK - len(found) * (packing.SLACK + 1)
    packer.finish()
    ends = defaultdict(int)
    for r in packer.rows[closed:]:
        ends[r[5]] += r[2]
    assert all(n == capacity or n & (n - 1) == 0 for n in ends.values())
    assert sum(r[2] for r in packer.rows) == sum(sizes)
