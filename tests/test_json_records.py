"""Splittable JSON records against Python's json, with blocks of a few bytes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cwescope.sources import json_records as J

SCHEMA = "func string, n string, tags array<string>, _corrupt_record string"


def local(spark, name):
    path = J.scratch(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def put(path, name, text):
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


def record(rng):
    bits = ['"', "\\", "{", "}", "[", "]", "\n", ",", "}}", "{{", "é", "語", "if (x) { y[0] = '}'; }", "a", " ", "\\\\"]
    return {"func": "".join(rng.choice(bits) for _ in range(rng.randrange(12))), "n": rng.randrange(100),
            "tags": ["".join(rng.choice(bits) for _ in range(2)) for _ in range(rng.randrange(3))]}


def expected(r):
    return (r["func"], str(r["n"]), tuple(r["tags"]))


def read(spark, path, form="auto"):
    rows = J.read_records(spark, path, SCHEMA, form).select("file", "pos", "record.*").collect()
    rows.sort(key=lambda r: (r["file"], r["pos"]))
    good = [(r["func"], r["n"], tuple(r["tags"] or [])) for r in rows if r["_corrupt_record"] is None]
    return good, [r["_corrupt_record"] for r in rows if r["_corrupt_record"] is not None]


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_forms_in_one_folder(spark, small_blocks):
    rng = random.Random(1)
    path = local(spark, "mixed")
    parts = [[record(rng) for _ in range(5)] for _ in range(6)]
    put(path, "a one line.json", json.dumps(parts[0]))
    put(path, "b.json", "\n " + json.dumps(parts[1], indent=2, ensure_ascii=False) + "\n")
    put(path, "c.jsonl", "\n".join(json.dumps(r) for r in parts[2]) + "\n")
    put(path, "d.json", json.dumps(parts[3][0], indent=1))
    put(path, "e.json", "\n".join(json.dumps(r, indent=4) for r in parts[4]))
    put(path, "f.jsonl", "\n".join(json.dumps(r) for r in parts[5]))
    put(path, "g.json", "[]")
    put(path, "h.json", " \n")
    good, bad = read(spark, path)
    assert good == [expected(r) for r in parts[0] + parts[1] + parts[2] + parts[3][:1] + parts[4] + parts[5]]
    assert not bad
    forms = {os.path.basename(r["file"]).replace("%20", " "): r["form"] for r in J.file_forms(spark, path).collect()}
    assert forms == {"a one line.json": "array", "b.json": "array", "c.jsonl": "lines", "d.json": "object",
                     "e.json": "object", "f.jsonl": "lines", "g.json": "array"}


def test_ten_of_ten(spark):
    path = local(spark, "ten")
    rows = [{"func": str(i), "n": i, "tags": []} for i in range(10)]
    put(path, "a.json", json.dumps(rows[:5]))
    put(path, "b.json", "\n".join(map(json.dumps, rows[5:])))
    assert len(read(spark, path)[0]) == 10


def test_one_array_is_many_tasks(spark, small_blocks, monkeypatch):
    rng = random.Random(2)
    path = local(spark, "array")
    rows = [record(rng) for _ in range(120)] + [{"func": "x" * 700, "n": 1, "tags": []}] + [record(rng) for _ in range(9)]
    put(path, "a.json", json.dumps(rows))
    assert read(spark, path) == ([expected(r) for r in rows], [])
    assert read(spark, path, "array") == ([expected(r) for r in rows], [])
    pieces = J._pieces(spark, path)
    tasks = pieces.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 10
    monkeypatch.setattr(J, "BROADCAST_BLOCKS", 0)
    assert read(spark, path) == ([expected(r) for r in rows], [])


def test_bad_values(spark, small_blocks):
    path = local(spark, "bad")
    put(path, "a.json", '[ 1, "two, {", {"func": "a", "n": 1}, null, [3, 4], {"func": "b"}, {"func": c}, {"func": "d"}, "e" ]')
    put(path, "b.json", '[{"func": "f"}, {"func": "g"')
    put(path, "c.json", '[{"func": "h", "tags": ["i"]}')
    put(path, "d.json", '{"func": "j"}\n{broken\n"text"\n\n{"func": "k"}')
    good, bad = read(spark, path)
    assert [g[0] for g in good] == ["a", "b", "d", "f", "h", "j", "k"]
    assert bad == ["1", "two, {", "null", "[3,4]", '{"func": c}', "e", '{"func": "g"', "", "{broken", '"text"']


def test_nested_records(spark, small_blocks):
    path = local(spark, "nested")
    put(path, "a.json", '[{"func": "a", "n": {"x": {"y": [{}, {"z": "}"}]}}},{"func": "b", "more": [{"func": "c"}]}]')
    put(path, "b.json", '[[{"func": "d"}], {"func": "e"}]')
    good, bad = read(spark, path)
    assert [g[0] for g in good] == ["a", "b", "e"] and len(bad) == 1


@pytest.mark.parametrize("seed", range(3))
def test_random_layouts(spark, small_blocks, seed):
    rng = random.Random(10 + seed)
    path = local(spark, "random")
    want = []
    for name in "abcde":
        rows = [record(rng) for _ in range(rng.randrange(1, 40))]
        want += [expected(r) for r in rows]
        put(path, name, json.dumps(rows, indent=rng.choice([None, 0, 3]), ensure_ascii=rng.random() < 0.5,
                                   separators=rng.choice([(",", ":"), (" , ", ": ")])))
    assert read(spark, path) == (want, [])
