"""Source / operator paths that the table bindings do not reach."""

import numpy as np
from pyspark.sql import functions as F

from cwescope.operators import vectors as VE
from cwescope.sources import io as IO


def test_clone_join_chunked_equals_single(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = e.where(F.col("label") != 0).select("vec_id", F.col("embedding").alias("vec"))
    k = e.where(F.col("label") == 0).select("vec_id", F.col("embedding").alias("vec"))
    one = {r["vec_id"]: r["max_sim"] for r in VE.clone_join(t, k, key="vec_id").collect()}
    monkeypatch.setattr(VE, "BLOCK_ROWS", 7)
    many = {r["vec_id"]: r["max_sim"] for r in VE.clone_join(t, k, key="vec_id").collect()}
    assert one.keys() == many.keys()
    assert np.allclose([one[i] for i in one], [many[i] for i in one], atol=1e-12)
    # brute force on the driver for a few targets
    kv = np.array([r["vec"] for r in k.collect()], dtype=float)
    kv /= np.linalg.norm(kv, axis=1, keepdims=True)
    for r in t.limit(5).collect():
        v = np.array(r["vec"], dtype=float)
        assert abs(one[r["vec_id"]] - float((kv @ (v / np.linalg.norm(v))).max())) < 1e-9


def test_clone_join_keeps_a_row_for_each_target(spark, monkeypatch):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "id long, vec array<double>")
    k = spark.createDataFrame([(9, [3.0, 0.0]), (9, [4.0, 3.0])], "id long, vec array<double>")
    for rows in (1, 2, 100):
        monkeypatch.setattr(VE, "BLOCK_ROWS", rows)
        got = sorted((r["id"], round(r["max_sim"], 9), r["is_clone"]) for r in VE.clone_join(t, k).collect())
        assert got == [(1, 0.6, False), (1, 1.0, True), (2, 0.0, False)]


def test_clone_join_empty_known_set(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    out = VE.clone_join(e, e.where("false"), key="vec_id").collect()
    assert out and all(r["max_sim"] == 0.0 and not r["is_clone"] for r in out)


def test_lookup_single_object_array_and_lines(spark):
    root = IO.scratch(spark, "lookup-test")
    rows = [("a.json", '{"hash": "1", "cwe": ["CWE-1"], "project": "p"}'),
            ("b.json", '[{"hash": "2", "cwe": []}, {"hash": "1", "cwe": ["CWE-9"]}]'),
            ("c.json", '{"hash": "3"}\n{broken\n{"hash": "4", "project": "q"}')]
    for name, text in rows:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{name}")
    got = {r["hash"]: (r["cwes"], r["project"]) for r in IO.read_lookup(spark, root).collect()}
    # file order a < b < c: the later record of hash 1 (in b) wins
    assert got == {"1": (["CWE-9"], "unknown"), "2": ([], "unknown"), "3": ([], "unknown"),
                   "4": ([], "q")}


def test_corpus_arrays_and_odd_values(spark):
    root = IO.scratch(spark, "corpus-test")
    a = """[
  {"func": "f", "cwe": "CWE-1", "hash": 7, "target": "x"},
  {"func": "g", "cwe": ["CWE-2", "CWE-3"], "size": "big"},
  {"func": "h", "cwe": []},
  {"cwe": []}
]"""
    b = """[
 {"func": "f", "is_vul": 1, "git_url": 5}, {"func": "g", "is_vul": false, "cwe_ids": ["CWE-9"]},
 {"func": "h", "is_vul": "yes"}, {"func": "i", "is_vul": 0}, {"func": "j"}
]"""
    for name, text in (("a", a), ("b", b)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{name}")
    got = {r["code"]: (r["id"], r["cwe_ids"], r["label"], r["target"])
           for r in IO.read_functions(spark, f"{root}/a").collect()}
    assert got == {"f": ("7", ["CWE-1"], 1, None), "g": ("", ["CWE-2", "CWE-3"], 1, None), "h": ("", [], 0, None)}
    got = {r["code"]: (r["label"], r["commit_url"], r["commit_id"], r["cwe_ids"])
           for r in IO.read_functions_git(spark, f"{root}/b").collect()}
    assert got == {"f": (1, None, "", []), "g": (0, None, "", ["CWE-9"]), "h": (1, None, "", []),
                   "i": (0, None, "", [])}


def test_lookup_pretty_object(spark):
    root = IO.scratch(spark, "lookup-pretty")
    text = '{\n  "hash": "1",\n  "cwe": ["CWE-1"],\n  "project": "p"\n}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(root)
    assert [(r["hash"], r["cwes"], r["project"]) for r in IO.read_lookup(spark, root).collect()] == [
        ("1", ["CWE-1"], "p")]


def test_code_files_in_archives(spark, tmp_path, monkeypatch):
    """Packed files read like files on their own, take no block each, and keep one file of a name."""
    texts = {f"p_{i:07d}_{i}.c": f"int x{i};\r\n\u00fc\n" * (i % 4) for i in range(300)}
    rows = spark.createDataFrame([*texts.items(), ("p_x_n.c", None), ("p_x_n.c", None), ("notes.txt", "no code")],
                                 "file_name string, code string")
    IO.write_code_files(rows, f"{tmp_path}/plain", real_files=True)
    IO.write_code_files(rows, f"{tmp_path}/packed", real_files=True, packed=True)
    IO.write_code_files(rows.limit(0), f"{tmp_path}/none", real_files=True, packed=True)
    want = IO.read_code_files(spark, f"{tmp_path}/plain").collect()
    got = IO.read_code_files(spark, f"{tmp_path}/packed", packed=True)
    assert len(want) == 225 and sorted(got.collect()) == sorted(want)
    assert got.dtypes == IO.read_code_files(spark, f"{tmp_path}/plain").dtypes
    assert IO.read_code_files(spark, f"{tmp_path}/none", packed=True).count() == 0
    files = list((tmp_path / "packed").iterdir())
    assert files and all(f.suffix == ".zip" for f in files) and len(files) <= 8
    monkeypatch.setattr(IO, "ARCHIVE_BYTES", 64)
    IO.write_code_files(rows, f"{tmp_path}/small", real_files=True, packed=True)
    assert len(list((tmp_path / "small").iterdir())) > 50
    assert sorted(IO.read_code_files(spark, f"{tmp_path}/small", packed=True).collect()) == sorted(want)
