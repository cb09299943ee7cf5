"""The pipeline's run against its stages' own definitions."""

import __spark_entry__
import corpus_pipeline as cp

from cwescope.llm import decontam, nearcopies


def test_run(spark, sf, monkeypatch):
    inputs = {}

    def noting(name, stage):
        def run(s, docs, d):
            inputs[name] = docs
            return stage(s, docs, d)
        return run

    monkeypatch.setattr(cp, "STAGES", [(n, noting(n, f)) for n, f in cp.STAGES])
    mix = cp.run(spark, sf)
    out = mix.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = dict(zip(inputs, list(inputs.values())[1:]))  # a stage's result is the next one's input
    ids = set(texts)
    for name, kept in after.items():
        assert kept.columns == docs.columns, name
        rows = kept.select("doc_id", "text").collect()
        assert len(rows) == len({r.doc_id for r in rows}) and {r.doc_id for r in rows} <= ids, name
        ids = {r.doc_id for r in rows}
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()
            clean = {r.doc_id for r in labels}
            assert len(clean & ids) >= 0.97 * len(clean)  # test_quality judges rejection on more rows
        if name == "lines":
            assert {x for r in rows for x in r.text.split("\n")} <= {x for t in texts.values() for x in t.split("\n")}
        if name == "near_copies":
            assert nearcopies.near_report(kept).where("not kept").count() == 0
        if name == "decontaminate":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontam.decontam_report(kept, bench).where("contaminated").count() == 0
            size = {r.doc_id: len(r.text.split()) for r in rows}
    assert list(inputs) == ["quality", "lines", "near_copies", "decontaminate", "mix"]
    assert mix.columns == docs.columns + ["epoch", "words", "position"]
    assert {r.doc_id for r in out} <= ids
    assert abs(sum(r.words for r in out) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())


def test_registered():
    queries = __spark_entry__.queries()
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries if k.startswith("op") and k[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in queries
