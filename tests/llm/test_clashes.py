"""Columns of the input that have the names an operator uses inside."""

import pytest

from cwescope.llm import decontam, lines, nearcopies, quality

NAMES = ("_row", "_id", "_doc", "_worded", "row", "doc", "id", "removed", "hit", "n_words", "n_hit", "hit_items", "node",
         "worded", "wanted", "key", "class", "line", "words", "sim", "bucket", "root", "a.b")
TEXTS = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "plain words\nplain words\nother", "", None]


def docs(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame([(i, t, *range(len(NAMES))) for i, t in enumerate(TEXTS)], schema)


@pytest.mark.parametrize("name", ["quality", "lines", "near", "clean"])
def test_stages_keep_columns_of_any_name(spark, name):
    df = docs(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("b1", TEXTS[0])], "item_id string, text string")
    out = {"quality": lambda: quality.select(df, labels), "lines": lambda: lines.dedup_lines(df),
           "near": lambda: nearcopies.keep_one(df), "clean": lambda: decontam.clean(df, bench)}[name]()
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(tuple(r)[2:] == tuple(range(len(NAMES))) for r in rows)
    if name == "lines":
        assert {r["doc_id"]: r["text"] for r in rows}[1] == "plain words\nother"


def test_marked_refuses_its_own_names(spark):
    bench = spark.createDataFrame([("b1", TEXTS[0])], "item_id string, text string")
    with pytest.raises(ValueError, match="hit_items, n_hit, n_words"):
        decontam.marked(docs(spark).drop("_doc"), bench)
