"""Graph queries: whole results, and plans whose disk does not grow with the nodes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cwescope.operators import graph as G
from cwescope.operators import labelsets as L
from cwescope.operators import parse as PA
from cwescope.operators import tree as T
from cwescope.plans.catalog import REGISTRY
from cwescope.session import bucketed
from cwescope.sources import views as V

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """60 functions of one to seven lines, one without a key."""
    d = tmp_path_factory.mktemp("lines")
    rows = [(i or None, (i * 7 + k * 3) % 50, i % 5, k, 1.0, 2.0, 0.05, 0.04, "RAN"[(i + k) % 3], "OF"[k % 2],
             dt.datetime(2020, 1, 1)) for i in range(60) for k in range(1 + i % 7)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


@pytest.mark.parametrize("key, value", [("edge_endpoints", "dst_end_byte"), ("edge_features", "ef")])
def test_edge_queries_return_every_edge(spark, lines, key, value):
    got = REGISTRY[key].spark_df(spark, lines)
    edges = REGISTRY["edge_union"].spark_df(spark, lines).where("graph_id IS NOT NULL")
    assert value in got.columns
    pick = ["graph_id", "src", "dst", "edge_type"]
    assert sorted(got.select(*pick).collect()) == sorted(edges.select(*pick).collect())


def test_node_queries_sort_no_nodes(spark, lines):
    """Trees are built beside their texts: one shuffle of the lines, no stored nodes."""
    for key in ("tree_nodes", "edge_union", "next_token_edges", "scaled"):
        plan = REGISTRY[key].spark_df(spark, lines)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan, key


def test_hybrid_edges_are_made_beside_the_texts(spark, lines):
    """No nodes stored, sorted or grouped by edge; the same edges as the general form."""
    got = REGISTRY["hybrid_edges"].spark_df(spark, lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Aggregate", "Window", "next_leaf:")) and "code:string" in plan
    nodes = REGISTRY["tree_nodes"].spark_df(spark, lines)
    assert "next_leaf" not in nodes.columns
    edges = G.hybrid_edges(nodes).select(got.columns).where("graph_id IS NOT NULL").collect()
    assert edges and sorted(got.where("graph_id IS NOT NULL").collect()) == sorted(edges)


def test_samples_are_never_broadcast(spark, lines):
    """Their table grows with the input, whatever its file's size lets expect."""
    labels = V.tool_labels(spark, lines)
    samples = spark.read.parquet(f"{lines}/lineitem.parquet").select(F.col("l_orderkey").alias("sample_id"))
    df = L.restrict(labels, samples)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(df.collect()) == sorted(labels.where("sample_id IS NOT NULL").collect())


def test_parts_grow_with_the_lines(spark, lines, monkeypatch):
    n = spark.read.parquet(f"{lines}/lineitem.parquet").count()
    assert V.graph_parts(spark, lines) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(V, "LINES_PER_PART", 10)
    assert V.graph_parts(spark, lines) == -(-n // 10)


def test_nodes_are_not_broadcast(spark, lines):
    plan = REGISTRY["gcn_propagate"].spark_df(spark, lines)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_next_leaf_equals_the_window(spark):
    texts = spark.createDataFrame([(1, "a(b{c[d]e}f)g"), (2, "}x{"), (3, ""), (4, None)], "graph_id long, code string")
    n = G.tree_nodes(texts)
    for f in (G.edge_union, G.hybrid_edges, G.next_token_edges):
        assert sorted(f(n).collect()) == sorted(f(n.drop("next_leaf")).collect())


BUCKETED = ("gcn_propagate", "mean_propagate", "sum_propagate", "gat_propagate", "gat_propagate_heads", "gat_propagate_mean",
            "edge_features", "edge_endpoints", "hybrid_edges", "graph_stats", "graph_global", "graph_pool",
            "graph_node_types", "node_features")


@pytest.mark.parametrize("key", BUCKETED)
def test_node_joins_shuffle_nothing(spark, lines, key):
    """Nodes are stored once in buckets: joins, windows and groups stay in them."""
    plan = REGISTRY[key].spark_df(spark, lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan ExistingRDD" not in plan


def test_bucketed_leaves_no_table_and_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "graph_id long, x string")
    kept = bucketed(rows, "graph_id", 3)
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_asked_fields_are_the_same(spark):
    texts = spark.createDataFrame([(1, "a(b{c[d]e}f)g"), (2, "}x{"), (3, ""), (4, None)], "graph_id long, code string")
    for fields in (["next_leaf", "node_id"], ["node_type"], ["text", "is_named"]):
        got = G.tree_nodes(texts, group_text=True, fields=fields)
        assert got.columns[:1 + len(fields)] == ["graph_id", *fields]
        assert sorted(map(str, got.collect())) == sorted(map(str, G.tree_nodes(texts, group_text=True).select(*got.columns).collect()))


def test_labels_stay_in_parts_that_grow(spark, lines, monkeypatch):
    """One deal of the lines by sample; distinct and groups shuffle nothing more."""
    monkeypatch.setattr(V, "LABEL_LINES_PER_PART", 10)
    n = spark.read.parquet(f"{lines}/lineitem.parquet").count()
    d = V.tool_labels(spark, lines).groupBy("sample_id", "cwe").count()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(l_orderkey" in plan
    assert f", {max(-(-n // 10), int(spark.conf.get('spark.sql.shuffle.partitions')))})" in plan


def _shuffled(df):
    """Names of the columns that the first deal of the lines sends."""
    def walk(p):
        if p.nodeName() == "Exchange":
            yield [p.output().apply(i).name() for i in range(p.output().size())]
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))
    return list(walk(df._jdf.queryExecution().sparkPlan()))


def test_lines_are_dealt_narrow(spark, lines):
    """What the order of the lines shows in the code, and nothing else."""
    assert _shuffled(V.code_lines(spark, lines, 4)) == [["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]]
    assert _shuffled(V.tool_labels(spark, lines)) == [["l_orderkey", "c", "said"]]


def test_lines_that_tie_are_alike(spark, tmp_path):
    """Equal in number, part and supplier: whatever the rest says, the code is the same."""
    day = dt.datetime(2020, 1, 1)
    rows = [(1, p, s, k, float(q), 9.0 - q, None, 0.04, "R", "O", day) for k, p, s, q in
            [(1, 3, 1, 5), (1, 3, 1, 2), (2, 0, 1, 1), (1, 0, 2, 7), (None, 7, 0, 1), (1, None, 1, 1)]]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.code for r in V.code_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got[0] == "v0 = gets(buf);" and got[2:] == ["char *v0 = malloc(16);", "free(v1);", "free(v1);",
                                                       "char *v1 = malloc(16);"]


def test_labels_of_negative_and_missing_parts(spark, tmp_path):
    day = dt.datetime(2020, 1, 1)
    rows = [(1, p, 0, 1, 50.0, 1.0, 0.05, 0.04, "R", "O", day) for p in (-7, 40, None)]
    rows.append((2, 1, 0, 1, 1.0, 1.0, None, None, None, None, day))
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(1, t, c) for t in ("truth", "tool_a", "tool_c", "model") for c in ("CWE--7", "CWE-4", None)}
    want |= {(1, "tool_b", c) for c in ("CWE--7", "CWE-4", None)}
    got = [tuple(r) for r in V.tool_labels(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_unasked_places_are_not_computed(monkeypatch):
    import pyarrow as pa

    texts, calls, before = pa.array(["a(b{c\n[d]e}f)g", "}x{", "", None]), [], T._before
    monkeypatch.setattr(T, "_before", lambda *a: calls.append(1) or before(*a))
    whole = T._tree(texts, True)
    assert len(calls) == 2  # columns of the pieces, and levels
    for names in (["node_id", "node_type"], ["parent", "next_leaf"]):
        calls.clear()
        part = T._tree(texts, False, names)
        assert len(calls) == 1 and part.offsets.equals(whole.offsets)
        assert all(part.values.field(n).equals(whole.values.field(n)) for n in names)


def test_parsers_send_the_asked_fields(spark):
    texts = spark.createDataFrame([(1, "a(b{c\n[d]e}f)g"), (2, "}x{"), (3, ""), (4, None)], "graph_id long, code string")
    whole = PA.parse_nodes(texts, PA.bracket_parser)
    for fields in (PA.CHECKED, ["text", "depth"]):
        got = PA.parse_nodes(texts, PA.bracket_parser, fields=fields)
        assert got.columns == ["graph_id", *fields]
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect()))


def test_corpus_job_deals_no_node_vectors(spark, lines, monkeypatch):
    """The split is joined to nodes before they get vectors, and to whole graphs after."""
    from cwescope.plans import q_more

    plans, write = [], q_more.IO.write_partitioned
    monkeypatch.setattr(q_more.IO, "write_partitioned", lambda df, *a: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    got = {r["split"]: (r["graphs"], r["nodes"]) for r in REGISTRY["etl_corpus"].spark_df(spark, lines).collect()}
    n = REGISTRY["tree_nodes"].spark_df(spark, lines).where("graph_id IS NOT NULL")
    assert (sum(g for g, _ in got.values()), sum(k for _, k in got.values())) == (
        n.select("graph_id").distinct().count(), n.count())
    above, below = plans[0].split("Aggregate [graph_id", 1)
    assert above.count("Join Inner") == 2 and below.split("bucketed_")[0].count("Join Inner") <= 2


def test_edges_know_their_places(spark):
    """Edges of nodes with far places get their features without a join, and the same ones."""
    texts = spark.createDataFrame([(1, "a(b{c\n[d]e}f)g"), (2, "}x{"), (3, ""), (4, None), (5, "é(ü)")], "graph_id long, code string")
    fields = ["node_id", "parent", "is_leaf", "next_leaf", "start_byte", "end_byte"]
    near, far = G.tree_nodes(texts, fields=fields), G.tree_nodes(texts, fields=fields + T.FAR)
    assert set(G.tree_nodes(texts).columns).isdisjoint(T.FAR)
    got = G.edge_features(far, G.edge_union(far))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = G.edge_features(near, G.edge_union(near)).collect()
    assert want and sorted(got.collect()) == sorted(want)


def test_the_sink_keeps_whole_graphs(spark, lines):
    """Node vectors, edges with features, labels and metadata of every graph, not node types alone."""
    rows = REGISTRY["sink_graphs"].spark_df(spark, lines).collect()
    of = {item: [r for r in rows if r["item"] == item] for item in ("node", "edge", "graph")}
    assert sum(map(len, of.values())) == len(rows)
    x = REGISTRY["node_features"].spark_df(spark, lines).collect()
    e = REGISTRY["edge_features"].spark_df(spark, lines).collect()
    assert sorted((r["graph_id"], r["node_id"], r["x"]) for r in of["node"]) == sorted(map(tuple, x))
    assert sorted((r["graph_id"], r["src"], r["dst"], r["edge_type"], r["ef"]) for r in of["edge"]) == sorted(map(tuple, e))
    assert all(r["node_type"] for r in of["node"]) and {r["split"] for r in rows} == {"train", "val", "test"}
    ids = sorted(r["graph_id"] for r in of["graph"])
    assert ids == sorted({r["graph_id"] for r in of["node"]})
    assert all(len(r["y"]) == 9 and r["project"] and r["commit_id"] for r in of["graph"]) and any(any(r["y"]) for r in of["graph"])
