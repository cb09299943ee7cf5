"""Properties: splits, AUC symmetry, thresholds on the grid, pooling and
partition-count invariance, tree invariants."""

import pytest
from pyspark.sql import functions as F

from cwescope.operators import corpus as C
from cwescope.operators import graph as G
from cwescope.operators import labelsets as L
from cwescope.operators import metrics as M
from cwescope.operators import propagate as P
from cwescope.sources import views as V
from cwescope.sources.tables import table


def test_split_stratified_disjoint_complete(spark, sf):
    ud = V.user_days(spark, sf).groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("combo"))
    s = C.split_stratified(ud, "id", "combo")
    assert s.count() == ud.count() == s.select("id").distinct().count()
    shares = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    n = sum(shares.values())
    assert abs(shares["train"] / n - 0.70) < 0.05
    assert abs(shares["val"] / n - 0.15) < 0.05


def test_split_sequential_boundaries(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    s = C.split_sequential(o, ["o_orderkey"])
    n = o.count()
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert got["train"] == int(n * 0.7) and got["val"] == int(n * 0.15)
    mx_train = s.where("split = 'train'").agg(F.max("o_orderkey")).first()[0]
    mn_val = s.where("split = 'val'").agg(F.min("o_orderkey")).first()[0]
    assert mx_train < mn_val


def test_auc_flips_with_labels(spark, sf):
    p = V.pred(spark, sf)
    a = {r["cls"]: r["auc"] for r in M.roc_auc_per_class(p).collect()}
    flipped = p.withColumn("y", 1 - F.col("y"))
    b = {r["cls"]: r["auc"] for r in M.roc_auc_per_class(flipped).collect()}
    for c in a:
        if a[c] is not None:
            assert a[c] + b[c] == pytest.approx(1.0, abs=1e-9)


def test_thresholds_on_grid(spark, sf):
    grid = set(M.threshold_grid()) | {0.5}
    for r in M.tune_thresholds(V.pred(spark, sf)).collect():
        assert r["threshold"] in grid


def test_pooling_order_invariant(spark, sf):
    x = spark.createDataFrame([(1, i, float(i), float(i % 3), 1.0, 0.0) for i in range(10)],
                              "graph_id long, node_id long, f0 double, f1 double, f2 double, f3 double")
    a = P.graph_pool_wide(x).first()
    b = P.graph_pool_wide(x.orderBy(F.desc("node_id")).repartition(3)).first()
    assert a == b
    assert P.graph_pool(P.long_form(x)).count() == 4


def test_partition_count_invariance(spark, sf):
    labels = V.tool_labels(spark, sf)
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"))
    a = sorted(L.compare_tools(labels.repartition(1), samples.repartition(1)).collect())
    b = sorted(L.compare_tools(labels.repartition(7), samples.repartition(5)).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        # float sums may differ in the last bits with the summation order
        for k, v in x.asDict().items():
            w = y[k]
            assert (v == pytest.approx(w, rel=1e-12)) if isinstance(v, float) else v == w


def test_tree_invariants(spark):
    texts = spark.createDataFrame([(1, "a(b{c[d]e}f)g"), (2, "}x{"), (3, "")], "graph_id long, code string")
    n = G.tree_nodes(texts)
    rows = {(r["graph_id"], r["node_id"]): r for r in n.collect()}
    # every non-root node has a parent with a smaller id and depth one less
    for (g, i), r in rows.items():
        if i == 0:
            assert r["parent"] is None and r["depth"] == 0
        else:
            p = rows[(g, r["parent"])]
            assert p["node_id"] < i and p["depth"] == r["depth"] - 1
    # child counts agree with parents
    kids = {}
    for (g, i), r in rows.items():
        if r["parent"] is not None:
            kids[(g, r["parent"])] = kids.get((g, r["parent"]), 0) + 1
    for k, r in rows.items():
        assert r["child_count"] == kids.get(k, 0)
    assert rows[(2, 1)]["has_error"]          # unmatched closer
    assert rows[(2, 3)]["has_error"]          # group never closed
    assert rows[(3, 0)]["child_count"] == 0   # empty text: root only
