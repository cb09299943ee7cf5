"""Model selection, AUC buckets, threshold buckets, graph rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cwescope.operators import assemble as AS
from cwescope.operators import graph as G
from cwescope.operators import learn as LN
from cwescope.operators import metrics as M


def blobs(spark, n=240, classes=3, seed=1):
    """Two informative dimensions per class, noise elsewhere; a class that never occurs."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        y = rng.random(classes) < 0.4
        x = rng.normal(size=2 * classes + 4)
        x[:2 * classes] += np.repeat(np.where(y, 1.5, -1.5), 2)
        rows.append((i, x.tolist()))
        labels += [(i, c, int(v)) for c, v in enumerate(y)]
    feats = spark.createDataFrame(rows, "sample_id long, vec array<double>")
    ids = [feats.where(F.col("sample_id") % 10 < 6), feats.where(F.col("sample_id").cast("int") % 10 == 6),
           feats.where(F.col("sample_id") % 10 > 6)]
    return feats, spark.createDataFrame(labels, "sample_id long, cls long, y int"), *[d.select("sample_id") for d in ids]


def test_best_candidate_is_kept(spark):
    feats, labels, train, val, test = blobs(spark)
    candidates = [LN.Candidate(reg=1e6), LN.Candidate(reg=0.01), LN.Candidate(reg=0.01)]
    chosen = LN.select_model(feats, labels, [0, 1, 2, 7], train, val, candidates, by="f1")
    scores = {r["candidate"]: r for r in chosen.scores.collect()}
    assert [scores[i]["chosen"] for i in range(3)] == [False, True, False]  # the earlier one of equals
    assert scores[1]["val_f1"] == scores[2]["val_f1"] > scores[0]["val_f1"] and chosen.model.candidate.reg == 0.01
    assert chosen.model.per_class[7] == 0.0
    pred = chosen.predict(feats, labels, test).cache()
    n = test.count()
    assert pred.count() == 4 * n and pred.where("cls = 7 AND (y = 1 OR p > 0)").count() == 0
    limits = {r["cls"]: r["threshold"] for r in chosen.thresholds.collect()}
    assert all((r["p"] >= limits[r["cls"]]) == bool(r["yhat"]) for r in pred.collect())
    macro = M.prf_averaged(pred.where("cls < 3")).where("average = 'macro'").first()
    assert macro["f1"] > 0.9
    plain = LN.train_multilabel(feats, labels, [0, 1, 2], train, test)
    assert plain.count() == 3 * n and plain.where("(p >= 0.5) <> (yhat = 1)").count() == 0


def test_selection_refuses_unknown_scores_and_no_candidates(spark):
    feats, labels, train, val, _ = blobs(spark, 30)
    with pytest.raises(ValueError, match="f1 or fbeta"):
        LN.select_model(feats, labels, [0], train, val, [LN.Candidate()], by="auc")
    with pytest.raises(ValueError, match="no candidates"):
        LN.select_model(feats, labels, [0], train, val, [])


def auc(pairs):
    pos, neg = ([p for p, y in pairs if y == v] for v in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (0.5, 0.5001)])
def test_auc_of_scores_that_lie_close_together(spark, low, high):
    rng = np.random.default_rng(3)
    rows = [(i, c, int(rng.random() < 0.3 + 0.3 * p), float(low + (high - low) * round(p, 3)))
            for i, p in enumerate(rng.random(900)) for c in range(2)]
    pred = spark.createDataFrame(rows, "sample_id long, cls long, y int, p double")
    got = {r["cls"]: r["auc"] for r in M.roc_auc_per_class(pred).collect()}
    for c in range(2):
        assert abs(got[c] - auc([(p, y) for _, k, y, p in rows if k == c])) < 1e-12
    d = pred.groupBy("cls", "p").count()
    b = d.join(M._score_bounds(d, M.AUC_BUCKETS), "cls").withColumn("b", M._quantile_bucket(
        F.col("bounds"), F.col("p"), M.AUC_BUCKETS))
    used = b.groupBy("cls", "b").count()
    assert used.count() > 2 * 0.8 * M.AUC_BUCKETS and used.agg(F.max("count")).first()[0] <= 16


def test_quantile_bucket_counts_bounds(spark):
    bounds = [0.1, 0.1, 0.2, 0.5, 0.5, 0.5, 0.9]
    ps = [-1.0, 0.1, 0.15, 0.2, 0.49, 0.5, 0.89, 0.9, 7.0]
    df = spark.createDataFrame([(p, bounds) for p in ps], "p double, bounds array<double>")
    got = [r[0] for r in df.select(M._quantile_bucket(F.col("bounds"), F.col("p"), 8)).collect()]
    assert got == [sum(b <= p for b in bounds) for p in ps]


def test_thresholds_at_grid_points(spark):
    """Scores on the grid points and next to them fall on the right side."""
    grid = M.threshold_grid()
    ps = sorted({x for t in grid for x in (t, np.nextafter(t, 0), np.nextafter(t, 1))} | {0.0, 0.05, 0.95, 1.0, -1.0, 2.0})
    rng = np.random.default_rng(5)
    rows = [(i, c, int(rng.random() < p), float(p)) for c in range(4) for i, p in enumerate(ps)]
    got = {r["cls"]: r for r in M.tune_thresholds(spark.createDataFrame(
        rows, "sample_id long, cls long, y int, p double")).collect()}
    for c in range(4):
        best = (0.0, 0, 0.5)
        for i, t in enumerate(grid):
            own = [(y, p >= t) for _, k, y, p in rows if k == c]
            tp, wrong = sum(y and h for y, h in own), sum(bool(y) != h for y, h in own)
            f1 = 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0
            if f1 > best[0]:
                best = (f1, i, t)
        assert got[c]["threshold"] == best[2] and abs(got[c]["best_f1"] - best[0]) < 1e-12


def test_graph_rows(spark):
    x = spark.createDataFrame([(1, 1, [0.5, 2.0]), (1, 0, [1.0, 0.0]), (2, 0, [3.0, 3.0])],
                              "graph_id long, node_id long, x array<double>")
    e = spark.createDataFrame([(1, 1, 0, [0.0, 1.0]), (1, 0, 1, [1.0, 0.0])],
                              "graph_id long, src long, dst long, ef array<double>")
    labels = spark.createDataFrame([(1, [0, 1])], "graph_id long, y array<int>")
    about = spark.createDataFrame([(1, "p", 7), (3, "q", 8)], "graph_id long, project string, size int")
    got = {r["graph_id"]: r for r in AS.graph_rows(x, e, labels, about).collect()}
    assert set(got) == {1, 2}
    assert got[1]["x"] == [[1.0, 0.0], [0.5, 2.0]] and [tuple(p) for p in got[1]["edge_index"]] == [(0, 1), (1, 0)]
    assert got[1]["edge_attr"] == [[1.0, 0.0], [0.0, 1.0]] and got[1]["y"] == [0, 1]
    assert (got[1]["metadata"]["project"], got[1]["metadata"]["size"]) == ("p", 7)
    assert got[2]["edge_index"] == [] and got[2]["edge_attr"] == [] and got[2]["y"] is None and got[2]["metadata"] is None


def test_validity_reasons(spark):
    ids = spark.createDataFrame([(i,) for i in range(6)], "graph_id long")
    nodes = ids.where("graph_id > 0").select("graph_id", F.lit(0).cast("long").alias("node_id"))
    x = nodes.select("graph_id", "node_id", F.when(F.col("graph_id") == 1, F.array().cast("array<double>")).otherwise(
        F.array(F.lit(1.0))).alias("x"))
    labels = ids.where("graph_id <> 2")
    edges = spark.createDataFrame([(3, -1, 0), (4, 0, 1), (5, 0, 0)], "graph_id long, src long, dst long")
    got = {r["graph_id"]: (r["valid"], r["reason"]) for r in G.graph_validity(ids, nodes, edges, labels, x).collect()}
    assert got == {0: (False, "no nodes"), 1: (False, "no features"), 2: (False, "no labels"),
                   3: (False, "negative endpoint"), 4: (False, "endpoint out of range"), 5: (True, None)}
    assert G.graph_validity(ids, nodes, edges, labels).where("graph_id = 1").first()["valid"]


def test_features_without_room_for_an_offset(spark):
    texts = spark.createDataFrame([(1, "free(strcpy)")], "graph_id long, code string")
    nodes = G.with_group_text(G.tree_nodes(texts), texts)
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["a", "b", "c", "d", "e", "f", "identifier"])],
                                  "node_type string, type_id int")
    x = {r["node_id"]: r["x"] for r in G.node_features(nodes, vocab, 14).collect()}
    words = {r["text"]: x[r["node_id"]] for r in nodes.where("node_type = 'identifier'").collect()}
    assert set(words) == {"free", "strcpy"}
    for v in words.values():  # the one-hot number stays where no flag is set
        assert v[6] == 1.0 and v[3] == 1.0


def test_digest_of_a_matrix(spark):
    """Half away from zero, place by place, in chunks; null where a number is missing."""
    ms = [[[0.5, -2.5, 0.0], [1e-7, 0.4999999, 123.4565]], [], None, [[1.0], None], [[None, 2.0]], [[], [7.0] * 5],
          [[0.0]], *([[float(i), -i / 8] for i in range(k)] for k in range(40))]
    df = spark.createDataFrame(list(enumerate(ms)), "id int, m array<array<double>>")

    def want(m, scale):
        if m is None or any(v is None or None in v for v in m):
            return None
        return sum(int(math.copysign(math.floor(abs(a * scale) + 0.5), a)) * ((i * 31 + j * 17) % 997 + 1)
                   for i, v in enumerate(m) for j, a in enumerate(v))

    for scale in (1, 1_000_000):
        got = df.repartition(1).select("id", AS.matrix_digest("m", scale).alias("d"))
        assert {r["id"]: r["d"] for r in got.collect()} == {i: want(m, scale) for i, m in enumerate(ms)}


def test_digest_chunks(monkeypatch):
    rows = pa.array([[[float(i + j + k) for k in range(j % 3)] for j in range(i)] for i in range(20)], pa.list_(pa.list_(pa.float64())))
    whole = AS._digests(rows, 1)
    monkeypatch.setattr(AS, "CHUNK", 7)
    assert AS._digests(rows, 1).equals(whole) and AS._digests(rows.slice(5, 9), 1).equals(whole.slice(5, 9))
    with pytest.raises(OverflowError):
        AS._digests(pa.array([[[float("nan")]]], pa.list_(pa.list_(pa.float64()))), 1)
