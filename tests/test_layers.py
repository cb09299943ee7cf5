"""Attention heads and layer stacks against numpy, node by node."""

import numpy as np
import pytest

from cwescope.operators import propagate as P
from cwescope.operators import score as SC
from cwescope.session import bucketed

COLS = ["f0", "f1", "f2"]


def sample(spark, seed=1):
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for g, n in enumerate([1, 2, 7, 12]):
        nodes += [(g, v, *rng.normal(size=3).tolist()) for v in range(n)]
        pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (2 * n, 2))}
        edges += [(g, a, b) for a, b in pairs]
    x = spark.createDataFrame(nodes, "graph_id long, node_id long, f0 double, f1 double, f2 double")
    e = spark.createDataFrame(edges, "graph_id long, src long, dst long")
    return nodes, edges, x, e


def graphs(nodes, edges):
    for g in sorted({r[0] for r in nodes}):
        x = np.array([r[2:] for r in nodes if r[0] == g])
        a = np.eye(len(x))
        for h, s, t in edges:
            if h == g:
                a[t, s] = 1  # row: target
        yield g, x, a


def by_node(df):
    return {(r["graph_id"], r["node_id"]): np.array(r[2:]) for r in df.collect()}


@pytest.mark.parametrize("concat, activate, scale", [(True, True, 1), (False, False, 1), (True, False, 500)])
def test_heads(spark, concat, activate, scale):
    nodes, edges, x, e = sample(spark)
    rng = np.random.default_rng(2)
    heads = [P.Head((scale * rng.normal(size=(3, 2))).tolist(), rng.normal(size=2).tolist(), rng.normal(size=2).tolist())
             for _ in range(3)]
    got = by_node(P.gat_heads(e, x, heads, COLS, concat, activate))
    assert len(got) == len(nodes)
    for g, h, a in graphs(nodes, edges):
        outs = []
        for k in heads:
            z = h @ np.array(k.weight)
            s = (z @ np.array(k.a_dst))[:, None] + (z @ np.array(k.a_src))[None, :]
            s = np.where(s >= 0, s, P.GAT_SLOPE * s)
            s = np.where(a > 0, s, -np.inf)
            w = np.exp(s - s.max(axis=1, keepdims=True))
            outs.append(w / w.sum(axis=1, keepdims=True) @ z)
        want = np.concatenate(outs, axis=1) if concat else sum(outs) / len(outs)
        want = np.where(want > 0, want, np.expm1(want)) if activate else want
        for v in range(len(h)):
            assert np.allclose(got[g, v], want[v], atol=1e-9)


@pytest.mark.parametrize("pool", SC.POOLS)
def test_scores(spark, pool):
    nodes, edges, x, e = sample(spark, 3)
    rng = np.random.default_rng(4)

    def norm(n):
        return SC.BatchNorm(*(rng.uniform(0.5, 1.5, n).tolist() for _ in range(4)))

    layers = [SC.Layer(rng.normal(size=(3, 5)).tolist(), rng.normal(size=5).tolist(), norm(5)),
              SC.Layer(rng.normal(size=(5, 4)).tolist(), rng.normal(size=4).tolist(), norm(4)),
              SC.Layer(rng.normal(size=(4, 2)).tolist(), rng.normal(size=2).tolist(), None, relu=False)]
    width = 4 if pool == "mean_max" else 2
    head = SC.Dense(rng.normal(size=(width, 3)).tolist(), rng.normal(size=3).tolist(),
                    rng.normal(size=(3, 2)).tolist(), rng.normal(size=2).tolist())
    truth = spark.createDataFrame([(0, 1), (2, 0), (2, 0), (99, 1)], "sample_id long, cls int")
    rows = SC.graph_scores(e, x, COLS, layers, head, truth, pool, [0.4, 0.6]).collect()
    got = {(r["sample_id"], r["cls"]): r for r in rows}
    assert len(got) == len(rows) == 8 and {k for k, r in got.items() if r["y"]} == {(0, 1), (2, 0)}
    for g, h, a in graphs(nodes, edges):
        d = a.sum(axis=1) ** -0.5
        a = d[:, None] * a * d[None, :]
        for q in layers:
            h = a @ (h @ np.array(q.weight)) + q.bias
            if q.norm:
                b = q.norm
                h = (h - b.mean) / np.sqrt(np.array(b.variance) + b.epsilon) * b.gamma + b.beta
            h = np.maximum(h, 0) if q.relu else h
        v = np.concatenate([{"mean": h.mean, "max": h.max, "sum": h.sum}[p](axis=0) for p in pool.split("_")])
        z = np.maximum(v @ np.array(head.hidden) + head.hidden_bias, 0) @ np.array(head.out) + head.out_bias
        for c in range(2):
            p = 1 / (1 + np.exp(-z[c]))
            assert abs(got[g, c]["p"] - p) < 1e-9 and got[g, c]["yhat"] == (p >= [0.4, 0.6][c])


def test_wrong_width_is_refused(spark):
    *_, x, e = sample(spark)
    with pytest.raises(ValueError, match="3 columns, weights for 2"):
        SC.gcn_layers(e, x, COLS, [SC.Layer([[1.0], [1.0]], [0.0])])
    with pytest.raises(ValueError, match="pooling"):
        SC.pooled(x, COLS, "median")


def test_layers_store_and_shuffle_nothing_of_buckets(spark):
    """Tables in buckets by graph: no layer's input is written, nothing is dealt again."""
    *_, x, e = sample(spark)
    x, e = (bucketed(t, "graph_id", 3) for t in (x, e))
    layers = [SC.Layer(np.eye(3).tolist(), [0.0] * 3) for _ in range(3)]
    heads = [P.Head(np.eye(3).tolist(), [1.0] * 3, [0.5] * 3)]
    for df in (SC.gcn_layers(e, x, COLS, layers, 3)[0], P.gat_heads(e, x, heads, COLS, parts=3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        assert len(names) == 2, names


def test_nodes_without_a_key_keep_to_themselves(spark):
    x = spark.createDataFrame([(None, 0, 2.0), (None, 1, 3.0), (1, 0, 4.0), (1, 1, 6.0)],
                              "graph_id long, node_id long, f0 double")
    e = spark.createDataFrame([(None, 0, 1), (1, 0, 1), (1, 5, 0), (1, 0, 7)], "graph_id long, src long, dst long")
    got = SC.gcn_layers(e, x, ["f0"], [SC.Layer([[1.0]], [0.5], relu=False)])[0]
    want = [(None, 0, 2.5), (None, 1, 3.5), (1, 0, 4 / 2 + 0.5), (1, 1, (4 / 2 ** 0.5 + 6 / 2 ** 0.5) / 2 ** 0.5 + 0.5)]
    rows = sorted(map(tuple, got.collect()), key=lambda r: (r[0] or 0, r[1]))
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    assert np.allclose([r[2] for r in rows], [w[2] for w in want])
