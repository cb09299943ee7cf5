"""Batch scoring of graphs with given weights.

Layers of graph convolution (linear map, propagation with symmetric degrees,
batch norm in inference form, ReLU), pooling of a graph's nodes, a head of two
dense layers, sigmoid, labels by threshold, next to the true label. Features are
wide rows (one double column per dimension), so a layer is one join and one
aggregate of the edges whatever its width; linear maps are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.operators.propagate import linear

EPSILON = 1e-5
POOLS = ("mean", "max", "sum", "mean_max")


@dataclass(frozen=True)
class BatchNorm:
    """Running statistics and affine weights, one number per dimension."""
    mean: list[float]
    variance: list[float]
    gamma: list[float]
    beta: list[float]
    epsilon: float = EPSILON

    def __call__(self, x: Column, j: int) -> Column:
        scale = self.gamma[j] / (self.variance[j] + self.epsilon) ** 0.5
        return (x - F.lit(self.mean[j])) * F.lit(scale) + F.lit(self.beta[j])


@dataclass(frozen=True)
class Layer:
    """``weight[i][j]``: input i, output j."""
    weight: list[list[float]]
    bias: list[float]
    norm: BatchNorm | None = None
    relu: bool = True


@dataclass(frozen=True)
class Dense:
    """Head: hidden layer with ReLU, then one logit per class."""
    hidden: list[list[float]]
    hidden_bias: list[float]
    out: list[list[float]]
    out_bias: list[float]


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gcn_layers(edges: DataFrame, x: DataFrame, cols: list[str], layers: list[Layer],
               parts: int | None = None) -> tuple[DataFrame, list[str]]:
    """(graph_id, node_id, columns; their names) behind the layers. Edges are
    distinct; loops are dropped and every node (one row of ``x``) is its own
    neighbour. Degrees are counted once. Each node meets itself as one more edge,
    so a layer's input is used once and is not stored. Edges and ``x`` that are
    read from tables in ``parts`` buckets by graph are not shuffled either."""
    e = edges.select("graph_id", "src", "dst").where("src <> dst")
    degree = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("_in"))
    x = x.join(degree.hint("merge"), ["graph_id", "node_id"], "left").select(
        "graph_id", "node_id", *cols, F.sqrt(F.coalesce("_in", F.lit(0)) + F.lit(1.0)).alias("_r"))
    # the join has sorted by node: its first row also goes to the node itself, with its degree
    nth = F.row_number().over(Window.partitionBy("graph_id", "src").orderBy("src"))
    ahead = F.struct(F.col("dst").alias("node_id"), F.lit(None).cast("double").alias("_r"))
    to = F.when(F.col("_n") == 1, F.array(F.struct(F.col("src").alias("node_id"), "_r"), ahead)).otherwise(F.array(ahead))
    for layer in layers:
        names = [f"f{j}" for j in range(len(layer.bias))]
        z = x.select("graph_id", F.col("node_id").alias("src"), "_r", *[
            (v / F.col("_r")).alias(n) for v, n in zip(linear(cols, layer.weight), names)])
        met = z.join(e.hint("merge"), ["graph_id", "src"], "left").withColumn("_n", nth)
        met = met.select("graph_id", *names, F.explode(to).alias("_t")).where("_t.node_id IS NOT NULL OR _t._r IS NOT NULL")
        sums = met.groupBy("graph_id", F.col("_t.node_id").alias("node_id")).agg(
            F.max("_t._r").alias("_r"), *[F.sum(n).alias(n) for n in names]).where("_r IS NOT NULL")
        out = []
        for j, n in enumerate(names):
            v = F.col(n) / F.col("_r") + F.lit(float(layer.bias[j]))
            v = layer.norm(v, j) if layer.norm else v
            out.append((relu(v) if layer.relu else v).alias(n))
        x, cols = sums.select("graph_id", "node_id", "_r", *out), names
    return x.drop("_r"), cols


def pooled(x: DataFrame, cols: list[str], how: str = "mean") -> tuple[DataFrame, list[str]]:
    """(graph_id, columns; their names): ``mean``, ``max`` or ``sum`` of the
    nodes, or mean and max side by side."""
    if how not in POOLS:
        raise ValueError(f"pooling is one of {', '.join(POOLS)}")
    parts = {"mean": F.avg, "max": F.max, "sum": F.sum}
    names = [(p, c, f"{p}_{c}") for p in how.split("_") for c in cols]
    return x.groupBy("graph_id").agg(*[parts[p](c).alias(n) for p, c, n in names]), [n for *_, n in names]


def class_scores(graphs: DataFrame, cols: list[str], head: Dense) -> DataFrame:
    """sample_id, cls, p of every graph and class."""
    hidden = [f"_h{j}" for j in range(len(head.hidden_bias))]
    h = graphs.select("graph_id", *[relu(v).alias(n) for v, n in zip(
        linear(cols, head.hidden, head.hidden_bias), hidden)])
    logits = linear(hidden, head.out, head.out_bias)
    rows = F.array(*[F.struct(F.lit(c).cast("bigint").alias("cls"), (1.0 / (1.0 + F.exp(-z))).alias("p"))
                     for c, z in enumerate(logits)])
    return h.select(F.col("graph_id").alias("sample_id"), F.explode(rows).alias("t")).select("sample_id", "t.*")


def graph_scores(edges: DataFrame, x: DataFrame, cols: list[str], layers: list[Layer], head: Dense,
                 truth: DataFrame, pool: str = "mean", thresholds: list[float] | None = None,
                 parts: int | None = None) -> DataFrame:
    """sample_id, cls, y, p, yhat: the true label (``truth``: sample_id, cls of
    the positive ones), probability and label (p >= the class's threshold, 0.5
    by default) of each graph and class: the layout of every metric operator."""
    nodes, names = gcn_layers(edges, x, cols, layers, parts)
    scores = class_scores(*pooled(nodes, names, pool), head)
    positive = truth.select("sample_id", F.col("cls").cast("bigint").alias("cls")).distinct().withColumn("y", F.lit(1))
    limit = F.lit(0.5)
    if thresholds:
        limit = F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("cls").cast("int"))
    return scores.join(positive, ["sample_id", "cls"], "left").select(
        "sample_id", "cls", F.coalesce("y", F.lit(0)).alias("y"), "p", (F.col("p") >= limit).cast("int").alias("yhat"))
