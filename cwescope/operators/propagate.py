"""Message passing and pooling over node feature tables.

Features are wide rows ``x(graph_id, node_id, f_0 .. f_{D-1})`` (one row per
node, one double column per dimension); edges are ``(graph_id, src, dst)``.
One propagation step is a join of the edges with the source features and a
grouped sum per (graph_id, dst): a message row carries all D dimensions, so
the joins move E rows, not E x D. Edges must be distinct, as generated ones
are (``distinct_edges`` for others); edges from a node to itself are dropped
and self loops are added on the node side, without a union or a distinct of
the edges. ``long_form`` gives the (graph_id, node_id, dim, x) layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.session import materialize

SCALAR_FEATURES = ["f0", "f1", "f2", "f3"]


def node_scalar_features(nodes: DataFrame) -> DataFrame:
    """Four scalar features per node: scaled child count, scaled depth,
    leaf, named."""
    return nodes.select("graph_id", "node_id",
                        F.least(F.col("child_count") / 10.0, F.lit(1.0)).alias("f0"),
                        F.least(F.col("depth") / 50.0, F.lit(1.0)).alias("f1"),
                        F.col("is_leaf").cast("double").alias("f2"),
                        F.col("is_named").cast("double").alias("f3"))


def long_form(x: DataFrame, cols: list[str] = SCALAR_FEATURES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("x")) for i, c in enumerate(cols)])
    return x.select("graph_id", "node_id", F.explode(rows).alias("t")).select("graph_id", "node_id", "t.dim", "t.x")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (graph_id, src, dst), for edges of unknown origin."""
    return edges.select("graph_id", "src", "dst").dropDuplicates(["graph_id", "src", "dst"])


def _between(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "src", "dst").where("src <> dst")


def with_self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    loops = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return _between(edges).unionByName(loops)


def _src(x: DataFrame, cols: list[str], extra: list[Column] | None = None) -> DataFrame:
    return x.select("graph_id", F.col("node_id").alias("src"), *cols, *(extra or [])).hint("merge")


def gcn_propagate(nodes: DataFrame, edges: DataFrame, x: DataFrame,
                  cols: list[str] = SCALAR_FEATURES) -> DataFrame:
    """x'_v = sum over u -> v (self loop included) of x_u / sqrt(d_u * d_v),
    d = in-degree with the self loop.

    With z_u = x_u / sqrt(d_u) on the nodes, x'_v = (z_v + sum of z_u) /
    sqrt(d_v): one aggregate and one join of the edges."""
    e = _between(edges)
    deg = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("_in"))
    root = F.sqrt(F.coalesce("_in", F.lit(0)) + F.lit(1.0))
    z = x.join(deg.hint("merge"), ["graph_id", "node_id"], "left").withColumn("_r", root)
    z = z.select("graph_id", "node_id", "_r", *[(F.col(c) / F.col("_r")).alias(c) for c in cols])
    near = e.join(_src(z, cols), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(
        *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = z.join(near.hint("merge"), ["graph_id", "node_id"], "left")
    return j.select("graph_id", "node_id", *[
        ((F.col(c) + F.coalesce(f"_s{i}", F.lit(0.0))) / F.col("_r")).alias(c) for i, c in enumerate(cols)])


def mean_propagate(nodes: DataFrame, edges: DataFrame, x: DataFrame,
                   cols: list[str] = SCALAR_FEATURES) -> DataFrame:
    """Row-normalized: mean of the in-neighbours' features, self included."""
    near = _between(edges).join(_src(x, cols), ["graph_id", "src"]).groupBy(
        "graph_id", F.col("dst").alias("node_id")).agg(
        F.count(F.lit(1)).alias("_in"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = x.join(near.hint("merge"), ["graph_id", "node_id"], "left")
    n = F.coalesce("_in", F.lit(0)) + F.lit(1.0)
    return j.select("graph_id", "node_id", *[
        ((F.col(c) + F.coalesce(f"_s{i}", F.lit(0.0))) / n).alias(c) for i, c in enumerate(cols)])


def sum_propagate(nodes: DataFrame, edges: DataFrame, x: DataFrame, cols: list[str] = SCALAR_FEATURES,
                  w_self: float = 1.0, w_neigh: float = 0.5) -> DataFrame:
    """GraphConv with scalar weights: w_self * x_v + w_neigh * sum of in-neighbours."""
    agg = edges.select("graph_id", "src", "dst").join(_src(x, cols), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")) \
        .agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = x.join(agg.hint("merge"), ["graph_id", "node_id"], "left")
    return j.select("graph_id", "node_id", *[
        (F.lit(w_self) * F.col(c) + F.lit(w_neigh) * F.coalesce(F.col(f"_s{i}"), F.lit(0.0))).alias(c)
        for i, c in enumerate(cols)])


# Fixed attention vectors of the single-head layer used for the checks.
GAT_A_SRC = [0.5, -0.25, 0.75, 0.1]
GAT_A_DST = [-0.3, 0.6, 0.2, 0.4]
GAT_SLOPE = 0.2


def _dot(cols: list[str], w: list[float]) -> Column:
    out = None
    for c, v in zip(cols, w):
        t = F.col(c) * F.lit(float(v))
        out = t if out is None else out + t
    return out


def gat_propagate(nodes: DataFrame, edges: DataFrame, x: DataFrame, cols: list[str] = SCALAR_FEATURES,
                  a_src: list[float] = GAT_A_SRC, a_dst: list[float] = GAT_A_DST,
                  slope: float = GAT_SLOPE) -> DataFrame:
    """One attention head (W = identity): score(u->v) = LeakyReLU(a_dst.x_v +
    a_src.x_u), softmax over the in-edges of v (self loop included), output
    = attention-weighted sum of x_u. Max-shifted softmax per (graph, dst). A
    node's own share is added on the node side (``x`` has a row for each node)."""
    x = x.where("graph_id IS NOT NULL AND node_id IS NOT NULL")
    ps, pd = _dot(cols, a_src), _dot(cols, a_dst)
    own = _leaky(ps + pd, slope)
    e = (_between(edges).join(_src(x, cols, [ps.alias("ps")]), ["graph_id", "src"])
         .join(x.select("graph_id", F.col("node_id").alias("dst"), pd.alias("pd"), own.alias("own")).hint("merge"),
               ["graph_id", "dst"]))
    e = e.withColumn("s", _leaky(F.col("ps") + F.col("pd"), slope))
    e = e.withColumn("m", F.greatest("own", F.max("s").over(Window.partitionBy("graph_id", "dst"))))
    e = e.withColumn("ex", F.exp(F.col("s") - F.col("m")))
    g = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(
        F.max("m").alias("_m"), F.sum("ex").alias("_z"),
        *[F.sum(F.col("ex") * F.col(c)).alias(f"_n{i}") for i, c in enumerate(cols)])
    j = x.withColumn("_own", own).join(g.hint("merge"), ["graph_id", "node_id"], "left")
    j = j.withColumn("_e", F.exp(F.col("_own") - F.coalesce("_m", "_own")))
    none = F.lit(0.0)
    return j.select("graph_id", "node_id", *[
        ((F.col("_e") * F.col(c) + F.coalesce(f"_n{i}", none)) / (F.col("_e") + F.coalesce("_z", none))).alias(c)
        for i, c in enumerate(cols)])


def graph_pool(x: DataFrame) -> DataFrame:
    """Mean, max and sum of node features per (graph, dim) from the long
    layout; mean||max is the combined pooling."""
    return x.groupBy("graph_id", "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"),
                                            F.sum("x").alias("sum"))


def graph_pool_wide(x: DataFrame, cols: list[str] = SCALAR_FEATURES) -> DataFrame:
    """Per graph: mean / max / sum of every feature column (one row per graph)."""
    return x.groupBy("graph_id").agg(*[f(c).alias(f"{n}_{c}") for c in cols
                                       for n, f in (("mean", F.avg), ("max", F.max), ("sum", F.sum))])


# --- several attention heads -------------------------------------------------------

@dataclass(frozen=True)
class Head:
    """Weights of one attention head: ``weight[i][j]`` takes input i to output
    j; ``a_src`` and ``a_dst`` score the outputs of an edge's ends."""
    weight: list[list[float]]
    a_src: list[float]
    a_dst: list[float]


def linear(cols: list[str], weight: list[list[float]], bias: list[float] | None = None) -> list[Column]:
    """x W + b as plain column expressions (``weight[i][j]``: input i, output j)."""
    if len(weight) != len(cols):
        raise ValueError(f"{len(cols)} columns, weights for {len(weight)}")
    out = []
    for j in range(len(weight[0])):
        terms = [F.col(c) * F.lit(float(weight[i][j])) for i, c in enumerate(cols)]
        out.append(sum(terms[1:], terms[0]) + F.lit(float(bias[j])) if bias else sum(terms[1:], terms[0]))
    return out


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def _leaky(x: Column, slope: float) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def gat_heads(edges: DataFrame, x: DataFrame, heads: list[Head], cols: list[str] = SCALAR_FEATURES,
              concat: bool = True, activate: bool = False, slope: float = GAT_SLOPE,
              parts: int | None = None) -> DataFrame:
    """Multi-head attention: per head, z = x W, score(u -> v) =
    LeakyReLU(a_src . z_u + a_dst . z_v), softmax over v's in-edges and itself,
    sum of z_u by weight. The heads' outputs stand side by side (``concat``) or
    are averaged; ``activate`` applies ELU. Output columns f0, f1, ...

    Softmax is shifted by the largest score. LeakyReLU rises, so that is the
    score of the largest a_src . z_u: a window over the edges, which the join with
    v has sorted already. One aggregate sums weights and weighted outputs of all
    heads at once. A node's own share is added on the node side. All steps are keyed
    by graph. ``parts``: ``x`` and the edges are read from tables in so many buckets
    by graph; nothing is shuffled or stored then."""
    width = len(heads[0].weight[0])
    zs = [[f"_z{k}_{j}" for j in range(width)] for k in range(len(heads))]
    z = x.select("graph_id", "node_id", *[e.alias(n) for h, names in zip(heads, zs)
                                          for e, n in zip(linear(cols, h.weight), names)])
    flat = [n for names in zs for n in names]
    ks = range(len(heads))
    z = z.select("graph_id", "node_id", *flat, *[_dot(zs[k], heads[k].a_src).alias(f"_s{k}") for k in ks],
                 *[_dot(zs[k], heads[k].a_dst).alias(f"_d{k}") for k in ks])
    z = z if parts else materialize(z)
    e = _between(edges)
    ends = z.select("graph_id", F.col("node_id").alias("dst"), *[F.col(f"_s{k}").alias(f"_o{k}") for k in ks],
                    *[f"_d{k}" for k in ks])

    def shift(own: str, k: int) -> Column:
        return _leaky(F.greatest(f"{own}{k}", f"_t{k}") + F.col(f"_d{k}"), slope)

    def weight(k: int) -> Column:
        return F.exp(_leaky(F.col(f"_s{k}") + F.col(f"_d{k}"), slope) - F.col(f"_m{k}"))

    into = Window.partitionBy("graph_id", "dst")
    met = e.join(_src(z, [*flat, *[f"_s{k}" for k in ks]]), ["graph_id", "src"]).join(ends.hint("merge"), ["graph_id", "dst"])
    met = met.select("*", *[F.max(f"_s{k}").over(into).alias(f"_t{k}") for k in ks])
    met = met.select("*", *[shift("_o", k).alias(f"_m{k}") for k in ks])
    met = met.select("graph_id", "dst", *flat, *[f"_t{k}" for k in ks], *[weight(k).alias(f"_e{k}") for k in ks])
    sums = met.groupBy("graph_id", F.col("dst").alias("node_id")).agg(
        *[F.max(f"_t{k}").alias(f"_t{k}") for k in ks], *[F.sum(f"_e{k}").alias(f"_w{k}") for k in ks],
        *[F.sum(F.col(f"_e{k}") * F.col(n)).alias(f"_n{n}") for k in ks for n in zs[k]])
    j = z.join(sums.hint("merge"), ["graph_id", "node_id"], "left").select("*", *[shift("_s", k).alias(f"_m{k}") for k in ks])
    none = F.lit(0.0)
    outs = [[(weight(k) * F.col(n) + F.coalesce(f"_n{n}", none)) / (weight(k) + F.coalesce(f"_w{k}", none))
             for n in zs[k]] for k in ks]
    if concat:
        out = [o for per_head in outs for o in per_head]
    else:
        out = [sum(same[1:], same[0]) / len(heads) for same in (list(t) for t in zip(*outs))]
    return j.select("graph_id", "node_id", *[(elu(o) if activate else o).alias(f"f{i}") for i, o in enumerate(out)])
