"""Graphs as rows: the contract between the graph tables and a model.

One row per graph: node feature matrix, edge pairs, edge features, label
vector, sample id and metadata. Row i of the matrix is node i; edge k's features
stand at place k of the pairs, which are sorted by (src, dst). Graphs are the
unit here: one that does not fit into a task's memory does not fit into a model
either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.session import ship

ship(__name__)

#: Numbers that a digest takes up at a time.
CHUNK = 200_000
EDGE_ITEM = "array<struct<src:bigint,dst:bigint,ef:array<double>>>"


def graph_rows(x: DataFrame, edges: DataFrame, labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """graph_id, x (array of node vectors), edge_index (array of src, dst),
    edge_attr (array of edge vectors), y, metadata.

    ``x``: graph_id, node_id, x; ``edges``: graph_id, src, dst, ef, distinct;
    ``labels``: graph_id, y (array of 0 / 1); ``metadata``: graph_id and any
    columns, which become one struct. A graph without edges has empty lists, one
    without labels or metadata nulls there."""
    nodes = x.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "x"))).alias("n"))
    lists = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "ef"))).alias("e"))
    about = metadata.select("graph_id", F.struct(*[c for c in metadata.columns if c != "graph_id"]).alias("metadata"))
    e = F.coalesce("e", F.array().cast(EDGE_ITEM))
    return (nodes.join(lists.hint("merge"), "graph_id", "left").join(labels.select("graph_id", "y"), "graph_id", "left")
            .join(about, "graph_id", "left")
            .select("graph_id", F.transform("n", lambda s: s["x"]).alias("x"),
                    F.transform(e, lambda s: F.struct(s["src"].alias("src"), s["dst"].alias("dst"))).alias("edge_index"),
                    F.transform(e, lambda s: s["ef"]).alias("edge_attr"), "y", "metadata"))


def _digests(rows: pa.Array, scale: int) -> pa.Array:
    """``matrix_digest`` of matrices in Arrow's form, ``CHUNK`` numbers at a time."""
    inner = rows.values
    outer, starts = (np.asarray(a.offsets).astype(np.int64) for a in (rows, inner))
    numbers = inner.values
    gaps = np.asarray(numbers.is_null()) if numbers.null_count else None
    lost = np.asarray(rows.is_null())
    if inner.null_count:
        none = np.concatenate([[0], np.cumsum(np.asarray(inner.is_null()))])
        lost = lost | (none[outer[1:]] > none[outer[:-1]])
    ends, out, a = starts[outer], np.zeros(len(rows), np.int64), 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
        v = numbers.slice(ends[a], ends[b] - ends[a]).to_numpy(zero_copy_only=False) * float(scale)
        if gaps is not None:
            missing = np.flatnonzero(gaps[ends[a]:ends[b]])
            v[missing] = 0.0
            lost[a:b][np.searchsorted(ends[a:b + 1] - ends[a], missing, "right") - 1] = True
        at = np.flatnonzero(v)  # zeros add nothing, wherever they stand
        v = v[at]
        row = np.searchsorted(starts[outer[a]:outer[b] + 1] - ends[a], at, "right") - 1 + outer[a]
        matrix = np.searchsorted(outer[a:b + 1], row, "right") - 1 + a
        weight = ((row - outer[matrix]) * 31 + (at + ends[a] - starts[row]) * 17) % 997 + 1
        whole = np.floor(np.abs(v))
        whole = np.copysign(whole + (np.abs(v) - whole >= 0.5), v)  # half away from zero
        # in doubles: what is not finite or does not fit shows here
        if not np.abs(whole * weight).sum() < 2.0 ** 62:
            raise OverflowError("a matrix has numbers that its digest cannot hold")
        sums = np.concatenate([[0], np.cumsum(whole.astype(np.int64) * weight)])
        edges = np.searchsorted(matrix, np.arange(a, b + 1))
        out[a:b] = sums[edges[1:]] - sums[edges[:-1]]
        a = b
    return pa.array(out, mask=lost)


def matrix_digest(rows, scale: int = 1_000_000):
    """An integer that depends on each number of a matrix, rounded to
    1 / ``scale``, and on its place; null if one of them is null."""
    @F.arrow_udf("bigint")
    def digest(matrices: pa.Array) -> pa.Array:
        return _digests(matrices, scale)

    return digest((F.col(rows) if isinstance(rows, str) else rows).cast("array<array<double>>"))
