"""Exact top-k by integer inner product: ball trees, branch and bound.

Vectors become ``floor(64 * x)``. Every vector lies in one shard (a hash of
its id, about ``SHARD_ROWS`` each); each shard is one ball tree, built in a
task. Queries are packed in blocks. Every block meets every shard, as a join
on the shard number of replicated blocks:

1. each block searches one shard, which gives each query a first k-th score;
2. the best such score of a query is its floor when it searches the other
   shards: nodes whose bound is below the current k-th score are cut.

Inside a shard the nodes are visited depth first, the child with the larger
bound ``<q, centre> + |q| * radius`` first, for all queries of the block that
the bound does not cut. The lists of the shards are merged per query by a
window over at most k rows from each shard.

A vector that is null, empty, or holds a null or a component that is not
finite takes no part. Only vectors of one length meet. Ties go to the smaller
id; a repeated id is a candidate for each of its rows and never for a query
of the same id; repeated query rows give one list. Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cwescope.llm.common import ship, store

ship(__name__)

SCALE = 64
TOP_K = 20
QUERY_STEP = 20
SHARD_ROWS = 4096
BLOCK_ROWS = 64
LEAF_ROWS = 64
#: Below every score.
LOW = -(1 << 62)
HIGH = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """id, dim, ints (array of floor(64 * x)) of the vectors that take part."""
    def finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    return rows.select("id", F.size("x").alias("dim"),
                       F.transform("x", lambda v: F.floor(v * F.lit(float(SCALE)))).alias("ints"))


# ---- inside tasks ------------------------------------------------------------

class BallTree:
    """Nodes over rows of ``points`` (reordered in place by ``order``)."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._grow(points, 0, len(points), leaf_rows)

    def _grow(self, points, lo, hi, leaf_rows) -> int:
        rows = points[self.order[lo:hi]]
        centre = rows.mean(axis=0)
        gap = rows - centre
        radius = float(np.sqrt((gap * gap).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append((lo, hi, centre, radius, -1, -1))
        if hi - lo > leaf_rows and radius > 0:
            # halve along the line between two far points; identical rows end as one leaf
            a = rows[np.argmax((gap * gap).sum(axis=1))]
            b = rows[np.argmax(((rows - a) ** 2).sum(axis=1))]
            mid = (lo + hi) // 2
            side = np.argpartition(rows @ (b - a), mid - lo)
            self.order[lo:hi] = self.order[lo:hi][side]
            left = self._grow(points, lo, mid, leaf_rows)
            right = self._grow(points, mid, hi, leaf_rows)
            self.nodes[at] = (lo, hi, centre, radius, left, right)
        return at


def _best(points: np.ndarray, ids: np.ndarray, tree: BallTree, queries: np.ndarray,
          query_ids: np.ndarray, floor: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query the rows of its k best, none below its floor. ``ids`` ascend."""
    n, m = len(points), len(queries)
    rows = points[tree.order]
    own = ids[tree.order]
    # one number orders by score and then by smaller row (= smaller id)
    low = LOW
    best = np.full((m, k), low, np.int64)
    kth = np.where(floor > low, floor * n, low)  # least key that may still enter
    norm = np.sqrt((queries * queries).sum(axis=1))

    def bounds(node, active):
        _, _, centre, radius, _, _ = tree.nodes[node]
        top = queries[active] @ centre + norm[active] * radius
        return top + 1e-6 * (1 + np.abs(top))  # rounding of the bound itself

    def visit(node, active):
        lo, hi, _, _, left, right = tree.nodes[node]
        if left < 0:
            scores = np.rint(queries[active] @ rows[lo:hi].T).astype(np.int64)
            keys = scores * n + (n - 1 - tree.order[lo:hi])
            keys[query_ids[active][:, None] == own[lo:hi][None, :]] = low
            keys[keys < kth[active][:, None]] = low
            merged = np.concatenate([best[active], keys], axis=1)
            merged.partition(merged.shape[1] - k, axis=1)
            best[active] = merged[:, -k:]
            kth[active] = np.maximum(kth[active], merged[:, -k:].min(axis=1))
            return
        pair = sorted(((bounds(c, active), c) for c in (left, right)), key=lambda x: -x[0].max())
        for top, child in pair:
            alive = np.floor(top) >= np.floor_divide(kth[active], n)
            if alive.any():
                visit(child, active[alive])

    visit(0, np.arange(m))
    out = []
    for row in best:
        row = np.sort(row[row > low])[::-1]
        out.append(row)
    return out


def too_wide(points: np.ndarray, queries: np.ndarray) -> bool:
    """Whether a score, or a score with a row number behind it, may not be
    exact in the search's numbers."""
    top = [float(np.abs(a.astype(np.float64)).max()) if a.size else 0.0 for a in (points, queries)]
    return top[0] * top[1] * points.shape[1] >= 2.0 ** 52 / max(1, len(points) / 1024)


def _best_wide(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best by all products, for numbers beyond the search's. Products
    modulo 2**64 are exact where the score fits; others are the nearest number
    that does."""
    out = []
    for q, own in zip(queries, query_ids):
        score = points @ q
        about = points.astype(np.float64) @ q.astype(np.float64)
        score = np.where(about >= 2.0 ** 63, HIGH, np.where(about <= -2.0 ** 63, -HIGH, score))
        score, row_ids = score[ids != own], ids[ids != own]
        by = np.lexsort((row_ids, -score))[:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": row_ids[by], "score": score[by]}))
    return pd.concat(out)


def _search(k: int):
    """For mapInPandas over one shard row and then its block rows, and so on."""
    def run(frames):
        import sys

        sys.setrecursionlimit(10_000)
        ids = points = tree = whole = None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                row_ids = np.frombuffer(r.ids, np.int64)
                exact = np.frombuffer(r.vectors, np.int64).reshape(len(row_ids), -1)
                rows = exact.astype(np.float64)
                if r.block < 0:
                    ids, points, tree, whole = row_ids, rows, BallTree(rows), exact
                    continue
                if too_wide(whole, exact):
                    yield _best_wide(whole, ids, exact, row_ids, k)
                    continue
                floor = (np.full(len(row_ids), LOW) if r.floors is None
                         else np.frombuffer(r.floors, np.int64))
                found = _best(points, ids, tree, rows, row_ids, floor, k)
                keys = np.concatenate(found)
                yield pd.DataFrame({
                    "query_id": np.repeat(row_ids, [len(x) for x in found]),
                    "vec_id": ids[len(ids) - 1 - keys % len(ids)], "score": keys // len(ids)})
    return run


def _pack(keys, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (id, ints) of one group as one row of packed arrays, by id."""
    pdf = pdf.sort_values("id", kind="stable")
    flat = np.array(pdf["ints"].tolist(), dtype=np.int64)
    return pd.DataFrame({"dim": [keys[0]], "part": [keys[1]],
                         "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [flat.tobytes()]})


def _pack_floors(keys, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    low = pdf["low"].astype("Int64").fillna(LOW).to_numpy(np.int64)
    return pd.DataFrame({"dim": [keys[0]], "part": [keys[1]], "floors": [low.tobytes()]})


PACKED = "dim int, part int, ids binary, vectors binary"


def _met(shards: DataFrame, blocks: DataFrame, n_shards: int, k: int) -> DataFrame:
    """Each shard with the blocks that name it, searched in one task."""
    shards = shards.withColumns({"block": F.lit(-1), "floors": F.lit(None).cast("binary")})
    return (shards.unionByName(blocks)
            .repartition(max(12, n_shards), "dim", "shard").sortWithinPartitions("dim", "shard", "block")
            .mapInPandas(_search(k), "query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, k: int = TOP_K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose
    id is divisible by ``step``, against all rows but those of its own id.
    Scores are exact; one that does not fit 64 bits is the nearest that does."""
    rows = store(usable(vectors), "topk-rows")
    n = rows.count()
    n_shards = max(1, -(-n // SHARD_ROWS))
    n_blocks = max(1, -(-n // (step * BLOCK_ROWS)))
    in_shards = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int"))
    shards = store(in_shards.groupBy("dim", "shard").applyInPandas(_pack, PACKED)
                   .withColumnRenamed("part", "shard"), "topk-shards")
    asked = rows.where(F.col("id") % step == 0).groupBy("id", "dim").agg(F.min("ints").alias("ints"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_blocks)).cast("int"))
    # a block can only meet shards of its length; its home is one of them
    homes = shards.groupBy("dim").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    blocks = (asked.groupBy("dim", "block").applyInPandas(_pack, PACKED).withColumnRenamed("part", "block")
              .join(homes, "dim")
              .withColumn("home", F.get("shards", F.pmod("block", F.size("shards")))))
    blocks = store(blocks, "topk-blocks")
    columns = ["dim", "shard", "ids", "vectors", "block", "floors"]
    none = F.lit(None).cast("binary").alias("floors")
    first = store(_met(shards, blocks.withColumn("shard", F.col("home")).select(*columns[:-1], none),
                       n_shards, k), "topk-first")
    # the k-th score in the home shard, where there are k, is the floor elsewhere
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "low")
    floors = (asked.select("id", "dim", "block").join(kth, "id", "left")
              .groupBy("dim", "block").applyInPandas(_pack_floors, "dim int, part int, floors binary")
              .withColumnRenamed("part", "block"))
    others = F.filter("shards", lambda s: s != F.col("home"))
    rest = blocks.join(floors, ["dim", "block"]).withColumn("shard", F.explode(others)).select(*columns)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(_met(shards, rest, n_shards, k))
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
