"""Connected components, and components of similar pairs in buckets.

``components`` alternates large stars and small stars: each step links every
node to the least node it sees. A step is an aggregate (combined map-side) and
a join with its stored result, so a node with very many neighbours is split
like any skewed join. Edges are written to the shared folder after each step;
the driver learns only whether all edges point to roots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cwescope.llm.common import store


#: Edges per file of the stored tables: few edges take few files and tasks,
#: whatever the number of shuffle partitions.
FILE_EDGES = 500_000
#: Up to so many centres, 24 bytes each, are broadcast to their buckets.
BROADCAST_ROWS = 1_000_000


def _least(edges: DataFrame, files: int) -> DataFrame:
    """For edges (u, v): u with the least of u and its v."""
    return store(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).coalesce(files), "cc-least")


def _all_roots(e: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u."""
    if not e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node with an
    edge; ``edges`` has two long columns without nulls. Loops and repeated
    edges do no harm."""
    a, b = edges.columns[:2]
    # u > v in all stored edges
    e = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u <> v").distinct(), "cc-edges")
    files = 1 + e.count() // FILE_EDGES
    while not _all_roots(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = store(both.join(_least(both, files), "u").where("v > u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files), "cc-edges")
        least = _least(large, files)
        e = store(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
                  .coalesce(files), "cc-edges")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return store(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
                 .coalesce(files), "cc-roots")


def _centres(large: DataFrame, step: int, n: int) -> DataFrame:
    """The ``n`` least members of each bucket by a hash of the round, which are
    mostly the same nodes in all buckets of a group."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(step)), "node")
    first = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return store(first.select("bucket", F.col("node").alias("other"), F.col("root").alias("to")), "link-centres")


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], few: int = 1,
           resolve: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3,
           rationed: bool = False) -> DataFrame:
    """node, root: components of the similar pairs among nodes that share a
    bucket (``members``: bucket, node).

    ``verify`` takes distinct pairs (a < b) and returns (a, b, similar). A pair
    is open while its ends are not connected; only open pairs are verified. In a
    bucket with at most ``few`` open pairs per member all of them are. In a
    larger one each member meets some centres, one in the first round and twice
    as many in each round that follows: a group whose members are mostly similar
    is connected after a few members' worth of checks, and the few pairs that
    stay open between it and single members cost a row each, not a square.

    Buckets that are still open after ``rounds`` rounds hold many members that
    are not similar. They go to ``resolve`` (bucket, node, root), which compares
    their members in blocks, without a row for a pair, and returns links (a, b)
    that connect what is similar. Without it, rounds go on until no pair is open
    or every pair of the bucket has been verified. No candidate is lost.

    ``rationed`` spreads the pairs of small buckets over the rounds too: a node
    meets as many others as there are centres. A group whose pairs lie in many
    small buckets is then connected by about a link a member, and the pairs that
    this connects are never verified, instead of the square of its size."""
    links = tried = roots = None
    step, centres = 0, 1
    while True:
        here = members.withColumn("root", F.col("node")) if roots is None else (
            members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        here = store(here.select("bucket", "node", "root"), "link-here")
        per = here.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(
            F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("inner"))
        pairs = (F.col("n") * F.col("n") - F.col("inner")) / 2
        per = store(per.where(pairs > 0).select("bucket", "n", (pairs <= few * F.col("n")).alias("few")), "link-open")
        here = here.join(per, "bucket")
        small = here.where("few").select("bucket", "node", "root")
        asked = (small.join(small.select("bucket", F.col("node").alias("other"), F.col("root").alias("to")), "bucket")
                 .where((F.col("node") < F.col("other")) & (F.col("root") != F.col("to")))
                 .select("bucket", F.col("node").alias("a"), F.col("other").alias("b")))
        large = here.where(~F.col("few"))
        last = step == rounds and resolve is not None
        later = None
        if rationed and not last:
            if tried is not None:
                asked = asked.join(tried, ["a", "b"], "left_anti")
            order = Window.partitionBy("b").orderBy(F.xxhash64("a"), "a")
            asked = store(asked.withColumn("turn", F.dense_rank().over(order)), "link-turns")
            later = asked.where(F.col("turn") > centres).select("bucket").distinct()
            asked = asked.where(F.col("turn") <= centres)
        asked = asked.select("a", "b")
        if not last:
            centre = _centres(large, step, centres)
            if centre.count() <= BROADCAST_ROWS:
                centre = F.broadcast(centre)
            asked = asked.unionByName(large.join(centre, "bucket").where(F.col("root") != F.col("to")).select(
                F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
        asked = asked.distinct()
        if tried is not None:
            asked = asked.join(tried, ["a", "b"], "left_anti")
        asked = store(asked, "link-asked")
        now = None
        if not asked.isEmpty():
            found = store(verify(asked), "link-verified")
            now, all_ = found.where("similar").select("a", "b"), asked.select("a", "b")
            tried = all_ if tried is None else tried.unionByName(all_)
        if last:
            blocks = store(resolve(large.select("bucket", "node", "root")), "link-resolved")
            now = blocks if now is None else now.unionByName(blocks)
        if now is not None and not now.isEmpty():
            links = now if links is None else links.unionByName(now)
            roots = components(links)
        if last:
            break
        # what was verified pair by pair is settled
        left = per.where(~F.col("few") & (F.col("n") > centres)).select("bucket")
        if later is not None:
            left = left.unionByName(later)
        members = store(members.join(left, "bucket"), "link-members")
        if members.isEmpty():
            break
        step, centres = step + 1, centres * 2
    if roots is None:
        return members.select("node", F.col("node").alias("root")).limit(0)
    return roots
