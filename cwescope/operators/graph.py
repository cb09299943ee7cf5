"""Graph tables from text: nodes, edges, statistics, vocabularies, features.

The grammar parser of the original work is a per-row native library; here
the tree is the bracket nesting of a tokenized text, built by array operations
over a batch of texts (``tree``). Texts are hash-partitioned by ``graph_id``
into parts that grow with the input. A query that uses its nodes once builds
them beside the texts and stores nothing; one that joins, groups or uses them
twice stores the columns it needs, bucketed by ``graph_id`` (``session.bucketed``),
and its joins, windows and aggregates on (graph_id, ...) shuffle nothing.

Node table columns: graph_id, node_id (pre-order, root = 0), parent, depth,
sibling, node_type, text, start_byte, end_byte, start_row, start_col,
end_row, end_col, is_named, is_leaf, child_count, has_error, text_length;
``tree_nodes`` adds next_leaf (of a leaf, the next one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.functions import code as CF
from cwescope.operators.tree import C_KEYWORDS, CLOSERS, FAR, OPENERS, PIECE_RE, ROOT_TYPE, WS, node_list  # noqa: F401

EDGE_AST, EDGE_REV, EDGE_NEXT = "ast", "ast_reverse", "next_token"
#: Columns of edges that know where their ends stand in the text.
BYTES = ("src_end_byte", "dst_start_byte")


def spread(df: DataFrame, key: str = "graph_id", parts: int | None = None) -> DataFrame:
    """Hash-partition by ``key`` into ``parts`` (or
    ``spark.sql.shuffle.partitions``) parts.

    Texts are small before tokenizing but grow ~50x into pieces and nodes. A
    shuffle with an explicit partition count is not coalesced by AQE. ``parts``
    that grows with the input keeps a task's share small. Texts that are
    partitioned like this already are not shuffled again."""
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _w(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_i")


def pieces(texts: DataFrame, key: str = "graph_id", text: str = "code",
           outer: bool = False) -> DataFrame:
    """Exploded pieces with byte offsets and (row, col) start / end points.
    ``outer`` keeps one row with a null piece for a text without pieces."""
    gen = F.posexplode_outer if outer else F.posexplode
    p = texts.select(F.col(key).alias("graph_id"),
                     gen(F.regexp_extract_all(F.col(text), F.lit(PIECE_RE), 0)).alias("_i", "piece"))
    p = p.withColumn("_i", F.coalesce("_i", F.lit(0)))
    wprev = _w("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    blen = F.coalesce(F.octet_length("piece"), F.lit(0))
    nl = F.coalesce(F.size(F.split("piece", "\n", -1)) - 1, F.lit(0))
    p = p.select("*", blen.alias("_len"), nl.alias("_nl"))
    p = p.select("*",
                 F.coalesce(F.sum("_len").over(wprev), F.lit(0)).alias("start_byte"),
                 F.coalesce(F.sum("_nl").over(wprev), F.lit(0)).alias("start_row"))
    after_nl = F.coalesce(F.octet_length(F.substring_index("piece", "\n", -1)), F.lit(0))
    p = p.withColumn("_ls", F.when(F.col("_nl") > 0, F.col("start_byte") + F.col("_len") - after_nl))
    p = p.withColumn("_last_ls", F.coalesce(F.max("_ls").over(wprev), F.lit(0)))
    return p.select(
        "graph_id", "_i", "piece", F.col("start_byte").cast("bigint").alias("start_byte"),
        (F.col("start_byte") + F.col("_len")).cast("bigint").alias("end_byte"),
        F.col("start_row").cast("bigint").alias("start_row"),
        (F.col("start_byte") - F.col("_last_ls")).cast("bigint").alias("start_col"),
        (F.col("start_row") + F.col("_nl")).cast("bigint").alias("end_row"),
        F.when(F.col("_nl") > 0, after_nl).otherwise(F.col("start_byte") - F.col("_last_ls") + F.col("_len"))
        .cast("bigint").alias("end_col"),
    )


def _text_end(text: Column) -> list[Column]:
    """Byte length and end (row, col) of a whole text, from the text itself."""
    after_nl = F.octet_length(F.substring_index(text, "\n", -1))
    return [F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("end_byte"),
            F.coalesce(F.size(F.split(text, "\n", -1)) - 1, F.lit(0)).cast("bigint").alias("end_row"),
            F.coalesce(after_nl, F.lit(0)).cast("bigint").alias("end_col")]


def tree_nodes(texts: DataFrame, key: str = "graph_id", text: str = "code", parts: int | None = None,
               group_text: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Node table of the bracket-nesting tree of each text (see module doc);
    with the columns ``fields`` only, if given.

    Depth comes from running sums of +1 (opener) / -1 (closer); a closer with
    nothing open is an unmatched leaf (has_error) and does not change the
    level. Each opener yields a group node followed by its own leaf. A parent is
    the last group before the node, one level above it.

    ``group_text`` fills the text of groups and roots in the same pass and adds
    ``text_length``, as ``with_group_text`` does by a join; rows without a key
    are left out then, as by the join."""
    src = texts.select(F.col(key).alias("graph_id"), F.col(text).alias("_t"))
    if group_text:
        src = src.where(F.col("graph_id").isNotNull())
    lists = node_list(F.col("_t"), group_text, fields)
    n = spread(src, parts=parts).select("graph_id", F.explode(lists).alias("n")).select("graph_id", "n.*")
    return n.withColumn("text_length", F.length("text")) if group_text and "text" in n.columns else n


def with_group_text(nodes: DataFrame, texts: DataFrame, key: str = "graph_id",
                    text: str = "code") -> DataFrame:
    """Fill ``text`` of group / root nodes with their byte range of the source."""
    src = texts.select(F.col(key).alias("graph_id"), F.encode(F.col(text), "UTF-8").alias("_src"))
    j = nodes.join(src, "graph_id")
    rng = F.decode(F.substring("_src", (F.col("start_byte") + 1).cast("int"),
                               (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    return j.withColumn("text", F.coalesce(F.col("text"), rng)).drop("_src") \
        .withColumn("text_length", F.length("text"))


# --- edges ----------------------------------------------------------------------

def ast_edges(nodes: DataFrame) -> DataFrame:
    """parent -> child ``ast`` and child -> parent ``ast_reverse``."""
    c = nodes.where(F.col("parent").isNotNull())
    e = F.array(
        F.struct(F.col("parent").alias("src"), F.col("node_id").alias("dst"), F.lit(EDGE_AST).alias("edge_type")),
        F.struct(F.col("node_id").alias("src"), F.col("parent").alias("dst"), F.lit(EDGE_REV).alias("edge_type")))
    return c.select("graph_id", F.explode(e).alias("e")).select("graph_id", "e.*")


def next_token_edges(nodes: DataFrame) -> DataFrame:
    """Each leaf -> the next leaf in pre-order."""
    if "next_leaf" in nodes.columns:
        nxt = F.col("next_leaf")
    else:
        nxt = F.lead("node_id").over(Window.partitionBy("graph_id").orderBy("node_id"))
    t = nodes.where(F.col("is_leaf")).select("graph_id", F.col("node_id").alias("src"), nxt.alias("dst"))
    return t.where(F.col("dst").isNotNull()).withColumn("edge_type", F.lit(EDGE_NEXT))


def _next_leaf(nodes: DataFrame) -> Column:
    """The next leaf in pre-order: the tables of ``tree_nodes`` have it; for
    others a running value over the nodes from behind."""
    if "next_leaf" in nodes.columns:
        return F.col("next_leaf")
    back = Window.partitionBy("graph_id").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("is_leaf"), F.col("node_id")), ignorenulls=True).over(back)


def _edge(src: str, dst: str, kind: Column, when: Column, ends: tuple[str, str] | None = None) -> Column:
    """``ends``: the columns with the source's end and the target's start."""
    far = [F.col(c).alias(n) for c, n in zip(ends or (), BYTES)]
    return F.when(when, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("edge_type"), *far))


def edge_union(nodes: DataFrame) -> DataFrame:
    """AST + reverse + next-token edges, one edge per (graph, src, dst): tree
    edges have an inner node at one end and next-token edges leaves at both, so
    none collide. One pass over the nodes gives all three. Nodes with the places
    ``tree.FAR`` give edges the columns ``BYTES``."""
    far = [*FAR, "start_byte", "end_byte"]
    far = far if "next_leaf" in nodes.columns and set(far) <= set(nodes.columns) else []
    ends = [("parent_end", "start_byte"), ("end_byte", "parent_start"), ("end_byte", "next_start")] if far else [None] * 3
    n = nodes.select("graph_id", "node_id", "parent", "is_leaf", _next_leaf(nodes).alias("_next"), *far)
    child, leaf = F.col("parent").isNotNull(), F.col("is_leaf") & F.col("_next").isNotNull()
    e = F.array(_edge("parent", "node_id", F.lit(EDGE_AST), child, ends[0]),
                _edge("node_id", "parent", F.lit(EDGE_REV), child, ends[1]),
                _edge("node_id", "_next", F.lit(EDGE_NEXT), leaf, ends[2]))
    return n.select("graph_id", F.explode(e).alias("e")).where(F.col("e").isNotNull()).select("graph_id", "e.*")


def hybrid_edges(nodes: DataFrame) -> DataFrame:
    """AST graph plus i -> i+1 for all nodes (type next_token); a pair keeps
    one edge and the later write wins, so parent -> first child becomes
    next_token. Tables of ``tree_nodes`` need no window and no group."""
    if "next_leaf" in nodes.columns:
        return _hybrid_at_once(nodes)
    back = Window.partitionBy("graph_id").orderBy(F.desc("node_id"))
    n = nodes.select("graph_id", "node_id", "parent", "is_leaf", _next_leaf(nodes).alias("_next"),
                     F.lag("node_id").over(back).alias("_seq"))
    child, leaf = F.col("parent").isNotNull(), F.col("is_leaf") & F.col("_next").isNotNull()
    kinds = [EDGE_AST, EDGE_REV, EDGE_NEXT, EDGE_NEXT]  # by number, the last written highest
    e = F.array(_edge("parent", "node_id", F.lit(0), child), _edge("node_id", "parent", F.lit(1), child),
                _edge("node_id", "_next", F.lit(2), leaf), _edge("node_id", "_seq", F.lit(3), F.col("_seq").isNotNull()))
    allv = n.select("graph_id", F.explode(e).alias("e")).where(F.col("e").isNotNull()).select("graph_id", "e.*")
    top = allv.groupBy("graph_id", "src", "dst").agg(F.max("edge_type").alias("_k"))
    return top.select("graph_id", "src", "dst",
                      F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("_k") + 1).alias("edge_type"))


def _hybrid_at_once(nodes: DataFrame) -> DataFrame:
    """``hybrid_edges`` of a table of ``tree_nodes``, where ids are 0, 1, 2, ...
    in pre-order: the last node is the leaf without a next one, every other node
    is followed by its id + 1. That edge stands for parent -> first child and for
    leaf -> next leaf, if these are neighbours; nothing else collides."""
    node, parent, leaf = F.col("node_id"), F.col("parent"), F.col("is_leaf")
    after, child = F.col("next_leaf"), F.col("parent").isNotNull()
    n = nodes.select("graph_id", "node_id", "parent", "is_leaf", "next_leaf", (node + 1).alias("_seq"))
    e = F.array(_edge("parent", "node_id", F.lit(EDGE_AST), child & (parent + 1 != node)),
                _edge("node_id", "parent", F.lit(EDGE_REV), child),
                _edge("node_id", "next_leaf", F.lit(EDGE_NEXT), leaf & after.isNotNull() & (after != F.col("_seq"))),
                _edge("node_id", "_seq", F.lit(EDGE_NEXT), ~leaf | after.isNotNull()))
    return n.select("graph_id", F.explode(e).alias("e")).where(F.col("e").isNotNull()).select("graph_id", "e.*")


def edge_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted (src, dst) pair list per graph; a graph without edges gets []."""
    g = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("pairs"))
    ids = nodes.select("graph_id").distinct()
    return ids.join(g.hint("merge"), "graph_id", "left").select(
        "graph_id", F.coalesce("pairs", F.array().cast("array<struct<src:bigint,dst:bigint>>")).alias("pairs"))


def edge_endpoints(nodes: DataFrame, edges: DataFrame, cols: list[str]) -> DataFrame:
    """Each edge with the requested columns of both endpoint nodes. Node tables
    are larger than their plans let expect: never broadcast."""
    s = nodes.select("graph_id", F.col("node_id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in cols])
    d = nodes.select("graph_id", F.col("node_id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in cols])
    return edges.join(s.hint("merge"), ["graph_id", "src"]).join(d.hint("merge"), ["graph_id", "dst"])


# --- statistics -----------------------------------------------------------------

def _density(n: Column, e: Column) -> Column:
    return F.when(n > 1, e / (n * (n - 1))).otherwise(F.lit(0.0))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, directed density E/(N(N-1)), edges by type."""
    nc = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("num_nodes"))
    ec = edges.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.count_if(F.col("edge_type") == EDGE_AST).alias("n_ast"),
        F.count_if(F.col("edge_type") == EDGE_REV).alias("n_ast_reverse"),
        F.count_if(F.col("edge_type") == EDGE_NEXT).alias("n_next_token"))
    j = nc.join(ec.hint("merge"), "graph_id", "left").fillna(0)
    return j.select("graph_id", "num_nodes", "num_edges",
                    _density(F.col("num_nodes"), F.col("num_edges")).alias("density"),
                    "n_ast", "n_ast_reverse", "n_next_token")


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


def graph_global(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, edges per node (0 without nodes), density (0 if N <= 1)."""
    s = graph_stats(nodes, edges)
    n, e = F.col("num_nodes"), F.col("num_edges")
    return s.select("graph_id", "num_nodes", "num_edges",
                    F.when(n > 0, e / n).otherwise(F.lit(0.0)).alias("edges_per_node"), "density")


def graph_validity(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame,
                   features: DataFrame | None = None) -> DataFrame:
    """A graph of ``graphs`` is kept if it has nodes, a feature vector for each
    of them (``features``: graph_id, node_id, x; not asked without that table),
    labels, and edges whose ends are nodes: in [0, N). Returns the valid flag
    and the first reason that fails."""
    nc = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    ec = edges.groupBy("graph_id").agg(F.max(F.greatest("src", "dst")).alias("mx"),
                                       F.min(F.least("src", "dst")).alias("mn"))
    lab = labels.select("graph_id").distinct().withColumn("has_label", F.lit(True))
    j = (graphs.select("graph_id").distinct().join(nc.hint("merge"), "graph_id", "left").join(ec.hint("merge"), "graph_id", "left")
         .join(lab, "graph_id", "left"))
    if features is not None:
        fc = features.where(F.size("x") > 0).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nf"))
        j = j.join(fc.hint("merge"), "graph_id", "left").withColumn("bare", F.coalesce("nf", F.lit(0)) < F.col("n"))
    else:
        j = j.withColumn("bare", F.lit(False))
    reason = (F.when(F.col("n").isNull(), F.lit("no nodes"))
              .when(F.col("bare"), F.lit("no features"))
              .when(F.col("has_label").isNull(), F.lit("no labels"))
              .when(F.col("mn") < 0, F.lit("negative endpoint"))
              .when(F.col("mx") >= F.col("n"), F.lit("endpoint out of range")))
    return j.select("graph_id", reason.isNull().alias("valid"), reason.alias("reason"))


# --- vocabularies -------------------------------------------------------------------

def node_vocab(nodes: DataFrame, dim: int = 64) -> DataFrame:
    """Top K = min(#types, dim // 2) node types by count; ties by first
    appearance. The result is at most dim/2 rows (broadcastable)."""
    c = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("count"),
                                       F.min(F.struct("graph_id", "node_id")).alias("_first"))
    k = dim // 2
    w = Window.orderBy(F.desc("count"), "_first")
    # The window runs over the distinct node types only (vocabulary-sized).
    r = c.withColumn("type_id", (F.row_number().over(w) - 1).cast("int"))
    return r.where(F.col("type_id") < k).select("node_type", "type_id", "count")


UNK = "<UNK>"


def node_vocab_full(nodes: DataFrame) -> DataFrame:
    """All node types in first-seen order, then <UNK>."""
    c = nodes.groupBy("node_type").agg(F.min(F.struct("graph_id", "node_id")).alias("_first"))
    w = Window.orderBy("_first")
    r = c.select("node_type", (F.row_number().over(w) - 1).cast("int").alias("type_id"))
    unk = r.agg(F.count(F.lit(1)).cast("int").alias("type_id")).select(F.lit(UNK).alias("node_type"), "type_id")
    return r.unionByName(unk)


def vocab_join(nodes: DataFrame, vocab: DataFrame, unk: bool = False) -> DataFrame:
    """Node type -> vocabulary id; unseen -> null, or the <UNK> id."""
    j = nodes.join(F.broadcast(vocab.select("node_type", "type_id")), "node_type", "left")
    if unk:
        uid = vocab.where(F.col("node_type") == UNK).select(F.col("type_id").alias("_unk"))
        j = j.withColumn("_k", F.lit(1)) \
            .join(F.broadcast(uid.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")
        j = j.withColumn("type_id", F.coalesce("type_id", "_unk")).drop("_unk")
    return j


def edge_type_vocab(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Edge type -> id in order of first appearance. ``strict`` reproduces
    the original lookup of a key the builder never writes (all 'ast')."""
    if strict:
        return edges.sparkSession.createDataFrame([("ast", 0)], "edge_type string, type_id int")
    c = edges.groupBy("edge_type").agg(F.min(F.struct("graph_id", "src", "dst")).alias("_first"))
    w = Window.orderBy("_first")
    return c.select("edge_type", (F.row_number().over(w) - 1).cast("int").alias("type_id"))


# --- features -------------------------------------------------------------------

def node_features(nodes: DataFrame, vocab: DataFrame, dim: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dense node vector of size ``dim``: one-hot type, then at offset
    |vocab|+1 (0 if offset+20 > dim): child count, depth, sibling, leaf,
    named, text length (scaled) and the six danger flags of the text. At offset
    0 the numbers replace the one-hot ones; a flag only adds a 1. ``keep``: node
    columns that stay beside the vector.

    The vocabulary has at most dim/2 rows (by construction of
    ``node_vocab``), so it is read once and inlined as a literal map: the
    vector is then ``dim`` plain column expressions (whole-stage codegen, no
    join, no per-element lambda)."""
    voc = [(r["node_type"], int(r["type_id"])) for r in vocab.select("node_type", "type_id").collect()]
    if len(voc) > dim:
        raise ValueError("vocabulary larger than the vector")
    off = 0 if len(voc) + 1 + 20 > dim else len(voc) + 1
    tid = (F.element_at(F.create_map(*[F.lit(x) for kv in voc for x in kv]), F.col("node_type"))
           if voc else F.lit(None).cast("int"))
    low = F.lower(F.coalesce("text", F.lit("")))
    slots = [CF.scaled_count(F.col("child_count").cast("double"), 10.0),
             CF.scaled_count(F.col("depth").cast("double"), 50.0),
             CF.scaled_count(F.col("sibling").cast("double"), 10.0),
             F.col("is_leaf").cast("double"), F.col("is_named").cast("double"),
             CF.scaled_count(F.length(F.coalesce("text", F.lit(""))).cast("double"), 20.0)]
    numbers = len(slots)
    slots += [low.rlike(p).cast("double") for _, p in CF.DANGER_PATTERNS]
    t = nodes.select("graph_id", "node_id", *keep, tid.alias("_t"), *[c.alias(f"_s{k}") for k, c in enumerate(slots)])

    def slot(i: int) -> Column:
        one_hot = F.when(F.col("_t") == i, F.lit(1.0)).otherwise(F.lit(0.0))
        k = i - off
        if not 0 <= k < len(slots):
            return one_hot
        return F.col(f"_s{k}") if k < numbers else F.greatest(F.col(f"_s{k}"), one_hot)

    vec = [slot(i) for i in range(dim)]
    return t.select("graph_id", "node_id", *keep, F.array(*vec).alias("x"))


def node_features_full(nodes: DataFrame, vocab_full: DataFrame) -> DataFrame:
    """One-hot over the full vocabulary (unseen -> <UNK>) plus 7 raw numbers:
    children, start row, start col, end row, end col, text length, named."""
    vsize = vocab_full.agg(F.count(F.lit(1)).alias("_v"))
    j = vocab_join(nodes, vocab_full, unk=True).withColumn("_k", F.lit(1)) \
        .join(F.broadcast(vsize.withColumn("_k", F.lit(1))), "_k").drop("_k")
    raw = F.array(*[F.col(c).cast("double") for c in
                    ("child_count", "start_row", "start_col", "end_row", "end_col", "text_length")],
                  F.col("is_named").cast("double"))
    tid = F.col("type_id").cast("int")
    onehot = F.concat(F.array_repeat(F.lit(0.0), tid), F.array(F.lit(1.0)),
                      F.array_repeat(F.lit(0.0), (F.col("_v") - tid - 1).cast("int")))
    return j.select("graph_id", "node_id", F.concat(onehot, raw).alias("x"))


def edge_features(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """10 slots: one-hot ast / reverse / next_token / other, scaled log byte
    distance |dst.start - src.end|, direction +-1, zeros. ``strict`` keeps
    the original mismatch where reversed edges land in 'other'. Edges with the
    columns ``BYTES`` are not joined with their nodes."""
    if set(BYTES) <= set(edges.columns):
        e = edges.where(F.col("graph_id").isNotNull())
    else:
        e = edge_endpoints(nodes, edges, ["start_byte", "end_byte"])
    t = F.col("edge_type")
    rev = (t == "reverse") if strict else t.isin("reverse", EDGE_REV)
    is_ast, is_next = t == EDGE_AST, t == EDGE_NEXT
    other = ~(is_ast | rev | is_next)
    sb, db = F.col("src_end_byte"), F.col("dst_start_byte")
    dist = F.abs(db - sb).cast("double")
    vec = F.array(is_ast.cast("double"), rev.cast("double"), is_next.cast("double"),
                  other.cast("double"), CF.scaled_log(dist),
                  F.when(db >= sb, F.lit(1.0)).otherwise(F.lit(-1.0)),
                  F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return e.select("graph_id", "src", "dst", "edge_type", vec.alias("ef"))
