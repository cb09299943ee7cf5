"""Bindings: graph tables over the comment-free function texts, propagation,
pooling, statement-graph reachability and taint."""

from __future__ import annotations

from pyspark.sql import functions as F

from cwescope.functions import code as CF
from cwescope.functions.labels import multi_hot
from cwescope.operators import graph as G
from cwescope.operators import parse as PA
from cwescope.operators import propagate as P
from cwescope.operators import reach as R
from cwescope.operators.corpus import hash32
from cwescope.operators.tree import FAR
from cwescope.plans.registry import register
from cwescope.session import bucketed
from cwescope.sources import views as V

VOCAB_DIM = 64
TRAIN_LIMIT = int(0.7 * (1 << 32))


def _texts(spark, d, parts=None):
    f = V.fn_code(spark, d, parts or V.graph_parts(spark, d))
    return f.select(F.col("fn").alias("graph_id"), CF.strip_comments(F.col("code")).alias("code"))


def _nodes(spark, d, *fields: str, text: bool = False):
    """Node table with the columns ``fields`` (all, if none), built beside the
    texts at each use. ``text`` fills the text of group nodes, needed only by
    consumers of node text."""
    parts = V.graph_parts(spark, d)
    return G.tree_nodes(_texts(spark, d, parts), parts=parts, group_text=text, fields=list(fields) or None)


def _stored(spark, d, *fields: str, text: bool = False):
    """The same, built once and stored in buckets, for what joins or groups
    nodes, or uses them more than once."""
    return bucketed(_nodes(spark, d, *fields, text=text), "graph_id", V.graph_parts(spark, d))


#: What edges are made of.
ENDS = ("node_id", "parent", "is_leaf", "next_leaf")
#: What node features are made of.
FACTS = ("node_id", "depth", "sibling", "child_count", "node_type", "text", "is_named", "is_leaf")


# --- oracle: the tree rebuilt in SQL (parent by max-id join, not windows) ----

def _q(s: str) -> str:
    return s.replace("'", "''")


KW_LIST = "[" + ", ".join(f"'{k}'" for k in G.C_KEYWORDS) + "]"
WS_SQL = _q(G.WS)
PIECE_SQL = _q(G.PIECE_RE)
GTYPE = "CASE piece " + " ".join(f"WHEN '{o}' THEN '{t}'" for o, t in G.OPENERS.items()) + " END"
IDENT = "regexp_matches(piece, '^[A-Za-z_][A-Za-z0-9_]*$')"
LTYPE = (f"CASE WHEN {IDENT} AND list_contains({KW_LIST}, piece) THEN piece "
         f"WHEN {IDENT} THEN 'identifier' "
         "WHEN regexp_matches(piece, '^[0-9]') THEN 'number_literal' "
         "WHEN regexp_matches(piece, '(?s)^\".+\"$') OR piece = '\"\"' THEN 'string_literal' "
         "WHEN regexp_matches(piece, '(?s)^''.+''$') OR piece = '''''' THEN 'char_literal' "
         "WHEN regexp_matches(piece, '^[!-~]$') THEN piece ELSE 'other' END")
PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

TREE_CTES = {
    "gsrc": f"""SELECT fn AS graph_id, regexp_replace(code, '{_q(CF.COMMENT_OR_LITERAL)}', '\\1', 'g') AS code
                FROM fn_code""",
    "gp0": f"""SELECT graph_id, unnest(ps) AS piece, unnest(range(0, len(ps))) AS i
               FROM (SELECT graph_id, regexp_extract_all(code, '{PIECE_SQL}') AS ps FROM gsrc) a""",
    "gp1": f"""SELECT *, coalesce(sum(blen) OVER (PARTITION BY graph_id ORDER BY i {PREV}), 0) AS sb,
                  coalesce(sum(nl) OVER (PARTITION BY graph_id ORDER BY i {PREV}), 0) AS sr
               FROM (SELECT *, strlen(piece) AS blen, len(string_split(piece, chr(10))) - 1 AS nl FROM gp0) x""",
    "gp2": f"""SELECT *, coalesce(max(ls) OVER (PARTITION BY graph_id ORDER BY i {PREV}), 0) AS lls
               FROM (SELECT *, CASE WHEN nl > 0 THEN sb + blen - strlen(string_split(piece, chr(10))[-1]) END AS ls
                     FROM gp1) x""",
    "gp": """SELECT graph_id, i, piece, sb AS start_byte, sb + blen AS end_byte, sr AS start_row, sb - lls AS start_col,
                sr + nl AS end_row,
                CASE WHEN nl > 0 THEN strlen(string_split(piece, chr(10))[-1]) ELSE sb - lls + blen END AS end_col
             FROM gp2""",
    "gt": f"""SELECT *, coalesce(lag(eff) OVER (PARTITION BY graph_id ORDER BY i), 0) AS lvl,
                 1 + coalesce(sum(emit) OVER (PARTITION BY graph_id ORDER BY i {PREV}), 0) AS base
              FROM (SELECT *, lsum - least(0, min(lsum) OVER (PARTITION BY graph_id ORDER BY i {RUN})) AS eff
                    FROM (SELECT *, sum(dd) OVER (PARTITION BY graph_id ORDER BY i {RUN}) AS lsum
                          FROM (SELECT *, CASE WHEN piece IN ('(', '{{', '[') THEN 1
                                               WHEN piece IN (')', '}}', ']') THEN -1 ELSE 0 END AS dd,
                                          CASE WHEN piece IN ('(', '{{', '[') THEN 2 ELSE 1 END AS emit
                                FROM gp WHERE NOT regexp_matches(piece, '^{WS_SQL}$')) a) b) c""",
    "gn0": f"""
SELECT graph_id, base AS node_id, lvl + 1 AS depth, {GTYPE} AS node_type, true AS is_named, true AS is_group,
       false AS is_closer, false AS has_error, CAST(NULL AS VARCHAR) AS text,
       start_byte, end_byte, start_row, start_col, end_row, end_col
FROM gt WHERE dd = 1
UNION ALL
SELECT graph_id, CASE WHEN dd = 1 THEN base + 1 ELSE base END, CASE WHEN dd = 1 THEN lvl + 2 ELSE lvl + 1 END,
       {LTYPE}, ({LTYPE}) IN ('identifier', 'number_literal', 'string_literal', 'char_literal'), false,
       dd = -1 AND lvl > 0, dd = -1 AND lvl = 0, piece, start_byte, end_byte, start_row, start_col, end_row, end_col
FROM gt
UNION ALL
SELECT s.graph_id, 0, 0, 'translation_unit', true, true, false, false, NULL, 0, coalesce(e.eb, 0), 0, 0,
       coalesce(e.er, 0), coalesce(e.ec, 0)
FROM gsrc s LEFT JOIN (SELECT graph_id, max(end_byte) AS eb, arg_max(end_row, i) AS er, arg_max(end_col, i) AS ec
                       FROM gp GROUP BY graph_id) e ON e.graph_id = s.graph_id""",
    "gpar": """SELECT a.graph_id, a.node_id, g.node_id AS parent
               FROM (SELECT graph_id, node_id, depth - 1 AS up FROM gn0) a
               ASOF JOIN (SELECT graph_id, node_id, depth FROM gn0 WHERE is_group) g
                 ON g.graph_id = a.graph_id AND g.depth = a.up AND a.node_id > g.node_id""",
    "gn1": """SELECT n.*, p.parent FROM gn0 n LEFT JOIN gpar p ON p.graph_id = n.graph_id AND p.node_id = n.node_id""",
    "gkid": """SELECT k.graph_id, k.parent, k.child_count, l.is_closer AS last_closer, l.end_byte AS cb,
                      l.end_row AS cr, l.end_col AS cc
               FROM (SELECT graph_id, parent, count(*) AS child_count, max(node_id) AS last_id
                     FROM gn1 WHERE parent IS NOT NULL GROUP BY graph_id, parent) k
               JOIN gn1 l ON l.graph_id = k.graph_id AND l.node_id = k.last_id""",
    "gn2": """
SELECT n.graph_id, n.node_id, n.parent, n.depth, n.node_type, n.text, n.start_byte,
  CASE WHEN n.is_group AND n.node_id > 0 THEN CASE WHEN k.last_closer THEN k.cb ELSE t.end_byte END ELSE n.end_byte END AS end_byte,
  n.start_row, n.start_col,
  CASE WHEN n.is_group AND n.node_id > 0 THEN CASE WHEN k.last_closer THEN k.cr ELSE t.end_row END ELSE n.end_row END AS end_row,
  CASE WHEN n.is_group AND n.node_id > 0 THEN CASE WHEN k.last_closer THEN k.cc ELSE t.end_col END ELSE n.end_col END AS end_col,
  n.is_named, CAST(coalesce(k.child_count, 0) AS INTEGER) AS child_count,
  n.has_error OR (n.is_group AND n.node_id > 0 AND NOT coalesce(k.last_closer, false)) AS has_error
FROM gn1 n LEFT JOIN gkid k ON k.graph_id = n.graph_id AND k.parent = n.node_id
JOIN (SELECT graph_id, end_byte, end_row, end_col FROM gn0 WHERE node_id = 0) t ON t.graph_id = n.graph_id""",
    "tn": """
SELECT n.graph_id, n.node_id, n.parent, n.depth, n.node_type,
  coalesce(n.text, substr(s.code, CAST(n.start_byte AS INTEGER) + 1, CAST(n.end_byte - n.start_byte AS INTEGER))) AS text,
  n.start_byte, n.end_byte, n.start_row, n.start_col, n.end_row, n.end_col, n.is_named, n.child_count, n.has_error,
  CASE WHEN n.parent IS NULL THEN 0 ELSE CAST(row_number() OVER (PARTITION BY n.graph_id, n.parent ORDER BY n.node_id) - 1 AS INTEGER) END AS sibling,
  n.child_count = 0 AS is_leaf,
  length(coalesce(n.text, substr(s.code, CAST(n.start_byte AS INTEGER) + 1, CAST(n.end_byte - n.start_byte AS INTEGER)))) AS text_length
FROM gn2 n JOIN gsrc s ON s.graph_id = n.graph_id""",
}
TREE_DEPS = {
    "gsrc": ("fn_code",), "gp0": ("gsrc",), "gp1": ("gp0",), "gp2": ("gp1",), "gp": ("gp2",), "gt": ("gp",),
    "gn0": ("gt", "gsrc", "gp"), "gpar": ("gn0",), "gn1": ("gn0", "gpar"), "gkid": ("gn1",),
    "gn2": ("gn1", "gkid", "gn0"), "tn": ("gn2", "gsrc"),
}

EXTRA = dict(TREE_CTES)
DEPS = dict(TREE_DEPS)


def _sql(body: str, *names: str, extra: dict | None = None, deps: dict | None = None) -> str:
    ex = dict(EXTRA)
    dp = dict(DEPS)
    if extra:
        ex.update(extra)
    if deps:
        dp.update(deps)
    return V.with_views(body, *(names or ("tn",)), extra=ex, extra_deps=dp)


NODE_COLS = ("graph_id, node_id, parent, depth, node_type, text, start_byte, end_byte, start_row, start_col, "
             "end_row, end_col, is_named, child_count, has_error, sibling, is_leaf, text_length")
NODE_SQL_COLS = ("graph_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent AS BIGINT) AS parent, "
                 "CAST(depth AS INTEGER) AS depth, node_type, text, CAST(start_byte AS BIGINT) AS start_byte, "
                 "CAST(end_byte AS BIGINT) AS end_byte, CAST(start_row AS BIGINT) AS start_row, "
                 "CAST(start_col AS BIGINT) AS start_col, CAST(end_row AS BIGINT) AS end_row, "
                 "CAST(end_col AS BIGINT) AS end_col, is_named, child_count, has_error, sibling, is_leaf, "
                 "CAST(text_length AS INTEGER) AS text_length")


@register("tree_nodes", _sql(f"SELECT {NODE_SQL_COLS} FROM tn"))
def q_tree_nodes(spark, d):
    return _nodes(spark, d, text=True).select(*[c.strip() for c in NODE_COLS.split(",")])


@register("tree_nodes_parsed", _sql(f"SELECT {NODE_SQL_COLS} FROM tn"))
def q_tree_nodes_parsed(spark, d):
    """The same table through the parser slot."""
    parts = V.graph_parts(spark, d)
    n = PA.parse_nodes(_texts(spark, d, parts), PA.bracket_parser, parts=parts)
    return n.select(*[c.strip() for c in NODE_COLS.split(",")])


@register("node_faults", _sql("SELECT graph_id, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS node_id FROM tn "
                              "WHERE node_id < 0"))
def q_node_faults(spark, d):
    """Graphs of both builders that break the contract: none."""
    parts = V.graph_parts(spark, d)
    t = bucketed(_texts(spark, d, parts), "graph_id", parts)  # read by both builders and both checks
    arrays = bucketed(G.tree_nodes(t.where("graph_id IS NOT NULL"), parts=parts, fields=PA.CHECKED), "graph_id", parts)
    stack = bucketed(PA.parse_nodes(t, PA.bracket_parser, parts=parts, fields=PA.CHECKED), "graph_id", parts)
    return PA.node_faults(arrays, t).unionByName(PA.node_faults(stack, t))


@register("tree_structure", _sql("""
SELECT graph_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent AS BIGINT) AS parent, CAST(depth AS INTEGER) AS depth,
  sibling, child_count FROM tn"""))
def q_tree_structure(spark, d):
    return _nodes(spark, d, "node_id", "parent", "depth", "sibling", "child_count").select("graph_id", "node_id", "parent", "depth", "sibling", "child_count")


EDGES_SQL = {
    "ge_ast": """SELECT graph_id, CAST(parent AS BIGINT) AS src, CAST(node_id AS BIGINT) AS dst, 'ast' AS edge_type
                 FROM tn WHERE parent IS NOT NULL
                 UNION ALL
                 SELECT graph_id, CAST(node_id AS BIGINT), CAST(parent AS BIGINT), 'ast_reverse' FROM tn WHERE parent IS NOT NULL""",
    "ge_next": """SELECT graph_id, src, dst, 'next_token' AS edge_type FROM (
                    SELECT graph_id, CAST(node_id AS BIGINT) AS src,
                           CAST(lead(node_id) OVER (PARTITION BY graph_id ORDER BY node_id) AS BIGINT) AS dst
                    FROM tn WHERE is_leaf) x WHERE dst IS NOT NULL""",
    "ge": """SELECT * FROM ge_ast UNION ALL SELECT * FROM ge_next""",
}
EDGE_DEPS = {"ge_ast": ("tn",), "ge_next": ("tn",), "ge": ("ge_ast", "ge_next")}


def _esql(body: str, *names: str, extra: dict | None = None, deps: dict | None = None) -> str:
    ex = dict(EDGES_SQL)
    dp = dict(EDGE_DEPS)
    if extra:
        ex.update(extra)
    if deps:
        dp.update(deps)
    return _sql(body, *names, extra=ex, deps=dp)


@register("ast_edges", _esql("SELECT * FROM ge_ast", "ge_ast"))
def q_ast_edges(spark, d):
    return G.ast_edges(_nodes(spark, d, "node_id", "parent"))


@register("next_token_edges", _esql("SELECT * FROM ge_next", "ge_next"))
def q_next_token_edges(spark, d):
    return G.next_token_edges(_nodes(spark, d, "node_id", "is_leaf", "next_leaf"))


@register("edge_union", _esql("SELECT * FROM ge", "ge"))
def q_edge_union(spark, d):
    return G.edge_union(_nodes(spark, d, *ENDS))


@register("hybrid_edges", _esql("""
SELECT graph_id, src, dst, arg_max(edge_type, o) AS edge_type FROM (
  SELECT graph_id, src, dst, edge_type, 0 AS o FROM ge
  UNION ALL
  SELECT graph_id, src, dst, 'next_token', 1 FROM (
    SELECT graph_id, CAST(node_id AS BIGINT) AS src,
           CAST(lead(node_id) OVER (PARTITION BY graph_id ORDER BY node_id) AS BIGINT) AS dst FROM tn) x
  WHERE dst IS NOT NULL) y
GROUP BY graph_id, src, dst""", "ge"))
def q_hybrid_edges(spark, d):
    # the texts are stored, not the nodes, which take about three times as much
    parts = V.graph_parts(spark, d)
    texts = bucketed(_texts(spark, d, parts), "graph_id", parts)
    return G.hybrid_edges(G.tree_nodes(texts, parts=parts, fields=list(ENDS)))


@register("edge_index", _esql("""
SELECT g.graph_id, coalesce(e.pairs, []) AS pairs
FROM (SELECT DISTINCT graph_id FROM tn) g
LEFT JOIN (SELECT graph_id, list_sort(list({'src': src, 'dst': dst})) AS pairs FROM ge GROUP BY graph_id) e
  ON e.graph_id = g.graph_id""", "ge"))
def q_edge_index(spark, d):
    n = _stored(spark, d, *ENDS)
    return G.edge_index(n, G.edge_union(n))


@register("edge_endpoints", _esql("""
SELECT e.graph_id, e.src, e.dst, e.edge_type, CAST(s.start_byte AS BIGINT) AS src_start_byte,
  CAST(s.end_byte AS BIGINT) AS src_end_byte, CAST(t.start_byte AS BIGINT) AS dst_start_byte,
  CAST(t.end_byte AS BIGINT) AS dst_end_byte
FROM ge e JOIN tn s ON s.graph_id = e.graph_id AND s.node_id = e.src
JOIN tn t ON t.graph_id = e.graph_id AND t.node_id = e.dst""", "ge"))
def q_edge_endpoints(spark, d):
    n = _stored(spark, d, *ENDS, "start_byte", "end_byte")
    return G.edge_endpoints(n, G.edge_union(n), ["start_byte", "end_byte"])


STATS_SQL = """
SELECT n.graph_id, n.num_nodes, coalesce(e.num_edges, 0) AS num_edges,
  CASE WHEN n.num_nodes > 1 THEN coalesce(e.num_edges, 0) / (n.num_nodes * (n.num_nodes - 1)) ELSE 0.0 END AS density,
  coalesce(e.n_ast, 0) AS n_ast, coalesce(e.n_ast_reverse, 0) AS n_ast_reverse, coalesce(e.n_next_token, 0) AS n_next_token
FROM (SELECT graph_id, count(*) AS num_nodes FROM tn GROUP BY graph_id) n
LEFT JOIN (SELECT graph_id, count(*) AS num_edges, count(*) FILTER (WHERE edge_type = 'ast') AS n_ast,
             count(*) FILTER (WHERE edge_type = 'ast_reverse') AS n_ast_reverse,
             count(*) FILTER (WHERE edge_type = 'next_token') AS n_next_token FROM ge GROUP BY graph_id) e
  ON e.graph_id = n.graph_id"""


@register("graph_stats", _esql(STATS_SQL, "ge"), rnd=("density",))
def q_graph_stats(spark, d):
    n = _stored(spark, d, *ENDS)
    return G.graph_stats(n, G.edge_union(n))


@register("graph_node_types", _sql("SELECT graph_id, node_type, count(*) AS n FROM tn GROUP BY graph_id, node_type"))
def q_graph_node_types(spark, d):
    return G.node_type_counts(_stored(spark, d, "node_type"))


@register("graph_global", _esql(f"""
SELECT graph_id, num_nodes, num_edges, CASE WHEN num_nodes > 0 THEN num_edges / num_nodes ELSE 0.0 END AS edges_per_node,
  density FROM ({STATS_SQL}) s""", "ge"), rnd=("edges_per_node", "density"))
def q_graph_global(spark, d):
    n = _stored(spark, d, *ENDS)
    return G.graph_global(n, G.edge_union(n))


@register("graph_validity", _esql("""
SELECT graph_id, r IS NULL AS valid, r AS reason FROM (
  SELECT g.graph_id,
    CASE WHEN n.n IS NULL THEN 'no nodes' WHEN coalesce(f.n, 0) < n.n THEN 'no features'
         WHEN l.graph_id IS NULL THEN 'no labels'
         WHEN e.mn < 0 THEN 'negative endpoint' WHEN e.mx >= n.n THEN 'endpoint out of range' END AS r
  FROM gsrc g
  LEFT JOIN (SELECT graph_id, count(*) AS n FROM tn WHERE graph_id % 13 <> 0 GROUP BY graph_id) n ON n.graph_id = g.graph_id
  LEFT JOIN (SELECT graph_id, count(*) AS n FROM tn WHERE graph_id % 11 <> 0 OR node_id > 0 GROUP BY graph_id) f
    ON f.graph_id = g.graph_id
  LEFT JOIN (SELECT graph_id, max(greatest(src, dst)) AS mx, min(least(src, dst)) AS mn
             FROM (SELECT graph_id, CASE WHEN graph_id % 17 = 0 THEN src - 1 ELSE src END AS src,
                          CASE WHEN graph_id % 19 = 0 THEN dst + 1 ELSE dst END AS dst FROM ge) m
             GROUP BY graph_id) e ON e.graph_id = g.graph_id
  LEFT JOIN (SELECT DISTINCT sample_id AS graph_id FROM tool_labels WHERE tool = 'truth') l ON l.graph_id = g.graph_id) n""",
    "ge", "gsrc", "tool_labels"))
def q_graph_validity(spark, d):
    """Each reason occurs: some graphs lose their nodes, a feature row, or get
    edges that lead out of them."""
    t, n, g = _texts(spark, d), _stored(spark, d, *ENDS), F.col("graph_id")
    lab = V.tool_labels(spark, d).where(F.col("tool") == "truth").select(F.col("sample_id").alias("graph_id"))
    e = G.edge_union(n).select("graph_id", (F.col("src") - (g % 17 == 0).cast("int")).alias("src"),
                               (F.col("dst") + (g % 19 == 0).cast("int")).alias("dst"))
    x = n.where((g % 11 != 0) | (F.col("node_id") > 0)).select("graph_id", "node_id", F.array(F.lit(1.0)).alias("x"))
    return G.graph_validity(t.select("graph_id"), n.where(g % 13 != 0), e, lab, x)


def _train_nodes(n):
    return n.where(hash32(F.col("graph_id")) < F.lit(TRAIN_LIMIT))


H_GID = "CAST(('0x' || substr(md5(CAST(graph_id AS VARCHAR)), 1, 8)) AS BIGINT)"
def _vocab_sql(dim: int) -> str:
    return f"""
SELECT node_type, CAST(rk - 1 AS INTEGER) AS type_id, cnt AS count FROM (
  SELECT node_type, cnt, row_number() OVER (ORDER BY cnt DESC, fg, fn) AS rk FROM (
    SELECT node_type, count(*) AS cnt, arg_min(graph_id, (graph_id, node_id)) AS fg,
           arg_min(node_id, (graph_id, node_id)) AS fn
    FROM tn WHERE {H_GID} < {TRAIN_LIMIT} GROUP BY node_type) a) b
WHERE rk <= {dim // 2}"""


VOCAB_SQL = _vocab_sql(VOCAB_DIM)


@register("node_vocab", _sql(VOCAB_SQL, "tn"))
def q_node_vocab(spark, d):
    return G.node_vocab(_train_nodes(_nodes(spark, d, "node_id", "node_type")), VOCAB_DIM)


VOCAB_FULL_SQL = """
SELECT node_type, CAST(row_number() OVER (ORDER BY fg, fn) - 1 AS INTEGER) AS type_id FROM (
  SELECT node_type, arg_min(graph_id, (graph_id, node_id)) AS fg, arg_min(node_id, (graph_id, node_id)) AS fn
  FROM tn GROUP BY node_type) a
UNION ALL SELECT '<UNK>', CAST(count(DISTINCT node_type) AS INTEGER) FROM tn"""


@register("node_vocab_full", _sql(VOCAB_FULL_SQL, "tn"))
def q_node_vocab_full(spark, d):
    return G.node_vocab_full(_nodes(spark, d, "node_id", "node_type"))


@register("vocab_join", _sql(f"""
SELECT n.graph_id, CAST(n.node_id AS BIGINT) AS node_id, n.node_type, v.type_id
FROM tn n LEFT JOIN ({VOCAB_SQL}) v ON v.node_type = n.node_type""", "tn"))
def q_vocab_join(spark, d):
    n = _stored(spark, d, "node_id", "node_type")
    v = G.node_vocab(_train_nodes(n), VOCAB_DIM)
    return G.vocab_join(n, v).select("graph_id", "node_id", "node_type", "type_id")


def _flag_list_sql(col: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({col}, '')), '{p}') THEN 1.0 ELSE 0.0 END"
                     for _, p in CF.DANGER_PATTERNS)


def node_features_sql(dim: int) -> str:
    """The scalar slots stand over the one-hot numbers, a flag only if it is set."""
    vocab = _vocab_sql(dim)
    return f"""
SELECT graph_id, CAST(node_id AS BIGINT) AS node_id,
  list_transform(range(0, {dim}), lambda i:
    CASE WHEN i - off >= 0 AND i - off < 6 THEN sl[i - off + 1]
         WHEN i - off >= 6 AND i - off < 12 AND sl[i - off + 1] = 1.0 THEN 1.0
         WHEN i = type_id THEN 1.0 ELSE 0.0 END) AS x
FROM (
  SELECT n.graph_id, n.node_id, v.type_id,
    CASE WHEN vs.nv + 1 + 20 > {dim} THEN 0 ELSE vs.nv + 1 END AS off,
    [least(n.child_count / 10.0, 1.0), least(n.depth / 50.0, 1.0), least(n.sibling / 10.0, 1.0),
     CASE WHEN n.is_leaf THEN 1.0 ELSE 0.0 END, CASE WHEN n.is_named THEN 1.0 ELSE 0.0 END,
     least(length(coalesce(n.text, '')) / 20.0, 1.0), {_flag_list_sql('n.text')}] AS sl
  FROM tn n LEFT JOIN ({vocab}) v ON v.node_type = n.node_type
  CROSS JOIN (SELECT count(*) AS nv FROM ({vocab}) q) vs) z"""


def _features(spark, d, dim):
    n = _stored(spark, d, *FACTS, text=True)
    return G.node_features(n, G.node_vocab(_train_nodes(n), dim), dim)


@register("node_features", _sql(node_features_sql(VOCAB_DIM), "tn"))
def q_node_features(spark, d):
    return _features(spark, d, VOCAB_DIM)


#: Too small for slots behind the one-hot numbers.
SMALL_DIM = 20


@register("node_features_small", _sql(node_features_sql(SMALL_DIM), "tn"))
def q_node_features_small(spark, d):
    return _features(spark, d, SMALL_DIM)


@register("node_features_full", _sql(f"""
SELECT graph_id, CAST(node_id AS BIGINT) AS node_id,
  list_concat(list_transform(range(0, nv), lambda i: CASE WHEN i = tid THEN 1.0 ELSE 0.0 END),
              [CAST(child_count AS DOUBLE), CAST(start_row AS DOUBLE), CAST(start_col AS DOUBLE),
               CAST(end_row AS DOUBLE), CAST(end_col AS DOUBLE), CAST(text_length AS DOUBLE),
               CASE WHEN is_named THEN 1.0 ELSE 0.0 END]) AS x
FROM (SELECT n.*, coalesce(v.type_id, u.type_id) AS tid, c.nv
      FROM tn n LEFT JOIN ({VOCAB_FULL_SQL}) v ON v.node_type = n.node_type
      CROSS JOIN (SELECT type_id FROM ({VOCAB_FULL_SQL}) q WHERE node_type = '<UNK>') u
      CROSS JOIN (SELECT count(*) AS nv FROM ({VOCAB_FULL_SQL}) q) c) z""", "tn"))
def q_node_features_full(spark, d):
    n = _stored(spark, d, "node_id", "node_type", "text", "child_count", "start_row", "start_col", "end_row", "end_col",
                "is_named", text=True).drop("text")
    return G.node_features_full(n, G.node_vocab_full(n))


EDGE_FEATURES_SQL = """
SELECT e.graph_id, e.src, e.dst, e.edge_type,
  [CASE WHEN e.edge_type = 'ast' THEN 1.0 ELSE 0.0 END,
   CASE WHEN e.edge_type IN ('reverse', 'ast_reverse') THEN 1.0 ELSE 0.0 END,
   CASE WHEN e.edge_type = 'next_token' THEN 1.0 ELSE 0.0 END,
   CASE WHEN e.edge_type NOT IN ('ast', 'reverse', 'ast_reverse', 'next_token') THEN 1.0 ELSE 0.0 END,
   least(ln(1 + abs(t.start_byte - s.end_byte)) / 10.0, 1.0),
   CASE WHEN t.start_byte >= s.end_byte THEN 1.0 ELSE -1.0 END, 0.0, 0.0, 0.0, 0.0] AS ef
FROM ge e JOIN tn s ON s.graph_id = e.graph_id AND s.node_id = e.src
JOIN tn t ON t.graph_id = e.graph_id AND t.node_id = e.dst"""
EDGE_SLOTS = 10


@register("edge_features", _esql(EDGE_FEATURES_SQL, "ge"))
def q_edge_features(spark, d):
    n = _stored(spark, d, *ENDS, "start_byte", "end_byte")
    return G.edge_features(n, G.edge_union(n))


GRAPH_CLASSES = [f"CWE-{i}" for i in range(9)]


def graph_tables(spark, d, *keep):
    """What graphs are made of: node vectors by the vocabulary of the train graphs
    (with the node columns ``keep``), edges with their features, label vectors,
    metadata. Nodes are stored once, with the places that their edges need."""
    n = _stored(spark, d, *FACTS, "parent", "next_leaf", "start_byte", "end_byte", *FAR, text=True)
    vocab = G.node_vocab(_train_nodes(n), VOCAB_DIM)
    x = G.node_features(n, vocab, VOCAB_DIM, keep)
    e = G.edge_features(n, G.edge_union(n))
    truth = V.tool_labels(spark, d).where(F.col("tool") == "truth").groupBy(F.col("sample_id").alias("graph_id")).agg(
        F.collect_set("cwe").alias("cwes"))
    ids = n.where("node_id = 0").select("graph_id")
    none = F.array().cast("array<string>")
    labels = ids.join(truth, "graph_id", "left").select(
        "graph_id", multi_hot(F.coalesce("cwes", none), GRAPH_CLASSES).alias("y"))
    about = ids.select("graph_id", F.concat(F.lit("proj"), (F.col("graph_id") % 7).cast("string")).alias("project"),
                       F.md5(F.col("graph_id").cast("string")).alias("commit_id"))
    return x, e, labels, about


@register("edge_type_vocab", _esql("""
SELECT edge_type, CAST(row_number() OVER (ORDER BY fg, fs, fd) - 1 AS INTEGER) AS type_id FROM (
  SELECT edge_type, arg_min(graph_id, (graph_id, src, dst)) AS fg, arg_min(src, (graph_id, src, dst)) AS fs,
         arg_min(dst, (graph_id, src, dst)) AS fd FROM ge GROUP BY edge_type) a""", "ge"))
def q_edge_type_vocab(spark, d):
    return G.edge_type_vocab(G.edge_union(_nodes(spark, d, *ENDS)))


@register("scaled", _sql("""
SELECT graph_id, CAST(node_id AS BIGINT) AS node_id, least(child_count / 10.0, 1.0) AS child_scaled,
  least(depth / 50.0, 1.0) AS depth_scaled, least(text_length / 20.0, 1.0) AS length_scaled,
  least(ln(1 + (end_byte - start_byte)) / 10.0, 1.0) AS span_scaled FROM tn"""),
    rnd=("child_scaled", "depth_scaled", "length_scaled", "span_scaled"))
def q_scaled(spark, d):
    n = _nodes(spark, d, "node_id", "child_count", "depth", "text", "start_byte", "end_byte", text=True)
    return n.select("graph_id", "node_id",
                    CF.scaled_count(F.col("child_count").cast("double"), 10.0).alias("child_scaled"),
                    CF.scaled_count(F.col("depth").cast("double"), 50.0).alias("depth_scaled"),
                    CF.scaled_count(F.col("text_length").cast("double"), 20.0).alias("length_scaled"),
                    CF.scaled_log((F.col("end_byte") - F.col("start_byte")).cast("double")).alias("span_scaled"))


# --- propagation and pooling ---------------------------------------------------

PROP_SQL = {
    "px": """SELECT graph_id, CAST(node_id AS BIGINT) AS node_id, CAST(dim AS INTEGER) AS dim, x FROM (
               SELECT graph_id, node_id, unnest([least(child_count / 10.0, 1.0), least(depth / 50.0, 1.0),
                      CASE WHEN is_leaf THEN 1.0 ELSE 0.0 END, CASE WHEN is_named THEN 1.0 ELSE 0.0 END]) AS x,
                      unnest(range(0, 4)) AS dim FROM tn) a""",
    "pe": """SELECT DISTINCT graph_id, src, dst FROM (
               SELECT graph_id, src, dst FROM ge UNION ALL SELECT graph_id, node_id, node_id FROM tn) a""",
    "pdeg": "SELECT graph_id, dst, count(*) AS deg FROM pe GROUP BY graph_id, dst",
}
PROP_DEPS = {"px": ("tn",), "pe": ("ge",), "pdeg": ("pe",)}


def _psql(body: str, *names: str) -> str:
    return _esql(body, *names, extra=PROP_SQL, deps=PROP_DEPS)


def _px(spark, d):
    n = _stored(spark, d, *ENDS, "child_count", "depth", "is_named")
    return n, G.edge_union(n), P.node_scalar_features(n)


@register("gcn_propagate", _psql("""
SELECT e.graph_id, CAST(e.dst AS BIGINT) AS node_id, x.dim, sum(x.x / sqrt(du.deg * dv.deg)) AS x
FROM pe e JOIN pdeg du ON du.graph_id = e.graph_id AND du.dst = e.src
JOIN pdeg dv ON dv.graph_id = e.graph_id AND dv.dst = e.dst
JOIN px x ON x.graph_id = e.graph_id AND x.node_id = e.src
GROUP BY e.graph_id, e.dst, x.dim""", "px", "pdeg"), rnd=("x",))
def q_gcn_propagate(spark, d):
    n, e, x = _px(spark, d)
    return P.long_form(P.gcn_propagate(n, e, x))


@register("mean_propagate", _psql("""
SELECT e.graph_id, CAST(e.dst AS BIGINT) AS node_id, x.dim, avg(x.x) AS x
FROM pe e JOIN px x ON x.graph_id = e.graph_id AND x.node_id = e.src GROUP BY e.graph_id, e.dst, x.dim""",
                                  "px", "pe"), rnd=("x",))
def q_mean_propagate(spark, d):
    n, e, x = _px(spark, d)
    return P.long_form(P.mean_propagate(n, e, x))


@register("sum_propagate", _psql("""
SELECT x.graph_id, x.node_id, x.dim, 1.0 * x.x + 0.5 * coalesce(s.s, 0.0) AS x
FROM px x LEFT JOIN (
  SELECT e.graph_id, e.dst, y.dim, sum(y.x) AS s FROM (SELECT DISTINCT graph_id, src, dst FROM ge) e
  JOIN px y ON y.graph_id = e.graph_id AND y.node_id = e.src GROUP BY e.graph_id, e.dst, y.dim) s
  ON s.graph_id = x.graph_id AND s.dst = x.node_id AND s.dim = x.dim""", "px", "ge"), rnd=("x",))
def q_sum_propagate(spark, d):
    n, e, x = _px(spark, d)
    return P.long_form(P.sum_propagate(n, e, x))


def _vec_sql(v: list[float]) -> str:
    return "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in v) + "]"


@register("gat_propagate", _psql(f"""
SELECT s.graph_id, CAST(s.dst AS BIGINT) AS node_id, x.dim, sum(s.ex / z.z * x.x) AS x FROM (
  SELECT e.graph_id, e.src, e.dst, exp(sc - max(sc) OVER (PARTITION BY e.graph_id, e.dst)) AS ex FROM (
    SELECT e.graph_id, e.src, e.dst,
      CASE WHEN ps.ps + pd.pd >= 0 THEN ps.ps + pd.pd ELSE (ps.ps + pd.pd) * CAST({P.GAT_SLOPE} AS DOUBLE) END AS sc
    FROM pe e
    JOIN (SELECT graph_id, node_id, sum(x * {_vec_sql(P.GAT_A_SRC)}[dim + 1]) AS ps FROM px GROUP BY graph_id, node_id) ps
      ON ps.graph_id = e.graph_id AND ps.node_id = e.src
    JOIN (SELECT graph_id, node_id, sum(x * {_vec_sql(P.GAT_A_DST)}[dim + 1]) AS pd FROM px GROUP BY graph_id, node_id) pd
      ON pd.graph_id = e.graph_id AND pd.node_id = e.dst) e) s
JOIN (SELECT graph_id, dst, sum(ex) AS z FROM (
        SELECT e.graph_id, e.dst, exp(sc - max(sc) OVER (PARTITION BY e.graph_id, e.dst)) AS ex FROM (
          SELECT e.graph_id, e.dst,
            CASE WHEN ps.ps + pd.pd >= 0 THEN ps.ps + pd.pd ELSE (ps.ps + pd.pd) * CAST({P.GAT_SLOPE} AS DOUBLE) END AS sc
          FROM pe e
          JOIN (SELECT graph_id, node_id, sum(x * {_vec_sql(P.GAT_A_SRC)}[dim + 1]) AS ps FROM px GROUP BY graph_id, node_id) ps
            ON ps.graph_id = e.graph_id AND ps.node_id = e.src
          JOIN (SELECT graph_id, node_id, sum(x * {_vec_sql(P.GAT_A_DST)}[dim + 1]) AS pd FROM px GROUP BY graph_id, node_id) pd
            ON pd.graph_id = e.graph_id AND pd.node_id = e.dst) e) q GROUP BY graph_id, dst) z
  ON z.graph_id = s.graph_id AND z.dst = s.dst
JOIN px x ON x.graph_id = s.graph_id AND x.node_id = s.src
GROUP BY s.graph_id, s.dst, x.dim""", "px", "pe"), rnd=("x",))
def q_gat_propagate(spark, d):
    n, e, x = _px(spark, d)
    return P.long_form(P.gat_propagate(n, e, x))


# Fixed weights of the checks, by a rule (no training).
def weights(seed: int, n_in: int, n_out: int) -> list[list[float]]:
    return [[((seed * 7 + i * 5 + j * 3) % 11 - 5) / 5.0 for j in range(n_out)] for i in range(n_in)]


def numbers(seed: int, n: int, low: float = -0.5, step: float = 0.1) -> list[float]:
    return [low + step * ((seed * 5 + j * 3) % 11) for j in range(n)]


GAT_HEADS = [P.Head(weights(k, 4, 2), numbers(k, 2), numbers(k + 3, 2)) for k in range(2)]
PW_SQL = "SELECT graph_id, node_id, " + ", ".join(
    f"max(CASE WHEN dim = {i} THEN x END) AS f{i}" for i in range(4)) + " FROM px GROUP BY graph_id, node_id"


def linear_sql(cols: list[str], weight: list[list[float]], bias: list[float] | None = None) -> list[str]:
    return [" + ".join([f"{c} * CAST({weight[i][j]!r} AS DOUBLE)" for i, c in enumerate(cols)]
                       + ([f"CAST({bias[j]!r} AS DOUBLE)"] if bias else [])) for j in range(len(weight[0]))]


def _gat_heads_sql(concat: bool) -> str:
    ks, js = range(len(GAT_HEADS)), range(2)
    z = [f"{e} AS z{k}{j}" for k in ks for j, e in enumerate(linear_sql(["f0", "f1", "f2", "f3"], GAT_HEADS[k].weight))]
    dots = [f"{linear_sql([f'z{k}{j}' for j in js], [[v] for v in a])[0]} AS {n}{k}" for k in ks
            for n, a in (("ps", GAT_HEADS[k].a_src), ("pd", GAT_HEADS[k].a_dst))]
    raw = [f"s.ps{k} + t.pd{k}" for k in ks]
    scores = [f"CASE WHEN {r} >= 0 THEN {r} ELSE ({r}) * CAST({P.GAT_SLOPE} AS DOUBLE) END AS s{k}"
              for k, r in zip(ks, raw)]
    zs = ", ".join(f"s.z{k}{j}" for k in ks for j in js)
    ex = [f"exp(s{k} - max(s{k}) OVER (PARTITION BY graph_id, dst)) AS e{k}" for k in ks]
    out = [[f"sum(e{k} * z{k}{j}) / sum(e{k})" for j in js] for k in ks]
    if concat:
        flat = [o for per in out for o in per]
        flat = [f"CASE WHEN {o} > 0 THEN {o} ELSE exp({o}) - 1 END" for o in flat]
    else:
        flat = [f"({out[0][j]} + {out[1][j]}) / 2" for j in js]
    return f"""
SELECT graph_id, node_id, {', '.join(f'o{i} AS f{i}' for i in range(len(flat)))} FROM (
  SELECT graph_id, CAST(dst AS BIGINT) AS node_id, {', '.join(f'{o} AS o{i}' for i, o in enumerate(flat))} FROM (
    SELECT *, {', '.join(ex)} FROM (
      SELECT e.graph_id, e.dst, {zs}, {', '.join(scores)}
      FROM pe e JOIN zz s ON s.graph_id = e.graph_id AND s.node_id = e.src
      JOIN zz t ON t.graph_id = e.graph_id AND t.node_id = e.dst) a) b
  GROUP BY graph_id, dst) c""".replace("zz", f"(SELECT *, {', '.join(dots)} FROM (SELECT *, {', '.join(z)} FROM ({PW_SQL}) w) q)")


@register("gat_propagate_heads", _psql(_gat_heads_sql(True), "px", "pe"), rnd=("f0", "f1", "f2", "f3"))
def q_gat_propagate_heads(spark, d):
    """Two heads side by side, ELU."""
    _, e, x = _px(spark, d)
    return P.gat_heads(e, x, GAT_HEADS, activate=True, parts=V.graph_parts(spark, d))


@register("gat_propagate_mean", _psql(_gat_heads_sql(False), "px", "pe"), rnd=("f0", "f1"))
def q_gat_propagate_mean(spark, d):
    """Two heads averaged, as in a last layer."""
    _, e, x = _px(spark, d)
    return P.gat_heads(e, x, GAT_HEADS, concat=False, parts=V.graph_parts(spark, d))


@register("graph_pool", _psql("""
SELECT graph_id, dim, avg(x) AS mean, max(x) AS max, sum(x) AS sum FROM px GROUP BY graph_id, dim""", "px"),
    rnd=("mean", "max", "sum"))
def q_graph_pool(spark, d):
    w = P.graph_pool_wide(P.node_scalar_features(_stored(spark, d, "node_id", "child_count", "depth", "is_leaf", "is_named")))
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"mean_{c}").alias("mean"),
                              F.col(f"max_{c}").alias("max"), F.col(f"sum_{c}").alias("sum"))
                     for i, c in enumerate(P.SCALAR_FEATURES)])
    return w.select("graph_id", F.explode(rows).alias("t")).select("graph_id", "t.*")


# --- statement graphs ----------------------------------------------------------

def _cfg(spark, d):
    cl = V.code_lines(spark, d)
    nodes = cl.select(F.col("fn").alias("graph_id"), F.col("line_no").alias("id"), "code")
    edges = V.cfg_edges(spark, d, cl)
    vars_ = cl.select(F.col("fn").alias("graph_id"), F.col("v").alias("var")).distinct()
    return nodes, edges, vars_


@register("src_cfg_edges", V.with_views("""
SELECT graph_id, src, dst, type FROM cfg_edges""", "cfg_edges"))
def q_src_cfg_edges(spark, d):
    n, e, _ = _cfg(spark, d)
    return R.build_cfg(n, e)[1]


@register("src_cfg", V.with_views("""
SELECT graph_id, id, coalesce(code, '') AS code, 'Statement' AS type FROM cfg_nodes""", "cfg_nodes"))
def q_src_cfg(spark, d):
    n, e, _ = _cfg(spark, d)
    return R.build_cfg(n, e)[0]


UAF_SQL = """
WITH RECURSIVE
vars AS (SELECT DISTINCT fn AS graph_id, v AS var FROM code_lines),
fu AS (SELECT n.graph_id, v.var, n.id AS node,
         contains(n.code, 'free(' || v.var || ')') AS is_free,
         NOT contains(n.code, 'free(' || v.var || ')') AND contains(n.code, v.var) AND NOT contains(n.code, 'free') AS is_use
       FROM cfg_nodes n JOIN vars v ON v.graph_id = n.graph_id),
bfs(graph_id, var, node, d) AS (
  SELECT graph_id, var, node, 0 FROM fu WHERE is_free
  UNION
  SELECT b.graph_id, b.var, e.dst, b.d + 1 FROM bfs b JOIN cfg_edges e ON e.graph_id = b.graph_id AND e.src = b.node
  WHERE b.d < 16),
hit AS (SELECT b.graph_id, b.var, min(b.d) AS dmin FROM bfs b
        JOIN fu u ON u.graph_id = b.graph_id AND u.var = b.var AND u.node = b.node AND u.is_use
        GROUP BY b.graph_id, b.var)
SELECT v.graph_id, v.var, h.dmin IS NOT NULL AS detected,
  CASE WHEN h.dmin IS NOT NULL THEN 1.0 / (h.dmin + 1) ELSE 0.0 END AS score
FROM vars v LEFT JOIN hit h ON h.graph_id = v.graph_id AND h.var = v.var"""


def _uaf_sql() -> str:
    base = V.with_views("SELECT 1", "code_lines", "cfg_nodes", "cfg_edges")
    ctes = base[len("WITH "):base.rindex("\nSELECT 1")]
    return UAF_SQL.replace("WITH RECURSIVE\n", "WITH RECURSIVE\n" + ctes + ",\n", 1)


@register("reach_uaf", _uaf_sql(), rnd=("score",))
def q_reach_uaf(spark, d):
    n, e, v = _cfg(spark, d)
    return R.reach_uaf(n, e, v)


TAINT_COND = " OR ".join(f"contains(n.code, '{s}')" for s in R.TAINT_SOURCES)


TAINT_BODY = f"""
SELECT v.graph_id, v.var, CAST(CASE WHEN t.t = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS taint
FROM (SELECT DISTINCT fn AS graph_id, v AS var FROM code_lines) v
LEFT JOIN (SELECT n.graph_id, w.var, max(CASE WHEN {TAINT_COND} THEN 1 ELSE 0 END) AS t
           FROM cfg_nodes n JOIN (SELECT DISTINCT fn AS graph_id, v AS var FROM code_lines) w ON w.graph_id = n.graph_id
           WHERE contains(n.code, w.var || ' =') GROUP BY n.graph_id, w.var) t
  ON t.graph_id = v.graph_id AND t.var = v.var"""


@register("taint_source", V.with_views(TAINT_BODY, "code_lines", "cfg_nodes"))
def q_taint_source(spark, d):
    n, _, v = _cfg(spark, d)
    return R.taint_source(n, v)
