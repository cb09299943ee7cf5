"""Bindings: vectors, clone search, learning, composite analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cwescope.operators import assemble as AS
from cwescope.operators import codemetrics as CM
from cwescope.operators import encode as EN
from cwescope.operators import graph as G
from cwescope.operators import labelsets as L
from cwescope.operators import learn as LN
from cwescope.operators import metrics as M
from cwescope.operators import nlp as NF
from cwescope.operators import propagate as P
from cwescope.operators import reach as R
from cwescope.operators import score as SC
from cwescope.operators import vectors as VE
from cwescope.operators.corpus import hash32
from cwescope.plans import q_graph as QG
from cwescope.plans.q_code import APICTX_SQL, CYC_SQL
from cwescope.plans.q_eval import CMP_DOUBLES, _cmp_sql
from cwescope.plans.registry import REGISTRY, register
from cwescope.sources import views as V
from cwescope.sources.tables import table


def _emb(spark, d):
    return table(spark, d, "embeddings")


# --- token and text vectors -----------------------------------------------------

def _digits_sql(h: str, dim: int = EN.DIM) -> str:
    return f"list_transform(range(1, {dim + 1}), lambda i: CAST(instr('{EN.HEX}', substr({h}, i, 1)) AS DOUBLE) - 8.5)"


def _tokens_sql(source: str, key: str, text: str) -> str:
    """key, pos, vec of the built-in encoder over a relation."""
    return f"""
SELECT {key}, CAST(pos AS INTEGER) AS pos, {_digits_sql("md5(token)")} AS vec
FROM (SELECT {key}, unnest(w) AS token, unnest(range(0, len(w))) AS pos
      FROM (SELECT {key}, list_slice(regexp_extract_all(lower({text}), '{EN.TOKEN}'), 1, {EN.MAX_TOKENS}) AS w
            FROM {source}) a) b"""


def _mean_sql(source: str, key: str, name: str = "vec") -> str:
    """key, mean vector over a relation of (key, vec)."""
    return f"""
SELECT {key}, list(m ORDER BY i) AS {name}
FROM (SELECT {key}, i, avg(vec[i]) AS m FROM {source}, range(1, {EN.DIM + 1}) r(i) GROUP BY {key}, i) a
GROUP BY {key}"""


def _variance_sql(source: str, key: str) -> str:
    return f"""
SELECT {key}, avg(sd) AS semantic_variance
FROM (SELECT {key}, i, stddev_pop(vec[i]) AS sd FROM {source}, range(1, {EN.DIM + 1}) r(i) GROUP BY {key}, i) a
GROUP BY {key}"""


@register("token_embeddings", _tokens_sql("documents", "doc_id", "text"))
def q_token_embeddings(spark, d):
    return EN.token_embeddings(table(spark, d, "documents"), "doc_id", "text")


@register("token_variance", _variance_sql(f"({_tokens_sql('documents', 'doc_id', 'text')}) t", "doc_id"),
          rnd=("semantic_variance",))
def q_token_variance(spark, d):
    return EN.token_variance(EN.token_embeddings(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@register("text_vectors", _mean_sql(f"({_tokens_sql('documents', 'doc_id', 'text')}) t", "doc_id"))
def q_text_vectors(spark, d):
    return EN.text_vectors(EN.token_embeddings(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@register("embed_corpus", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{EN.TOKEN}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM w
      UNION ALL
      SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) x),
c AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, {EN.BUCKET_DIGITS}) AS INTEGER) AS bucket,
             CAST(count(*) AS DOUBLE) AS n
      FROM t GROUP BY doc_id, bucket),
v AS (SELECT doc_id, list(bucket ORDER BY bucket) AS indices, list(n ORDER BY bucket) AS ns,
             sqrt(sum(n * n)) AS length FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(v.indices, []) AS indices, coalesce(list_transform(v.ns, lambda n: n / v.length), []) AS weights
FROM documents d LEFT JOIN v USING (doc_id)""")
def q_embed_corpus(spark, d):
    return EN.hashed_ngrams(table(spark, d, "documents"), "doc_id", "text")


CLONE_SQL = f"""
SELECT t.vec_id, coalesce(m.max_sim, 0.0) AS max_sim, coalesce(m.max_sim, 0.0) > {VE.CLONE_THRESHOLD} AS is_clone
FROM (SELECT vec_id FROM embeddings WHERE label <> 0) t
LEFT JOIN (SELECT t.vec_id, max(list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))) AS max_sim
           FROM (SELECT * FROM embeddings WHERE label <> 0) t CROSS JOIN (SELECT * FROM embeddings WHERE label = 0) k
           GROUP BY t.vec_id) m ON m.vec_id = t.vec_id"""


@register("clone_join", CLONE_SQL, rnd=("max_sim",))
def q_clone_join(spark, d):
    e = _emb(spark, d)
    return VE.clone_join(e.where(F.col("label") != 0).select(F.col("vec_id"), F.col("embedding").alias("vec")),
                         e.where(F.col("label") == 0).select("vec_id", F.col("embedding").alias("vec")),
                         key="vec_id")


@register("semantic_variance", """
SELECT label, avg(sd) AS semantic_variance FROM (
  SELECT label, dim, stddev_pop(CAST(x AS DOUBLE)) AS sd FROM (
    SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) a
  GROUP BY label, dim) b GROUP BY label""", rnd=("semantic_variance",))
def q_semantic_variance(spark, d):
    return VE.semantic_variance(_emb(spark, d), "label", "embedding")


CLASS_COUNT = 10
CANDIDATES = [LN.Candidate(reg=0.01), LN.Candidate(reg=0.3)]


def _emb_split(spark, d):
    """Features, labels, and the ids of the train, validation and test parts."""
    e = _emb(spark, d)
    share = hash32(F.col("vec_id")) / F.lit(1 << 32)
    parts = [e.where((share >= lo) & (share < hi)).select(F.col("vec_id").alias("sample_id"))
             for lo, hi in ((0.0, 0.7), (0.7, 0.85), (0.85, 1.0))]
    feats = e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vec"))
    labels = e.select(F.col("vec_id").alias("sample_id"),
                      F.explode(F.array(*[F.struct(F.lit(c).alias("cls"),
                                                   (F.col("label") == c).cast("int").alias("y"))
                                          for c in range(CLASS_COUNT)])).alias("t")).select("sample_id", "t.cls", "t.y")
    return feats, labels, *parts


def _selected(spark, d):
    feats, labels, train, val, test = _emb_split(spark, d)
    chosen = LN.select_model(feats, labels, list(range(CLASS_COUNT)), train, val, CANDIDATES, by="fbeta")
    return chosen, chosen.predict(feats, labels, test)


@register("train_multilabel")
def q_train_multilabel(spark, d):
    """Predictions of the chosen model for the test part."""
    return _selected(spark, d)[1]


@register("model_selection")
def q_model_selection(spark, d):
    """The candidates with their validation scores."""
    return _selected(spark, d)[0].scores


@register("evaluate_trained")
def q_evaluate_trained(spark, d):
    return M.evaluate_run(_selected(spark, d)[1])


GRAPH_CLASSES = QG.GRAPH_CLASSES


def _place_sql(i: str, j: str) -> str:
    return f"(({i} * 31 + {j} * 17) % 997 + 1)"


@register("graph_assemble", QG._esql(f"""
SELECT g.graph_id, n.num_nodes, coalesce(e.num_edges, 0) AS num_edges, n.x_digest,
  coalesce(e.edge_digest, 0) AS edge_digest, coalesce(e.attr_digest, 0) AS attr_digest,
  list_transform({GRAPH_CLASSES}, lambda c: CAST(list_contains(coalesce(l.cwes, []), c) AS INTEGER)) AS y,
  'proj' || CAST(g.graph_id % 7 AS VARCHAR) AS project, md5(CAST(g.graph_id AS VARCHAR)) AS commit_id
FROM gsrc g
JOIN (SELECT graph_id, count(*) AS num_nodes, CAST(sum(list_sum(list_transform(range(1, {QG.VOCAB_DIM + 1}), lambda j:
        CAST(round(x[j] * 1000000) AS BIGINT) * {_place_sql('node_id', '(j - 1)')}))) AS BIGINT) AS x_digest
      FROM ({QG.node_features_sql(QG.VOCAB_DIM)}) f GROUP BY graph_id) n ON n.graph_id = g.graph_id
LEFT JOIN (SELECT graph_id, count(*) AS num_edges,
             CAST(sum(src * {_place_sql('k', '0')} + dst * {_place_sql('k', '1')}) AS BIGINT) AS edge_digest,
             CAST(sum(list_sum(list_transform(range(1, {QG.EDGE_SLOTS + 1}), lambda j:
               CAST(round(ef[j] * 1000000) AS BIGINT) * {_place_sql('k', '(j - 1)')}))) AS BIGINT) AS attr_digest
           FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS k
                 FROM ({QG.EDGE_FEATURES_SQL}) f) r GROUP BY graph_id) e ON e.graph_id = g.graph_id
LEFT JOIN (SELECT sample_id, list(cwe) AS cwes FROM tool_labels WHERE tool = 'truth' GROUP BY sample_id) l
  ON l.sample_id = g.graph_id""", "ge", "gsrc", "tool_labels"))
def q_graph_assemble(spark, d):
    """Whole graph rows; the query returns a digest of each of their matrices."""
    g = AS.graph_rows(*QG.graph_tables(spark, d))
    pairs = F.transform("edge_index", lambda s: F.array(s["src"].cast("double"), s["dst"].cast("double")))
    return g.select("graph_id", F.size("x").cast("bigint").alias("num_nodes"),
                    F.size("edge_index").cast("bigint").alias("num_edges"), AS.matrix_digest("x").alias("x_digest"),
                    AS.matrix_digest(pairs, 1).alias("edge_digest"), AS.matrix_digest("edge_attr").alias("attr_digest"),
                    "y", "metadata.project", "metadata.commit_id")


# Fixed weights of the scoring check, by a rule (no training).
def _norm(seed: int, n: int) -> SC.BatchNorm:
    w = QG.numbers
    return SC.BatchNorm(w(seed, n), w(seed + 1, n, 0.5), w(seed + 2, n, 0.5), w(seed + 3, n))


CLASSES = 9
LAYERS = [SC.Layer(QG.weights(1, 4, 4), QG.numbers(1, 4), _norm(1, 4)),
          SC.Layer(QG.weights(2, 4, 3), QG.numbers(2, 3), _norm(2, 3))]
HEAD = SC.Dense(QG.weights(3, 3, 4), QG.numbers(3, 4), QG.weights(4, 4, CLASSES), QG.numbers(4, CLASSES))
THRESHOLDS = [0.3 + 0.05 * c for c in range(CLASSES)]


def _graph_score_sql() -> str:
    """Layers over long rows of (graph, node, dim), degrees per edge."""
    cols = [f"f{i}" for i in range(4)]
    defs, deps, source = {"pw": QG.PW_SQL}, {"pw": ("px",)}, "pw"
    for k, layer in enumerate(LAYERS):
        n, b = len(layer.bias), layer.norm
        z = ", ".join(f"{e} AS z{j}" for j, e in enumerate(QG.linear_sql(cols, layer.weight)))
        sums = ", ".join(f"sum(z.z{j} / sqrt(du.deg * dv.deg)) + CAST({layer.bias[j]!r} AS DOUBLE) AS s{j}" for j in range(n))
        norm = ", ".join(
            f"greatest((s{j} - CAST({b.mean[j]!r} AS DOUBLE)) / sqrt(CAST({b.variance[j]!r} AS DOUBLE) + {b.epsilon!r}) "
            f"* CAST({b.gamma[j]!r} AS DOUBLE) + CAST({b.beta[j]!r} AS DOUBLE), 0.0) AS f{j}" for j in range(n))
        defs[f"z{k}"], deps[f"z{k}"] = f"SELECT graph_id, node_id, {z} FROM {source} q", (source,)
        defs[f"l{k}"] = f"""SELECT graph_id, node_id, {norm} FROM (
  SELECT e.graph_id, e.dst AS node_id, {sums}
  FROM pe e JOIN pdeg du ON du.graph_id = e.graph_id AND du.dst = e.src
  JOIN pdeg dv ON dv.graph_id = e.graph_id AND dv.dst = e.dst
  JOIN z{k} z ON z.graph_id = e.graph_id AND z.node_id = e.src GROUP BY e.graph_id, e.dst) s"""
        deps[f"l{k}"] = (f"z{k}", "pdeg")
        source, cols = f"l{k}", [f"f{j}" for j in range(n)]
    hidden = ", ".join(f"greatest({e}, 0.0) AS h{j}" for j, e in enumerate(QG.linear_sql(
        cols, HEAD.hidden, HEAD.hidden_bias)))
    defs["pool"] = f"SELECT graph_id, {', '.join(f'avg({c}) AS {c}' for c in cols)} FROM {source} GROUP BY graph_id"
    defs["hid"], deps["pool"], deps["hid"] = f"SELECT graph_id, {hidden} FROM pool", (source,), ("pool",)
    logits = ", ".join(QG.linear_sql([f"h{j}" for j in range(len(HEAD.hidden_bias))], HEAD.out, HEAD.out_bias))
    limits = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in THRESHOLDS)
    return QG._esql(f"""
SELECT sc.sample_id, sc.cls, CASE WHEN t.cls IS NULL THEN 0 ELSE 1 END AS y, sc.p,
       CASE WHEN sc.p >= sc.t THEN 1 ELSE 0 END AS yhat
FROM (SELECT sample_id, cls, 1.0 / (1.0 + exp(-z)) AS p, t
      FROM (SELECT graph_id AS sample_id, unnest([{logits}]) AS z, unnest([{limits}]) AS t,
                   unnest(CAST(range({CLASSES}) AS BIGINT[])) AS cls FROM hid) r) sc
LEFT JOIN (SELECT DISTINCT sample_id, CAST(substr(cwe, 5) AS BIGINT) AS cls FROM tool_labels WHERE tool = 'truth') t
  ON t.sample_id = sc.sample_id AND t.cls = sc.cls""", "hid", "tool_labels",
                    extra=QG.PROP_SQL | defs, deps=QG.PROP_DEPS | deps)


@register("graph_score", _graph_score_sql(), rnd=("p",))
def q_graph_score(spark, d):
    """Two layers with batch norm -> mean pooling -> head -> labels, with truth."""
    n = QG._stored(spark, d, *QG.ENDS, "child_count", "depth", "is_named")
    truth = V.tool_labels(spark, d).where(F.col("tool") == "truth").select(
        "sample_id", F.expr("CAST(substring(cwe, 5) AS BIGINT)").alias("cls"))
    return SC.graph_scores(G.edge_union(n), P.node_scalar_features(n), P.SCALAR_FEATURES, LAYERS, HEAD, truth,
                           thresholds=THRESHOLDS, parts=V.graph_parts(spark, d))


# --- features per function ------------------------------------------------------

#: Every function whose number this divides plays a known vulnerable one.
KNOWN_STEP = 97

FN_VEC_CTES = {
    "fn_tokens": _tokens_sql("fn_code", "fn", "code"),
    "fn_vec": _mean_sql("fn_tokens", "fn"),
    "fn_var": _variance_sql("fn_tokens", "fn"),
    "calls": f"SELECT fn, line_no, api, context, fn || '/' || line_no || '/' || api AS call FROM ({APICTX_SQL}) x",
    "call_vec": _mean_sql(f"({_tokens_sql('calls', 'call', 'context')}) t", "call"),
    "fn_ctx": _mean_sql("(SELECT c.fn, v.vec FROM calls c JOIN call_vec v USING (call))", "fn", "context_vec"),
}
FN_VEC_DEPS = {"fn_tokens": ("fn_code",), "fn_vec": ("fn_tokens",), "fn_var": ("fn_tokens",),
               "calls": ("code_lines",), "call_vec": ("calls",), "fn_ctx": ("calls", "call_vec")}
NO_VEC = f"list_transform(range({EN.DIM}), lambda i: CAST(0 AS DOUBLE))"


@register("api_risk_vectors", V.with_views(f"""
SELECT f.fn, coalesce(r.api_risk, 0.0) AS api_risk, CAST(coalesce(r.api_calls, 0) AS BIGINT) AS api_calls,
       coalesce(c.context_vec, {NO_VEC}) AS context_vec
FROM (SELECT DISTINCT fn FROM code_lines) f
LEFT JOIN (SELECT fn, avg(CAST(risk AS DOUBLE)) AS api_risk, count(*) AS api_calls FROM ({APICTX_SQL}) x GROUP BY fn) r
  ON r.fn = f.fn
LEFT JOIN fn_ctx c ON c.fn = f.fn""", "code_lines", "fn_ctx", extra=FN_VEC_CTES, extra_deps=FN_VEC_DEPS),
          rnd=("api_risk",))
def q_api_risk_vectors(spark, d):
    cl = V.code_lines(spark, d)
    return CM.api_risk_vectors(cl, cl.select("fn").distinct())


def _nlp_sql() -> str:
    base = QG._uaf_sql()
    marker = "\nSELECT v.graph_id, v.var, h.dmin IS NOT NULL"
    head, final = base.split(marker, 1)
    final = marker.lstrip("\n") + final
    own = ",\n".join(f"{k} AS ({v.strip()})" for k, v in FN_VEC_CTES.items())
    return head + f""",
uaf AS ({final}),
fn_code AS ({V.VIEW_SQL["fn_code"].strip()}),
{own},
cm AS (SELECT fn, CAST({CYC_SQL} AS INTEGER) AS cyclomatic, CAST(len(string_split(code, chr(10))) AS INTEGER) AS loc
       FROM fn_code),
ar AS (SELECT f.fn, coalesce(r.api_risk, 0.0) AS api_risk FROM (SELECT DISTINCT fn FROM code_lines) f
       LEFT JOIN (SELECT fn, avg(CAST(risk AS DOUBLE)) AS api_risk FROM ({APICTX_SQL}) x GROUP BY fn) r ON r.fn = f.fn),
sim AS (SELECT t.fn, max(list_cosine_similarity(t.vec, k.vec)) AS similarity
        FROM fn_vec t CROSS JOIN (SELECT vec FROM fn_vec WHERE fn % {KNOWN_STEP} = 0) k GROUP BY t.fn),
tt AS ({QG.TAINT_BODY.strip()})
SELECT u.graph_id AS fn, u.var, coalesce(fv.vec, {NO_VEC}) AS vec, ar.api_risk, coalesce(fx.context_vec, {NO_VEC}) AS context_vec,
       coalesce(sim.similarity, 0.0) AS similarity, cm.cyclomatic,
       coalesce(sv.semantic_variance, 0.0) AS semantic_variance, cm.loc,
       u.detected, u.score, tt.taint
FROM uaf u JOIN tt ON tt.graph_id = u.graph_id AND tt.var = u.var
JOIN cm ON cm.fn = u.graph_id JOIN ar ON ar.fn = u.graph_id
LEFT JOIN fn_vec fv ON fv.fn = u.graph_id LEFT JOIN fn_var sv ON sv.fn = u.graph_id
LEFT JOIN fn_ctx fx ON fx.fn = u.graph_id LEFT JOIN sim ON sim.fn = u.graph_id"""


@register("nlp_features", _nlp_sql(), rnd=("api_risk", "similarity", "semantic_variance", "score"))
def q_nlp_features(spark, d):
    cl = V.code_lines(spark, d)
    fc = V.join_lines(cl)
    features = NF.function_features(cl, fc, known=lambda f: f.where(F.col("fn") % KNOWN_STEP == 0))
    nodes, edges, vars_ = QG._cfg(spark, d)
    uaf = R.reach_uaf(nodes, edges, vars_).withColumnRenamed("graph_id", "fn")
    taint = R.taint_source(nodes, vars_).withColumnRenamed("graph_id", "fn")
    return (uaf.join(taint, ["fn", "var"]).join(features, "fn")
            .select("fn", "var", "vec", "api_risk", "context_vec", "similarity", "cyclomatic", "semantic_variance",
                    "loc", "detected", "score", "taint"))


@register("compare_tools_long", _cmp_sql(
    "SELECT tool, metric, score FROM w UNPIVOT (score FOR metric IN (" + ", ".join(CMP_DOUBLES) + "))",
    "w AS (SELECT sl.tool, "
    + REGISTRY["compare_tools"].sql.rsplit("SELECT sl.tool, ", 1)[1].replace(
        "FROM sl JOIN cl USING (tool) CROSS JOIN n", "FROM sl JOIN cl USING (tool) CROSS JOIN n)")
    .replace("CAST(n.n_samples AS BIGINT) AS n_samples,", "", 1)), rnd=("score",))
def q_compare_tools_long(spark, d):
    """Full comparison table in (tool, metric, score) form."""
    labels = V.tool_labels(spark, d)
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return L.report_long(L.compare_tools(labels, samples).drop("n_samples"))
