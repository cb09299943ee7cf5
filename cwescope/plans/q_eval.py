"""Bindings: tool comparison (``tool_labels``) and model metrics (``pred``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cwescope.operators import labelsets as L
from cwescope.operators import metrics as M
from cwescope.plans.registry import register
from cwescope.sources import views as V
from cwescope.sources.dims import class_names, label_dim_sql
from cwescope.sources.tables import table


def _labels(spark, d):
    return V.tool_labels(spark, d)


def _samples(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))


# --------------------------------------------------------------------------
# Oracle building blocks (DuckDB). An independent formulation: truth is
# crossed with the tool list and FULL OUTER JOINed with each tool's labels.

CMP_CTES = """
s AS (SELECT o_orderkey AS sample_id FROM orders),
lab AS (SELECT sample_id, tool, cwe FROM tool_labels WHERE sample_id IN (SELECT sample_id FROM s)),
tl AS (SELECT * FROM (VALUES ('tool_a'), ('tool_b'), ('tool_c'), ('model')) v(tool)),
tr AS (SELECT tl.tool, lab.sample_id, lab.cwe FROM tl CROSS JOIN lab WHERE lab.tool = 'truth'),
pr AS (SELECT tool, sample_id, cwe FROM lab WHERE tool <> 'truth'),
fj AS (SELECT coalesce(tr.tool, pr.tool) AS tool, coalesce(tr.sample_id, pr.sample_id) AS sample_id,
         coalesce(tr.cwe, pr.cwe) AS cwe,
         CASE WHEN tr.cwe IS NULL THEN 0 ELSE 1 END AS t,
         CASE WHEN pr.cwe IS NULL THEN 0 ELSE 1 END AS p
       FROM tr FULL OUTER JOIN pr ON tr.tool = pr.tool AND tr.sample_id = pr.sample_id AND tr.cwe = pr.cwe),
smp AS (SELECT tool, sample_id, sum(t * p) AS inter, count(*) AS uni, sum(t) AS nt, sum(p) AS np
        FROM fj GROUP BY tool, sample_id),
n AS (SELECT count(*) AS n_samples FROM s),
sl AS (SELECT tool,
         count(*) FILTER (WHERE nt > 0 AND np > 0) AS btp,
         count(*) FILTER (WHERE nt = 0 AND np > 0) AS bfp,
         count(*) FILTER (WHERE nt > 0 AND np = 0) AS bfn,
         count(*) FILTER (WHERE inter <> nt OR inter <> np) AS mismatch,
         sum(inter / uni) AS jac_sum,
         count(*) FILTER (WHERE inter > 0) AS partial
       FROM smp GROUP BY tool),
univ AS (SELECT DISTINCT cwe FROM lab),
tc AS (SELECT cwe, count(*) AS support FROM lab WHERE tool = 'truth' GROUP BY cwe),
cls0 AS (SELECT tl.tool, u.cwe,
           coalesce(sum(fj.t * fj.p), 0) AS tp, coalesce(sum((1 - fj.t) * fj.p), 0) AS fp,
           coalesce(sum(fj.t * (1 - fj.p)), 0) AS fn
         FROM tl CROSS JOIN univ u LEFT JOIN fj ON fj.tool = tl.tool AND fj.cwe = u.cwe
         GROUP BY tl.tool, u.cwe),
cls AS (SELECT cls0.*, coalesce(tc.support, 0) AS support,
          CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
        FROM cls0 LEFT JOIN tc USING (cwe)),
cl AS (SELECT tool, sum(tp) AS stp, sum(fp) AS sfp, sum(fn) AS sfn, avg(f1) AS f1_macro,
         coalesce(sum(tp) FILTER (WHERE support > 0), 0) AS ktp,
         coalesce(sum(fp) FILTER (WHERE support > 0), 0) AS kfp,
         coalesce(sum(fn) FILTER (WHERE support > 0), 0) AS kfn,
         coalesce(avg(f1) FILTER (WHERE support > 0), 0.0) AS f1_macro_known
       FROM cls GROUP BY tool)
"""


def _f1(tp, fp, fn):
    return (f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 "
            f"THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END")


def _div(a, b):
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


BIN_SELECT = f"""
  CAST(n.n_samples AS BIGINT) AS n_samples,
  (n.n_samples - bfp - bfn) / n.n_samples AS accuracy,
  {_div('btp', 'btp + bfp')} AS precision,
  {_div('btp', 'btp + bfn')} AS recall,
  {_f1('btp', 'bfp', 'bfn')} AS f1"""

def _cmp_sql(select: str, *ctes: str) -> str:
    """tool_labels view + comparison CTEs (+ extra CTEs) + final select."""
    extra = "".join(",\n" + c.strip() for c in ctes)
    return (V.with_views("", "tool_labels").rstrip() + ",\n" + CMP_CTES.strip() + extra
            + "\n" + select.strip())


CMP_DOUBLES = ("accuracy", "precision", "recall", "f1", "jaccard", "f1_micro", "f1_macro",
               "exact_match", "partial_match", "f1_micro_known", "f1_macro_known")


@register("compare_tools", _cmp_sql(f"""
SELECT sl.tool, {BIN_SELECT},
  jac_sum / n.n_samples AS jaccard,
  {_f1('stp', 'sfp', 'sfn')} AS f1_micro,
  f1_macro,
  (n.n_samples - mismatch) / n.n_samples AS exact_match,
  partial / n.n_samples AS partial_match,
  {_f1('ktp', 'kfp', 'kfn')} AS f1_micro_known,
  f1_macro_known
FROM sl JOIN cl USING (tool) CROSS JOIN n"""), rnd=CMP_DOUBLES)
def q_compare_tools(spark, d):
    return L.compare_tools(_labels(spark, d), _samples(spark, d))


@register("binary_metrics", _cmp_sql(f"""
SELECT sl.tool, {BIN_SELECT} FROM sl CROSS JOIN n"""),
    rnd=("accuracy", "precision", "recall", "f1"))
def q_binary_metrics(spark, d):
    return L.compare_tools(_labels(spark, d), _samples(spark, d)).select(
        "tool", "n_samples", "accuracy", "precision", "recall", "f1")


@register("jaccard_samples", _cmp_sql("""
SELECT sl.tool, jac_sum / n.n_samples AS jaccard FROM sl CROSS JOIN n"""), rnd=("jaccard",))
def q_jaccard_samples(spark, d):
    return L.compare_tools(_labels(spark, d), _samples(spark, d)).select("tool", "jaccard")


@register("partial_match", _cmp_sql("""
SELECT sl.tool, partial / n.n_samples AS partial_match FROM sl CROSS JOIN n"""),
    rnd=("partial_match",))
def q_partial_match(spark, d):
    return L.compare_tools(_labels(spark, d), _samples(spark, d)).select("tool", "partial_match")


@register("binarize_known", _cmp_sql(f"""
SELECT tool, {_f1('ktp', 'kfp', 'kfn')} AS f1_micro_known, f1_macro_known FROM cl"""),
    rnd=("f1_micro_known", "f1_macro_known"))
def q_binarize_known(spark, d):
    return L.compare_tools(_labels(spark, d), _samples(spark, d)).select(
        "tool", "f1_micro_known", "f1_macro_known")


@register("binary_confusion", _cmp_sql("""
SELECT tool, y, yhat, CAST(cnt AS BIGINT) AS n FROM (
  SELECT tool, 0 AS y, 0 AS yhat, n.n_samples - btp - bfp - bfn AS cnt FROM sl CROSS JOIN n
  UNION ALL SELECT tool, 0, 1, bfp FROM sl
  UNION ALL SELECT tool, 1, 0, bfn FROM sl
  UNION ALL SELECT tool, 1, 1, btp FROM sl) x"""))
def q_binary_confusion(spark, d):
    return L.binary_confusion(_labels(spark, d), _samples(spark, d))


@register("fpr_coverage", _cmp_sql("""
SELECT tool,
  CASE WHEN n.n_samples - nv.n_vuln > 0 THEN bfp / (n.n_samples - nv.n_vuln) ELSE 0.0 END AS fpr,
  CASE WHEN nv.n_vuln > 0 THEN btp / nv.n_vuln ELSE 0.0 END AS coverage
FROM sl CROSS JOIN n CROSS JOIN nv""", "nv AS (SELECT count(DISTINCT sample_id) AS n_vuln FROM lab WHERE tool = 'truth')"),
    rnd=("fpr", "coverage"))
def q_fpr_coverage(spark, d):
    return L.fpr_coverage(_labels(spark, d), _samples(spark, d))


@register("recall_by_class_tool", _cmp_sql("""
SELECT cwe, tool, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
FROM cls WHERE cwe IN (SELECT cwe FROM top)""", "top AS (SELECT cwe FROM tc ORDER BY support DESC, cwe LIMIT 10)"),
    rnd=("recall",))
def q_recall_by_class_tool(spark, d):
    return L.recall_by_class_tool(_labels(spark, d), _samples(spark, d))


@register("report_long", _cmp_sql("""
SELECT tool, metric, score FROM w
UNPIVOT (score FOR metric IN (accuracy, precision, recall, f1))""", "w AS (SELECT tool, accuracy, precision, recall, f1 FROM "
                    f"(SELECT sl.tool, {BIN_SELECT} FROM sl CROSS JOIN n) w0)"),
    rnd=("score",))
def q_report_long(spark, d):
    w = L.compare_tools(_labels(spark, d), _samples(spark, d)).select(
        "tool", "accuracy", "precision", "recall", "f1")
    return L.report_long(w)


@register("top_classes", V.with_views("""
SELECT cwe, count(*) AS n FROM tool_labels WHERE tool = 'truth' GROUP BY cwe ORDER BY n DESC, cwe LIMIT 10""",
                                      "tool_labels"))
def q_top_classes(spark, d):
    return L.top_classes(_labels(spark, d))


@register("label_universe", V.with_views("""
SELECT DISTINCT cwe FROM tool_labels""", "tool_labels"))
def q_label_universe(spark, d):
    return L.label_universe(_labels(spark, d))


MERGE_BODY = """
SELECT s.sample_id,
  coalesce(list_sort(list(DISTINCT cwe) FILTER (WHERE tool = 'truth')), []::VARCHAR[]) AS truth,
  coalesce(list_sort(list(DISTINCT cwe) FILTER (WHERE tool = 'tool_a')), []::VARCHAR[]) AS tool_a,
  coalesce(list_sort(list(DISTINCT cwe) FILTER (WHERE tool = 'tool_b')), []::VARCHAR[]) AS tool_b,
  coalesce(list_sort(list(DISTINCT cwe) FILTER (WHERE tool = 'tool_c')), []::VARCHAR[]) AS tool_c,
  coalesce(list_sort(list(DISTINCT cwe) FILTER (WHERE tool = 'model')), []::VARCHAR[]) AS model
FROM tool_labels s GROUP BY s.sample_id"""
MERGE_SQL = V.with_views(MERGE_BODY, "tool_labels")


@register("merge_findings", MERGE_SQL)
def q_merge_findings(spark, d):
    return L.merge_findings(_labels(spark, d))


@register("label_overlap", V.with_views("""
SELECT sample_id, list_sort(list_intersect(truth, model)) AS overlap FROM mf""", "mf",
                                        extra={"mf": MERGE_BODY},
                                        extra_deps={"mf": ("tool_labels",)}))
def q_label_overlap(spark, d):
    m = L.merge_findings(_labels(spark, d))
    return m.select("sample_id", L.label_overlap(F.col("truth"), F.col("model")).alias("overlap"))


@register("ensure_list", V.with_views("""
SELECT sample_id, tool,
  CASE WHEN cwe IS NULL OR cwe = '' THEN []::VARCHAR[] ELSE [cwe] END AS cwes
FROM (SELECT sample_id, tool, CASE WHEN tool = 'tool_c' THEN '' ELSE cwe END AS cwe FROM tool_labels) x""",
                                      "tool_labels"))
def q_ensure_list(spark, d):
    lab = _labels(spark, d)
    raw = F.when(F.col("tool") == "tool_c", F.lit("")).otherwise(F.col("cwe"))
    return lab.select("sample_id", "tool", L.ensure_list(raw).alias("cwes"))


# --------------------------------------------------------------------------
# Metrics on the dense prediction table.

PRED_COUNTS = """
c AS (SELECT cls,
        CAST(sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM pred GROUP BY cls)"""


def _pred_sql(body: str, *ctes: str) -> str:
    head = V.with_views("", "pred").rstrip()
    extra = ",\n".join(c.strip() for c in ctes)
    return head + (",\n" + extra if extra else "") + "\n" + body.strip()


@register("confusion_per_class", _pred_sql(f"""
SELECT cls, tp, fp, fn, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall FROM c""",
                                           PRED_COUNTS), rnd=("precision", "recall"))
def q_confusion_per_class(spark, d):
    return M.confusion_per_class(V.pred(spark, d))


@register("class_f1", _pred_sql(f"SELECT cls, {_f1('tp', 'fp', 'fn')} AS f1 FROM c", PRED_COUNTS),
          rnd=("f1",))
def q_class_f1(spark, d):
    return M.class_f1(V.pred(spark, d))


def _fb(tp, fp, fn, beta):
    b2 = float(beta) ** 2
    a = 1 + b2
    return (f"CASE WHEN CAST({a} AS DOUBLE) * {tp} + CAST({b2} AS DOUBLE) * {fn} + {fp} <> 0 "
            f"THEN CAST({a} AS DOUBLE) * {tp} / (CAST({a} AS DOUBLE) * {tp} + CAST({b2} AS DOUBLE) * {fn} + {fp}) "
            f"ELSE 0.0 END")


PRF_CTES = [PRED_COUNTS, f"""
pc AS (SELECT tp, fp, fn, tp + fn AS support, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r,
         {_f1('tp', 'fp', 'fn')} AS f, {_fb('tp', 'fp', 'fn', 1.5)} AS fb FROM c)""", f"""
ca AS (SELECT sum(tp) AS stp, sum(fp) AS sfp, sum(fn) AS sfn, avg(p) AS macro_p, avg(r) AS macro_r,
         avg(f) AS macro_f, avg(fb) AS macro_fb,
         {_div('sum(p * support)', 'sum(support)')} AS w_p, {_div('sum(r * support)', 'sum(support)')} AS w_r,
         {_div('sum(f * support)', 'sum(support)')} AS w_f, {_div('sum(fb * support)', 'sum(support)')} AS w_fb
       FROM pc)""", """
ps AS (SELECT sample_id, sum(y * yhat) AS tp, sum((1 - y) * yhat) AS fp, sum(y * (1 - yhat)) AS fn
       FROM pred GROUP BY sample_id)""", f"""
sa AS (SELECT avg({_div('tp', 'tp + fp')}) AS s_p, avg({_div('tp', 'tp + fn')}) AS s_r,
         avg({_f1('tp', 'fp', 'fn')}) AS s_f, avg({_fb('tp', 'fp', 'fn', 1.5)}) AS s_fb FROM ps)""", """
dg AS (SELECT (min(y) = max(y)) OR (min(yhat) = max(yhat)) AS degenerate FROM pred)"""]

PRF_BODY = f"""
SELECT average,
  CASE WHEN degenerate THEN 0.0 ELSE precision END AS precision,
  CASE WHEN degenerate THEN 0.0 ELSE recall END AS recall,
  CASE WHEN degenerate THEN 0.0 ELSE f1 END AS f1,
  CASE WHEN degenerate THEN 0.0 ELSE fbeta END AS fbeta
FROM (
  SELECT 'micro' AS average, {_div('stp', 'stp + sfp')} AS precision, {_div('stp', 'stp + sfn')} AS recall,
         {_f1('stp', 'sfp', 'sfn')} AS f1, {_fb('stp', 'sfp', 'sfn', 1.5)} AS fbeta FROM ca
  UNION ALL SELECT 'macro', macro_p, macro_r, macro_f, macro_fb FROM ca
  UNION ALL SELECT 'weighted', w_p, w_r, w_f, w_fb FROM ca
  UNION ALL SELECT 'samples', s_p, s_r, s_f, s_fb FROM sa
) x CROSS JOIN dg"""


@register("prf_averaged", _pred_sql(PRF_BODY, *PRF_CTES),
          rnd=("precision", "recall", "f1", "fbeta"))
def q_prf_averaged(spark, d):
    return M.prf_averaged(V.pred(spark, d))


@register("prf_binary", _pred_sql(f"""
SELECT 'binary' AS average, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
  {_f1('tp', 'fp', 'fn')} AS f1, {_fb('tp', 'fp', 'fn', 1.5)} AS fbeta FROM c WHERE cls = 0""", PRED_COUNTS),
          rnd=("precision", "recall", "f1", "fbeta"))
def q_prf_binary(spark, d):
    return M.prf_binary(V.pred(spark, d), 0)


SAMPLE_CTE = """
ss AS (SELECT sample_id, bool_and(y = yhat) AS exact, max(y) AS any_true, max(yhat) AS any_pred,
         sum(y * yhat) AS tp FROM pred GROUP BY sample_id)"""
SAMPLE_SELECT = """avg(CASE WHEN exact THEN 1 ELSE 0 END) AS subset_accuracy,
  avg(CASE WHEN any_true = any_pred THEN 1 ELSE 0 END) AS binary_accuracy,
  avg(CASE WHEN tp > 0 OR (any_true = 0 AND any_pred = 0) THEN 1 ELSE 0 END) AS any_label_true"""


@register("subset_accuracy", _pred_sql("SELECT avg(CASE WHEN exact THEN 1 ELSE 0 END) AS subset_accuracy FROM ss",
                                       SAMPLE_CTE), rnd=("subset_accuracy",))
def q_subset_accuracy(spark, d):
    return M.sample_scores(V.pred(spark, d)).select("subset_accuracy")


@register("binary_accuracy", _pred_sql(
    "SELECT avg(CASE WHEN any_true = any_pred THEN 1 ELSE 0 END) AS binary_accuracy FROM ss", SAMPLE_CTE),
    rnd=("binary_accuracy",))
def q_binary_accuracy(spark, d):
    return M.sample_scores(V.pred(spark, d)).select("binary_accuracy")


@register("any_label_true", _pred_sql(
    "SELECT avg(CASE WHEN tp > 0 OR (any_true = 0 AND any_pred = 0) THEN 1 ELSE 0 END) AS any_label_true FROM ss",
    SAMPLE_CTE), rnd=("any_label_true",))
def q_any_label_true(spark, d):
    return M.sample_scores(V.pred(spark, d)).select("any_label_true")


AUC_CTES = ["""
dd AS (SELECT cls, p, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY cls, p)""", """
rr AS (SELECT cls, p, pos, neg, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY p
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM dd)""", """
aa AS (SELECT cls, sum(pos * (below + CAST(0.5 AS DOUBLE) * neg)) AS u, sum(pos) AS np, sum(neg) AS nn
       FROM rr GROUP BY cls)""", """
auc AS (SELECT cls, CASE WHEN np > 0 AND nn > 0 THEN u / (np * nn) END AS auc FROM aa)"""]


@register("roc_auc_macro", _pred_sql("SELECT avg(auc) AS roc_auc FROM auc", *AUC_CTES), rnd=("roc_auc",))
def q_roc_auc_macro(spark, d):
    return M.roc_auc_macro(V.pred(spark, d))


@register("evaluate_run", _pred_sql("""
SELECT CASE WHEN dg.degenerate THEN 0.0 ELSE (SELECT avg(auc) FROM auc) END AS roc_auc,
  sx.subset_accuracy AS accuracy, m.precision, m.recall, m.f1 AS f1_score, m.fbeta AS fbeta_score,
  sx.binary_accuracy, sx.any_label_true
FROM (""" + PRF_BODY.strip() + """) m CROSS JOIN dg CROSS JOIN (SELECT """ + SAMPLE_SELECT + """ FROM ss) sx
WHERE m.average = 'macro'""", *PRF_CTES, SAMPLE_CTE, *AUC_CTES),
    rnd=("roc_auc", "accuracy", "precision", "recall", "f1_score", "fbeta_score", "binary_accuracy",
         "any_label_true"))
def q_evaluate_run(spark, d):
    return M.evaluate_run(V.pred(spark, d))


TUNE_CTES = ["""
g AS (SELECT i, CAST(0.1 AS DOUBLE) + i * ((CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE)) / 49) AS t
      FROM range(50) r(i))""", """
gf AS (SELECT pr.cls, g.i, g.t,
         sum(CASE WHEN pr.y = 1 AND pr.p >= g.t THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN pr.y = 0 AND pr.p >= g.t THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN pr.y = 1 AND pr.p < g.t THEN 1 ELSE 0 END) AS fn
       FROM pred pr CROSS JOIN g GROUP BY pr.cls, g.i, g.t)""", f"""
gb AS (SELECT cls, i, t, {_f1('tp', 'fp', 'fn')} AS f1,
         row_number() OVER (PARTITION BY cls ORDER BY {_f1('tp', 'fp', 'fn')} DESC, i) AS rn FROM gf)""", """
th AS (SELECT cls, CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS threshold, f1 AS best_f1 FROM gb WHERE rn = 1)"""]


@register("tune_thresholds", _pred_sql("SELECT cls, threshold, best_f1 FROM th", *TUNE_CTES),
          rnd=("threshold", "best_f1"))
def q_tune_thresholds(spark, d):
    return M.tune_thresholds(V.pred(spark, d))


@register("decode_labels", _pred_sql("""
SELECT pr.sample_id,
  coalesce(list_sort(list(coalesce(nm.cwe_id, 'Unknown-' || CAST(pr.cls AS VARCHAR)))
                     FILTER (WHERE pr.p > coalesce(th.threshold, 0.5))), []::VARCHAR[]) AS labels
FROM pred pr LEFT JOIN th ON th.cls = pr.cls LEFT JOIN nm ON nm.idx = pr.cls
GROUP BY pr.sample_id""", *TUNE_CTES, "nm AS (" + label_dim_sql() + ")"))
def q_decode_labels(spark, d):
    p = V.pred(spark, d)
    th = M.tune_thresholds(p).select("cls", "threshold")
    return M.decode_labels(p, th, class_names(spark), op=">")


@register("decode_labels_at_least", _pred_sql("""
SELECT pr.sample_id,
  coalesce(list_sort(list(coalesce(nm.cwe_id, 'Unknown-' || CAST(pr.cls AS VARCHAR)))
                     FILTER (WHERE pr.p >= coalesce(th.threshold, 0.5))), []::VARCHAR[]) AS labels
FROM pred pr LEFT JOIN th ON th.cls = pr.cls LEFT JOIN nm ON nm.idx = pr.cls
GROUP BY pr.sample_id""", *TUNE_CTES, "nm AS (" + label_dim_sql() + ")"))
def q_decode_labels_at_least(spark, d):
    p = V.pred(spark, d)
    th = M.tune_thresholds(p).select("cls", "threshold")
    return M.decode_labels(p, th, class_names(spark), op=">=")


@register("best_class", _pred_sql("""
SELECT sample_id, cls AS best_cls, p AS best_p FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, cls) AS rn FROM pred) x
WHERE rn = 1"""), rnd=("best_p",))
def q_best_class(spark, d):
    return M.best_class(V.pred(spark, d))


@register("pos_weight", _pred_sql("""
SELECT cls, CASE WHEN pos > 0 THEN (n - pos) / pos ELSE CAST(1.0 AS DOUBLE) END AS pos_weight
FROM (SELECT cls, sum(y) AS pos, count(*) AS n FROM pred GROUP BY cls) x"""), rnd=("pos_weight",))
def q_pos_weight(spark, d):
    return M.pos_weight(V.pred(spark, d))


Z = "(p * CAST(8.0 AS DOUBLE) - CAST(4.0 AS DOUBLE))"
BCE = f"((1 - y) * {Z} + ln(1 + exp(-abs({Z}))) + greatest(-{Z}, CAST(0.0 AS DOUBLE)))"


@register("loss_bce", _pred_sql(f"SELECT avg({BCE}) AS loss FROM pred"), rnd=("loss",))
def q_loss_bce(spark, d):
    return M.loss_bce(V.pred(spark, d))


@register("loss_focal", _pred_sql(
    f"SELECT avg(CAST(1.0 AS DOUBLE) * pow(1 - exp(-{BCE}), 2.0) * {BCE}) AS loss FROM pred"), rnd=("loss",))
def q_loss_focal(spark, d):
    return M.loss_focal(V.pred(spark, d))


@register("loss_weighted", _pred_sql(f"""
SELECT sum(w * {BCE}) / sum(w) AS loss FROM (
  SELECT *, CASE WHEN y = 1 THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS w FROM pred) x"""),
    rnd=("loss",))
def q_loss_weighted(spark, d):
    return M.loss_weighted(V.pred(spark, d))


@register("sigmoid_softmax", _pred_sql(f"""
SELECT sample_id, cls, 1.0 / (1.0 + exp(-z)) AS sigmoid, e / sum(e) OVER (PARTITION BY sample_id) AS softmax
FROM (SELECT sample_id, cls, z, exp(z - max(z) OVER (PARTITION BY sample_id)) AS e
      FROM (SELECT sample_id, cls, {Z} AS z FROM pred) y) x"""), rnd=("sigmoid", "softmax"))
def q_sigmoid_softmax(spark, d):
    return M.softmax_per_sample(V.pred(spark, d))
