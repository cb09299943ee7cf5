"""Bindings: corpus filters, statistics, label parsing, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cwescope.functions import labels as LB
from cwescope.operators import corpus as C
from cwescope.plans.registry import register
from cwescope.sources import views as V
from cwescope.sources.dims import EVENT_CLASSES, event_dim, event_dim_sql
from cwescope.sources.tables import table

ALLOW = ["toxic"]
PROJECTS = ["src1", "src7"]


def _corpus(spark, d):
    return V.corpus(spark, d)


def _cs(body: str, *names: str) -> str:
    return V.with_views(body, "corpus", *names)


VUL = "coalesce(len(cwe), 0) > 0"


@register("label_filter", _cs(f"""
SELECT id FROM corpus WHERE NOT ({VUL}) OR list_has_any(cwe, ['toxic'])"""))
def q_label_filter(spark, d):
    return C.label_filter(_corpus(spark, d), ALLOW).select("id")


@register("filter_target", _cs(f"SELECT id FROM corpus WHERE {VUL}"))
def q_filter_target(spark, d):
    return C.filter_target(_corpus(spark, d), 1).select("id")


@register("filter_cwe", _cs("SELECT id FROM corpus WHERE list_has_any(cwe, ['quality'])"))
def q_filter_cwe(spark, d):
    return C.filter_cwe(_corpus(spark, d), ["quality"]).select("id")


@register("filter_project", _cs("SELECT id FROM corpus WHERE project IN ('src1', 'src7')"))
def q_filter_project(spark, d):
    return C.filter_project(_corpus(spark, d), PROJECTS).select("id")


@register("export_ml", _cs(f"""
SELECT id, code AS func, CASE WHEN {VUL} THEN 1 ELSE 0 END AS target,
  coalesce(cwe, []::VARCHAR[]) AS cwes, project, size FROM corpus"""))
def q_export_ml(spark, d):
    return C.export_ml(_corpus(spark, d))


@register("corpus_stats", _cs(f"""
SELECT count(*) AS total_samples,
  count(*) FILTER (WHERE {VUL}) AS vulnerable_samples,
  count(*) FILTER (WHERE NOT ({VUL})) AS non_vulnerable_samples,
  CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE {VUL})) / count(*) ELSE 0.0 END AS vulnerability_ratio,
  count(DISTINCT nullif(cve_id, '')) AS unique_cve_ids,
  count(DISTINCT nullif(project, '')) AS unique_projects
FROM corpus"""), rnd=("vulnerability_ratio",))
def q_corpus_stats(spark, d):
    return C.corpus_stats(_corpus(spark, d))


@register("corpus_values", _cs("""
SELECT DISTINCT 'cve' AS kind, cve_id AS value FROM corpus WHERE cve_id <> ''
UNION ALL SELECT DISTINCT 'project', project FROM corpus WHERE project <> ''"""))
def q_corpus_values(spark, d):
    c = _corpus(spark, d)
    kinds = [C.distinct_values(c, col).select(F.lit(kind).alias("kind"), "value")
             for kind, col in (("cve", "cve_id"), ("project", "project"))]
    return kinds[0].unionByName(kinds[1])


@register("project_profile", _cs(f"""
SELECT project, count(*) AS samples, count(*) FILTER (WHERE {VUL}) AS vuln_samples,
  list_sort(list_distinct(flatten(list(coalesce(cwe, []::VARCHAR[]))))) AS cwes,
  arg_max(commit_url, id) AS repo_url
FROM corpus GROUP BY project"""))
def q_project_profile(spark, d):
    return C.project_profile(_corpus(spark, d))


@register("top_projects", _cs("""
SELECT project, count(*) AS samples FROM corpus GROUP BY project ORDER BY samples DESC, project LIMIT 3"""))
def q_top_projects(spark, d):
    return C.top_projects(_corpus(spark, d))


# --- multi-label vectors over user_days -------------------------------------

CLS_LIST = "[" + ", ".join(f"'{c}'" for c in EVENT_CLASSES) + "]"
NC = len(EVENT_CLASSES)
MH_SQL = f"""
SELECT id, list_transform(range(0, {NC}), lambda i: CASE WHEN list_contains(idxs, i) THEN 1 ELSE 0 END) AS vec
FROM (SELECT id, list_transform(list(label), lambda l: coalesce(list_position({CLS_LIST}, l), 0) - 1) AS idxs
      FROM user_days GROUP BY id) x"""


def _vecs(spark, d):
    ud = V.user_days(spark, d).groupBy("id").agg(F.collect_set("label").alias("labels"))
    return C.with_multi_hot(ud, "labels", EVENT_CLASSES).select("id", "vec")


MH_VIEWS = {"mh": MH_SQL, "ev_dim": event_dim_sql()}
MH_DEPS = {"mh": ("user_days",)}


@register("multi_hot", V.with_views("SELECT id, CAST(vec AS INTEGER[]) AS vec FROM mh", "mh",
                                    extra=MH_VIEWS, extra_deps=MH_DEPS))
def q_multi_hot(spark, d):
    return _vecs(spark, d)


@register("class_distribution", V.with_views("""
SELECT c.idx, coalesce(e.name, 'Idx_' || CAST(c.idx AS VARCHAR)) AS name, c.count,
  round(c.count / n.n * 100, 4) AS percent,
  round((n.n - c.count) / (c.count + CAST(1e-6 AS DOUBLE)), 2) AS pos_weight
FROM (SELECT CAST(idx AS INTEGER) AS idx, CAST(sum(x) AS BIGINT) AS count
      FROM (SELECT unnest(vec) AS x, unnest(range(0, len(vec))) AS idx FROM mh) u GROUP BY idx) c
CROSS JOIN (SELECT count(*) AS n FROM mh) n
LEFT JOIN ev_dim e ON e.idx = c.idx""", "mh", "ev_dim", extra=MH_VIEWS, extra_deps=MH_DEPS),
    rnd=("percent", "pos_weight"))
def q_class_distribution(spark, d):
    return C.class_distribution(_vecs(spark, d), event_dim(spark))


@register("label_density", V.with_views("""
SELECT n_labels, count(*) AS samples, round(count(*) / (SELECT count(*) FROM mh) * 100, 2) AS percent
FROM (SELECT CAST(list_sum(vec) AS INTEGER) AS n_labels FROM mh) x GROUP BY n_labels""",
                                        "mh", extra=MH_VIEWS, extra_deps=MH_DEPS), rnd=("percent",))
def q_label_density(spark, d):
    return C.label_density(_vecs(spark, d))


# --- samples and splits -------------------------------------------------------

def _h(x: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT)"


SAMPLE_LIMIT = int((1 / 3) * (1 << 32))


@register("shuffle_sample", f"SELECT doc_id FROM documents WHERE {_h('doc_id')} < {SAMPLE_LIMIT}")
def q_shuffle_sample(spark, d):
    return C.shuffle_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 1 / 3)


COMBO_SQL = """
SELECT id, array_to_string(list_sort(list(label)), ',') AS combo FROM user_days GROUP BY id"""


@register("split_stratified", V.with_views(f"""
SELECT id, combo, CASE WHEN pos * 100 < n * 70 THEN 'train' WHEN pos * 100 < n * 85 THEN 'val' ELSE 'test' END AS split
FROM (SELECT id, combo, n, (rk - 1 + {_h('combo')} % n) % n AS pos
      FROM (SELECT id, combo, row_number() OVER (PARTITION BY combo ORDER BY {_h('id')}, id) AS rk,
                   count(*) OVER (PARTITION BY combo) AS n FROM combos) a) b""", "combos",
                                           extra={"combos": COMBO_SQL}, extra_deps={"combos": ("user_days",)}))
def q_split_stratified(spark, d):
    ud = V.user_days(spark, d).groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("combo"))
    return C.split_stratified(ud, "id", "combo")


SEQ_SPLIT = """CASE WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
            WHEN idx < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END"""


@register("split_sequential", f"""
SELECT o_orderkey, {SEQ_SPLIT} AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders) x""")
def q_split_sequential(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return C.split_sequential(o, ["o_orderkey"])


WIDE = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@register("split_sequential_wide", f"""
SELECT {WIDE}, idx FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS idx FROM orders) x""")
def q_split_sequential_wide(spark, d):
    """Positions of whole rows: other columns must not move them."""
    i = C.global_index(table(spark, d, "orders"), ["o_orderkey"])
    return i.select(*[c.strip() for c in WIDE.split(",")], F.col("_idx").cast("bigint").alias("idx"))


@register("split_shuffled_wide", f"""
SELECT doc_id, lang, source, n_chars, {SEQ_SPLIT} AS split
FROM (SELECT *, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1 AS idx, count(*) OVER () AS n
      FROM documents) x""")
def q_split_shuffled_wide(spark, d):
    return C.split_shuffled(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@register("split_shuffled", f"""
SELECT doc_id, {SEQ_SPLIT} AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1 AS idx, count(*) OVER () AS n
      FROM documents) x""")
def q_split_shuffled(spark, d):
    return C.split_shuffled(table(spark, d, "documents").select("doc_id"), "doc_id")


# --- ids, URLs, file names, rules ----------------------------------------------

URL_SQL = """
SELECT id, CASE id % 4
  WHEN 0 THEN concat('https://github.com/', project, '/', lang, '/commit/', md5(CAST(id AS VARCHAR)))
  WHEN 1 THEN concat('https://gitlab.com/', project, '/', lang, '/sub/-/commit/', md5(CAST(id AS VARCHAR)))
  WHEN 2 THEN concat('https://github.com/', project, '/', lang, '/commit/', substr(md5(CAST(id AS VARCHAR)), 1, 6))
  ELSE concat('https://github.com/', project, '/', lang, '/commit/', md5(CAST(id AS VARCHAR)), '?diff=split') END AS url
FROM corpus"""


def _urls(spark, d):
    c = _corpus(spark, d)
    md = F.md5(F.col("id").cast("string"))
    base = lambda host: F.concat(F.lit(host), F.col("project"), F.lit("/"), F.col("lang"))
    url = (F.when(F.col("id") % 4 == 0, F.concat(base("https://github.com/"), F.lit("/commit/"), md))
           .when(F.col("id") % 4 == 1, F.concat(base("https://gitlab.com/"), F.lit("/sub/-/commit/"), md))
           .when(F.col("id") % 4 == 2, F.concat(base("https://github.com/"), F.lit("/commit/"),
                                                F.substring(md, 1, 6)))
           .otherwise(F.concat(base("https://github.com/"), F.lit("/commit/"), md, F.lit("?diff=split"))))
    return c.select("id", url.alias("url"))


GH = LB.GITHUB_COMMIT
GL = LB.GITLAB_COMMIT


@register("parse_git_url", V.with_views(f"""
SELECT id, url,
  CASE WHEN regexp_extract(url, '{GH}', 1) <> ''
       THEN regexp_extract(url, '{GH}', 1) || '/' || regexp_extract(url, '{GH}', 2)
       ELSE nullif(regexp_extract(url, '{GL}', 1), '') END AS project,
  CASE WHEN regexp_extract(url, '{GH}', 1) <> '' THEN nullif(regexp_extract(url, '{GH}', 3), '')
       ELSE nullif(regexp_extract(url, '{GL}', 2), '') END AS commit_id
FROM urls""", "urls", extra={"urls": URL_SQL}, extra_deps={"urls": ("corpus",)}))
def q_parse_git_url(spark, d):
    u = _urls(spark, d)
    p = LB.parse_git_url(F.col("url"))
    return u.select("id", "url", p["project"].alias("project"), p["commit_id"].alias("commit_id"))


STEM_SQL = """CASE WHEN regexp_matches(nm, '^.+\\.[^.]+$') THEN regexp_extract(nm, '^(.+)\\.[^.]+$', 1) ELSE nm END"""


def _stem_sql(path: str) -> str:
    return STEM_SQL.replace("nm", f"regexp_extract({path}, '([^/]*)$', 1)")


@register("key_from_filename", f"""
SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '' ELSE string_split({_stem_sql('url')}, '_')[-1] END AS key
FROM pages""")
def q_key_from_filename(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", LB.key_from_filename(F.col("url")).alias("key"))


SCAN_URL_SQL = """
SELECT doc_id, concat('https://scan.example/', source, '/', lang, '_', CAST(doc_id AS VARCHAR),
  CASE WHEN doc_id % 5 = 0 THEN '.h' ELSE '.c' END, '#L', CAST(n_chars % 100 AS VARCHAR)) AS url FROM documents"""


def _scan_url(doc):
    url = F.concat(F.lit("https://scan.example/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"),
                   F.col("doc_id").cast("string"),
                   F.when(F.col("doc_id") % 5 == 0, F.lit(".h")).otherwise(F.lit(".c")),
                   F.lit("#L"), (F.col("n_chars") % 100).cast("string"))
    return doc.select("doc_id", url.alias("url"))


@register("key_from_url", V.with_views("""
SELECT doc_id, regexp_extract(url, '_([0-9]+)\\.c', 1) AS key FROM surl
WHERE regexp_extract(url, '_([0-9]+)\\.c', 1) <> ''""", "surl", extra={"surl": SCAN_URL_SQL}))
def q_key_from_url(spark, d):
    url = _scan_url(table(spark, d, "documents"))
    k = url.select("doc_id", LB.key_from_url(F.col("url")).alias("key"))
    # Rows without a key would all share '' and never join: they are dropped
    # (``key_from_url_counts`` reports how many).
    return k.where(F.col("key") != "")


@register("key_from_url_counts", V.with_views("""
SELECT regexp_extract(url, '_([0-9]+)\\.c', 1) <> '' AS has_key, CAST(count(*) AS BIGINT) AS n
FROM surl GROUP BY 1""", "surl", extra={"surl": SCAN_URL_SQL}))
def q_key_from_url_counts(spark, d):
    url = _scan_url(table(spark, d, "documents"))
    return url.select((LB.key_from_url(F.col("url")) != "").alias("has_key")) \
        .groupBy("has_key").agg(F.count(F.lit(1)).alias("n"))


FNAME_SQL = """
SELECT doc_id,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE source END AS looked_up,
  CASE WHEN doc_id % 2 = 0 THEN concat('data/', source, '_', lang, '_', substr(md5(CAST(doc_id AS VARCHAR)), 1, 7), '_', CAST(doc_id AS VARCHAR), '.c')
       ELSE concat(lang, '_', CAST(doc_id AS VARCHAR), '.c') END AS file_name
FROM documents"""


@register("project_fallback", V.with_views(f"""
SELECT doc_id, CASE WHEN looked_up IS NULL OR looked_up = '' OR looked_up = 'unknown' THEN
    CASE WHEN len(string_split({_stem_sql('file_name')}, '_')) >= 3
         THEN array_to_string(string_split({_stem_sql('file_name')}, '_')[1:len(string_split({_stem_sql('file_name')}, '_')) - 2], '_')
         ELSE 'unknown' END
  ELSE looked_up END AS project
FROM fnames""", "fnames", extra={"fnames": FNAME_SQL}))
def q_project_fallback(spark, d):
    doc = table(spark, d, "documents")
    looked = (F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
              .when(F.col("doc_id") % 3 == 1, F.lit("unknown")).otherwise(F.col("source")))
    fname = F.when(F.col("doc_id") % 2 == 0, F.concat(
        F.lit("data/"), F.col("source"), F.lit("_"), F.col("lang"), F.lit("_"),
        F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), F.lit("_"),
        F.col("doc_id").cast("string"), F.lit(".c"))).otherwise(
        F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".c")))
    return doc.select("doc_id", LB.project_fallback(looked, fname).alias("project"))


RULE_FRAGMENTS = [s for subs, _ in LB.RULE_TO_CWE for s in subs] + ["security.other-rule", ""]
NF = len(RULE_FRAGMENTS)
FRAG_LIST = "[" + ", ".join(f"'{s}'" for s in RULE_FRAGMENTS) + "]"


def _rule_case_sql(col: str) -> str:
    parts = []
    for subs, cwe in LB.RULE_TO_CWE:
        cond = " OR ".join(f"contains({col}, '{s}')" for s in subs)
        parts.append(f"WHEN {cond} THEN '{cwe}'")
    return "CASE " + " ".join(parts) + " END"


@register("rule_to_cwe", f"""
SELECT p_partkey, rule, {_rule_case_sql('rule')} AS cwe FROM (
  SELECT p_partkey, concat('c.lang.', lower(p_brand), '.', {FRAG_LIST}[CAST(p_partkey % {NF} AS INTEGER) + 1]) AS rule
  FROM part) x""")
def q_rule_to_cwe(spark, d):
    p = table(spark, d, "part")
    frags = F.array(*[F.lit(s) for s in RULE_FRAGMENTS])
    rule = F.concat(F.lit("c.lang."), F.lower("p_brand"), F.lit("."),
                    F.element_at(frags, (F.col("p_partkey") % NF).cast("int") + 1))
    return p.select("p_partkey", rule.alias("rule")).select("p_partkey", "rule",
                                                            LB.rule_to_cwe(F.col("rule")).alias("cwe"))
