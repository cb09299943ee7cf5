"""Bindings: code metrics, comment removal, API context and naming rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cwescope.functions import code as CF
from cwescope.functions import naming as NF
from cwescope.operators import codemetrics as CM
from cwescope.plans.registry import register
from cwescope.sources import views as V
from cwescope.sources.tables import table

# DuckDB (RE2) form of the comment pattern: same text, no look-around needed.
COMMENT_SQL = CF.COMMENT_OR_LITERAL.replace("'", "''")


@register("strip_comments", V.with_views(f"""
SELECT fn, regexp_replace(code, '{COMMENT_SQL}', '\\1', 'g') AS code FROM fn_code""", "fn_code"))
def q_strip_comments(spark, d):
    f = V.fn_code(spark, d)
    return f.select("fn", CF.strip_comments(F.col("code")).alias("code"))


@register("strip_comments_html", f"""
SELECT page_id, regexp_replace(html, '{COMMENT_SQL}', '\\1', 'g') AS html FROM pages""")
def q_strip_comments_html(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", CF.strip_comments(F.col("html")).alias("html"))


BRANCH_LIST = "[" + ", ".join(f"'{t}'" for t in CF.BRANCH_TOKENS) + "]"
CYC_SQL = (f"len(list_filter(regexp_extract_all(code, '\\w+|&&|\\|\\|'), "
           f"lambda t: list_contains({BRANCH_LIST}, t))) + 1")


@register("cyclomatic", V.with_views(f"SELECT fn, CAST({CYC_SQL} AS INTEGER) AS cyclomatic FROM fn_code",
                                     "fn_code"))
def q_cyclomatic(spark, d):
    f = V.fn_code(spark, d)
    return f.select("fn", CF.cyclomatic(F.col("code")).alias("cyclomatic"))


@register("loc", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS loc FROM documents")
def q_loc(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", CF.loc(F.col("text")).alias("loc"))


@register("long_functions", """
SELECT doc_id, loc FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS loc FROM documents) x
WHERE loc > 20""")
def q_long_functions(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", CF.loc(F.col("text")).alias("loc")).where(F.col("loc") > 20)


def _flags_sql(col: str) -> str:
    return ", ".join(
        f"CAST(regexp_matches(lower({col}), '{p}') AS INTEGER) AS flag_{n}" for n, p in CF.DANGER_PATTERNS)


@register("danger_flags", V.with_views(f"SELECT fn, line_no, {_flags_sql('code')} FROM code_lines",
                                       "code_lines"))
def q_danger_flags(spark, d):
    cl = V.code_lines(spark, d)
    return cl.select("fn", "line_no", *CF.danger_flags(F.col("code")))


@register("code_metrics", V.with_views(f"""
SELECT fn, CAST({CYC_SQL} AS INTEGER) AS cyclomatic, CAST(len(string_split(code, chr(10))) AS INTEGER) AS loc,
  {_flags_sql('code')} FROM fn_code""", "fn_code"))
def q_code_metrics(spark, d):
    return CM.code_metrics(V.fn_code(spark, d))


def _api_hits_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT fn, line_no, '{a}' AS api FROM code_lines WHERE regexp_matches(code, '\\b{a}\\s*\\(')"
        for a in CF.UNSAFE_APIS)
    return arms


VALID_SQL = " OR ".join(f"contains(context, '{k}')" for k in CF.VALIDATION_KEYWORDS)
APICTX_SQL = f"""
SELECT h.fn, h.line_no, h.api, c.context, ({VALID_SQL.replace('context', 'c.context')}) AS has_validation,
  CASE WHEN {VALID_SQL.replace('context', 'c.context')} THEN {CF.RISK_VALIDATED} ELSE {CF.RISK_UNVALIDATED} END AS risk
FROM ({_api_hits_sql()}) h
JOIN (SELECT a.fn, a.line_no, string_agg(b.code, chr(10) ORDER BY b.line_no) AS context
      FROM code_lines a JOIN code_lines b ON a.fn = b.fn AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 2
      GROUP BY a.fn, a.line_no) c ON c.fn = h.fn AND c.line_no = h.line_no"""


@register("api_context", V.with_views(
    f"SELECT fn, line_no, api, context, has_validation, CAST(risk AS DOUBLE) AS risk FROM ({APICTX_SQL}) x",
    "code_lines"))
def q_api_context(spark, d):
    return CM.api_context(V.code_lines(spark, d))


@register("api_risk", V.with_views(f"""
SELECT f.fn, coalesce(r.api_risk, 0.0) AS api_risk, CAST(coalesce(r.api_calls, 0) AS BIGINT) AS api_calls
FROM (SELECT DISTINCT fn FROM code_lines) f
LEFT JOIN (SELECT fn, avg(CAST(risk AS DOUBLE)) AS api_risk, count(*) AS api_calls FROM ({APICTX_SQL}) x GROUP BY fn) r
  ON r.fn = f.fn""", "code_lines"), rnd=("api_risk",))
def q_api_risk(spark, d):
    cl = V.code_lines(spark, d)
    return CM.api_risk(cl, cl.select("fn").distinct())


# --- naming -------------------------------------------------------------------

NAMES_SQL = """
SELECT DISTINCT name FROM (
  SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT n_name FROM nation
  UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT event_type FROM events
  UNION ALL SELECT unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) FROM code_lines) x"""


def _names(spark, d):
    cl = V.code_lines(spark, d)
    parts = [table(spark, d, "part").select(F.col("p_name").alias("name")),
             table(spark, d, "part").select(F.col("p_brand").alias("name")),
             table(spark, d, "nation").select(F.col("n_name").alias("name")),
             table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")),
             table(spark, d, "events").select(F.col("event_type").alias("name")),
             cl.select(F.explode(F.regexp_extract_all("code", F.lit(NF.IDENT_RE), 0)).alias("name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _nv(body: str) -> str:
    return V.with_views(body, "names", extra={"names": NAMES_SQL}, extra_deps={"names": ("code_lines",)})


def _conv_case(col: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({col}, '{rx}') THEN '{s}'" for s, rx in NF.NAMING_PATTERNS)
    return f"CASE {arms} ELSE 'unknown' END"


def _conv_list(col: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({col}, '{rx}') THEN '{s}' END" for s, rx in NF.NAMING_PATTERNS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


@register("naming_convention", _nv(f"SELECT name, {_conv_case('coalesce(name, %s)' % repr(''))} AS convention FROM names"))
def q_naming_convention(spark, d):
    return _names(spark, d).select("name", NF.naming_convention(F.col("name")).alias("convention"))


@register("naming_conventions", _nv(f"SELECT name, {_conv_list('coalesce(name, %s)' % repr(''))} AS conventions FROM names"))
def q_naming_conventions(spark, d):
    return _names(spark, d).select("name", NF.naming_conventions(F.col("name")).alias("conventions"))


BAD_LIST = "(" + ", ".join(f"'{n}'" for n in NF.BAD_NAMES) + ")"


@register("bad_name", _nv(f"SELECT name, name IN {BAD_LIST} AS is_bad FROM names"))
def q_bad_name(spark, d):
    return _names(spark, d).select("name", NF.bad_name(F.col("name")).alias("is_bad"))


PARTS_SQL = ("list_transform(list_filter(string_split(regexp_replace(coalesce(name, ''), '([A-Z])', '_\\1', 'g'), '_'), "
             "lambda p: length(p) > 1), lambda p: lower(p))")


@register("identifier_parts", _nv(f"SELECT name, {PARTS_SQL} AS parts FROM names"))
def q_identifier_parts(spark, d):
    return _names(spark, d).select("name", NF.identifier_parts(F.col("name")).alias("parts"))


@register("meaningful_name", _nv(f"""
SELECT name, len(list_filter({PARTS_SQL}, lambda p: regexp_matches(p, '^\\p{{L}}+$'))) > 0 AS meaningful FROM names"""))
def q_meaningful_name(spark, d):
    return _names(spark, d).select("name", NF.meaningful_name(F.col("name")).alias("meaningful"))


@register("meaningful_name_dictionary", _nv(f"""
SELECT name, coalesce(list_has_any({PARTS_SQL}, (SELECT list(DISTINCT lower(w)) FROM (
  SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT event_type FROM events))), false)
  AS meaningful FROM names"""))
def q_meaningful_name_dictionary(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")) \
        .unionByName(table(spark, d, "events").select(F.col("event_type").alias("word")))
    return NF.meaningful_in(_names(spark, d), words)


IDENTS_SQL = f"""
SELECT fn, CAST(coalesce(sum(strlen(piece)) OVER (PARTITION BY fn ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, piece
FROM (SELECT fn, unnest(pcs) AS piece, unnest(range(0, len(pcs))) AS i
      FROM (SELECT fn, regexp_extract_all(code, '{NF.PIECE_RE}') AS pcs FROM fn_code) a) b"""


@register("identifiers", V.with_views(f"""
SELECT fn, start, CAST(start + strlen(piece) AS BIGINT) AS "end", piece AS text FROM ({IDENTS_SQL}) x
WHERE regexp_matches(piece, '^{NF.IDENT_RE}$')""", "fn_code"))
def q_identifiers(spark, d):
    return CM.identifiers(V.fn_code(spark, d))


@register("identifier_report", V.with_views(f"""
SELECT fn, convention, count(*) AS n FROM (
  SELECT fn, unnest(CASE WHEN len(cv) = 0 THEN ['unknown'] ELSE cv END) AS convention
  FROM (SELECT fn, {_conv_list('piece')} AS cv FROM ({IDENTS_SQL}) x
        WHERE regexp_matches(piece, '^{NF.IDENT_RE}$')) y) z
GROUP BY fn, convention""", "fn_code"))
def q_identifier_report(spark, d):
    return CM.identifier_report(V.fn_code(spark, d))
