"""Derived inputs built from the driver tables.

The driver tables hold no source code, findings or predictions, so the
code-like inputs are derived from them deterministically. Each view has
a Spark builder (DataFrame API, planned by Catalyst) and the same
definition as portable SQL (``VIEW_SQL``) that the DuckDB oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cwescope.sources.tables import table

NUM_PRED_CLASSES = 9


#: Lines of code in a partition of graph work: what a task sorts stays in memory.
LINES_PER_PART = 25_000
#: The same for labels, of which a line makes five at most.
LABEL_LINES_PER_PART = 50_000


def graph_parts(spark: SparkSession, d: str, lines: int | None = None) -> int:
    """Partitions of graph work, in proportion to the input (the count is read
    from the file footers)."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table(spark, d, "lineitem").count() // (lines or LINES_PER_PART)))


def code_lines(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """``code_lines(fn, line_no, k, v, code)``: one C-like line per lineitem.
    ``parts``: into so many partitions by function."""
    # The SQL form orders by more columns. Lines that agree in these three agree
    # in k and v, so their order shows nowhere and the rest need not be shuffled.
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, d, "lineitem").select("l_orderkey", *order)
    if parts:
        li = li.repartition(parts, "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    # Rename after the window: the window's partitioning on l_orderkey then
    # carries over to ``fn`` and per-function aggregates need no new shuffle.
    t = li.select(
        "l_orderkey",
        F.row_number().over(w).cast("bigint").alias("line_no"),
        (F.col("l_partkey") % 10).alias("k"),
        F.concat(F.lit("v"), (F.col("l_suppkey") % 2).cast("string")).alias("v"),
    ).withColumnRenamed("l_orderkey", "fn")
    k, v = F.col("k"), F.col("v")
    code = (
        F.when(k == 0, F.concat(F.lit("char *"), v, F.lit(" = malloc(16);")))
        .when(k == 1, F.concat(F.lit("strcpy("), v, F.lit(", src);")))
        .when(k == 2, F.concat(F.lit("if ("), v, F.lit(" != NULL) {")))
        .when(k == 3, F.concat(F.lit("free("), v, F.lit(");")))
        .when(k == 4, F.concat(F.lit('printf("%s", '), v, F.lit(");")))
        .when(k == 5, F.lit("}"))
        .when(k == 6, F.lit("/* note */ int userCount = 1;"))
        .when(k == 7, F.concat(v, F.lit(" = gets(buf);")))
        .when(k == 8, F.concat(F.lit("while ("), v, F.lit(" && next_item) { // loop")))
        .otherwise(F.concat(F.lit("x = MAX_LEN || "), v, F.lit(";")))
    )
    return t.select("fn", "line_no", "k", "v", code.alias("code"))


def join_lines(lines: DataFrame, key: str = "fn", pos: str = "line_no",
               text: str = "code") -> DataFrame:
    """Whole text per key: lines joined by newline in position order.

    A function's lines form one group; groups are functions, bounded by
    function length, never the whole corpus.
    """
    return lines.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(pos, text))),
                        lambda s: s[text]),
            "\n").alias(text))


def fn_code(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """``fn_code(fn, code)``: whole function text from ``code_lines``."""
    return join_lines(code_lines(spark, d, parts))


def cfg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return code_lines(spark, d).select(
        F.col("fn").alias("graph_id"), F.col("line_no").alias("id"), "code")


def cfg_edges(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Flow edges, skip edge after ``if``, back edge for ``while``.

    The SQL form self-joins ``code_lines`` on line_no+1 / +2; since line
    numbers are dense per function, ``lead`` over the function gives the
    same pairs without a join and reuses the window's partitioning.
    """
    cl = lines if lines is not None else code_lines(spark, d)
    w = Window.partitionBy("fn").orderBy("line_no")
    t = cl.select("fn", "line_no", "k",
                  F.lead("line_no", 1).over(w).alias("n1"),
                  F.lead("line_no", 2).over(w).alias("n2"))
    rows = F.array(
        F.when(t.n1.isNotNull(), F.struct(t.line_no.alias("src"), t.n1.alias("dst"),
                                          F.lit("Flow").alias("type"))),
        F.when(t.n2.isNotNull() & (t.k == 2),
               F.struct(t.line_no.alias("src"), t.n2.alias("dst"), F.lit("False").alias("type"))),
        F.when(t.n2.isNotNull() & (t.k == 8),
               F.struct(t.n2.alias("src"), t.line_no.alias("dst"), F.lit("Back").alias("type"))),
    )
    return (t.select(F.col("fn").alias("graph_id"), F.explode(rows).alias("e"))
            .where(F.col("e").isNotNull())
            .select("graph_id", "e.src", "e.dst", "e.type"))


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Dense N x 9 prediction table ``pred(sample_id, cls, y, p, yhat)``.

    One aggregation on ``l_orderkey`` computes the 9 truth flags of a sample
    (map-side partial aggregation), then a generator emits the 9 class rows;
    the class set is semi-joined with the distinct classes present (at most
    9 rows, so the broadcast is bounded).
    """
    li = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % NUM_PRED_CLASSES).alias("c"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("r"))
    flags = li.groupBy("l_orderkey").agg(*[
        F.max(F.when(F.col("c") == i, F.col("r"))).alias(f"y{i}")
        for i in range(NUM_PRED_CLASSES)])
    ys = F.array(*[F.struct(F.lit(i).cast("bigint").alias("cls"),
                            F.coalesce(F.col(f"y{i}"), F.lit(0)).alias("y"))
                   for i in range(NUM_PRED_CLASSES)])
    rows = flags.select(F.col("l_orderkey").alias("sample_id"), F.explode(ys).alias("t")) \
        .select("sample_id", "t.cls", "t.y")
    present = li.select(F.col("c").alias("cls")).distinct()
    rows = rows.join(F.broadcast(present), "cls", "left_semi")
    score = F.least((F.col("sample_id") * 37 + F.col("cls") * 211) % 700 + 300 * F.col("y"),
                    F.lit(999))
    return rows.select(
        "sample_id", "cls", "y",
        (score.cast("double") / 1000).alias("p"),
        F.when(score >= 500, 1).otherwise(0).alias("yhat"))


def tool_labels(spark: SparkSession, d: str) -> DataFrame:
    """Truth and four tools in long form ``(sample_id, tool, cwe)``.

    One scan of lineitem emits every (tool, cwe) a line contributes; one
    distinct replaces the five distinct subqueries of the SQL form. The lines
    are dealt by sample into parts that grow with the input, so what is distinct,
    joined or grouped by sample later stays in its part, and no task grows. A
    line is dealt as three numbers, and only if a tool reports it.
    """
    li = table(spark, d, "lineitem")
    r = F.col("l_returnflag") == "R"
    said = {
        "truth": r,
        "tool_a": r & (F.col("l_discount") >= 0.05),
        "tool_b": (F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.04),
        "tool_c": F.col("l_quantity") > 45,
        "model": F.col("l_returnflag").isin("R", "A"),
    }
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(said.values())), F.lit(0))
    # 36 is a multiple of both moduli
    li = li.select("l_orderkey", (F.col("l_partkey") % 36).alias("c"), bits.alias("said")).where("said > 0")
    li = li.repartition(graph_parts(spark, d, LABEL_LINES_PER_PART), "l_orderkey")

    def item(i, tool):
        cwe = F.concat(F.lit("CWE-"), (F.col("c") % (12 if tool == "tool_b" else 9)).cast("string"))
        return F.when(F.col("said").bitwiseAND(1 << i) > 0, F.struct(F.lit(tool).alias("tool"), cwe.alias("cwe")))

    rows = F.array(*[item(i, tool) for i, tool in enumerate(said)])
    return (li.select(F.col("l_orderkey").alias("sample_id"), F.explode(rows).alias("t"))
            .where(F.col("t").isNotNull())
            .select("sample_id", "t.tool", "t.cwe")
            .distinct())


def user_days(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"),
                 F.to_date("ts").cast("string")).alias("id"),
        F.col("event_type").alias("label")).distinct()


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` ⨝ ``labels`` as a labelled function corpus.

    ``cwe`` is the list of positive label names, null when unlabelled
    (null, empty and non-empty lists behave differently downstream).
    """
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    cwe = F.when(F.col("quality").isNull() & F.col("toxic").isNull(),
                 F.lit(None).cast("array<string>")).otherwise(
        F.filter(F.array(F.when(F.col("quality") == 1, F.lit("quality")),
                         F.when(F.col("toxic") == 1, F.lit("toxic"))),
                 lambda x: x.isNotNull()))
    return j.select(
        F.col("doc_id").alias("id"), F.col("text").alias("code"),
        F.col("source").alias("project"), "lang", F.col("n_chars").alias("size"),
        cwe.alias("cwe"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("CVE-"), F.col("lang"), F.lit("-"), F.col("source")))
        .otherwise(F.lit("")).alias("cve_id"),
        F.concat(F.lit("https://github.com/"), F.col("source"), F.lit("/"), F.col("lang"),
                 F.lit("/commit/"), F.md5(F.col("doc_id").cast("string"))).alias("commit_url"))


# ---------------------------------------------------------------------------
# The same views as portable SQL for the DuckDB oracle.

VIEW_SQL: dict[str, str] = {
    "code_lines": """
SELECT fn, line_no, k, v,
  CASE k WHEN 0 THEN concat('char *', v, ' = malloc(16);')
         WHEN 1 THEN concat('strcpy(', v, ', src);')
         WHEN 2 THEN concat('if (', v, ' != NULL) {')
         WHEN 3 THEN concat('free(', v, ');')
         WHEN 4 THEN concat('printf("%s", ', v, ');')
         WHEN 5 THEN '}'
         WHEN 6 THEN '/* note */ int userCount = 1;'
         WHEN 7 THEN concat(v, ' = gets(buf);')
         WHEN 8 THEN concat('while (', v, ' && next_item) { // loop')
         ELSE concat('x = MAX_LEN || ', v, ';') END AS code
FROM (SELECT l_orderkey AS fn, l_partkey % 10 AS k, concat('v', CAST(l_suppkey % 2 AS VARCHAR(2))) AS v,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
          l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS line_no
      FROM lineitem) t""",
    "fn_code": """
SELECT fn, string_agg(code, chr(10) ORDER BY line_no) AS code FROM code_lines GROUP BY fn""",
    "cfg_nodes": """
SELECT fn AS graph_id, line_no AS id, code FROM code_lines""",
    "cfg_edges": """
SELECT a.fn AS graph_id, a.line_no AS src, b.line_no AS dst, 'Flow' AS type
FROM code_lines a JOIN code_lines b ON a.fn = b.fn AND b.line_no = a.line_no + 1
UNION ALL
SELECT a.fn, a.line_no, b.line_no, 'False' FROM code_lines a JOIN code_lines b ON a.fn = b.fn AND b.line_no = a.line_no + 2 WHERE a.k = 2
UNION ALL
SELECT a.fn, b.line_no, a.line_no, 'Back' FROM code_lines a JOIN code_lines b ON a.fn = b.fn AND b.line_no = a.line_no + 2 WHERE a.k = 8""",
    "pred": """
SELECT s.sample_id, c.cls, coalesce(r.y, 0) AS y,
  CAST(least((s.sample_id * 37 + c.cls * 211) % 700 + 300 * coalesce(r.y, 0), 999) AS DOUBLE) / 1000 AS p,
  CASE WHEN least((s.sample_id * 37 + c.cls * 211) % 700 + 300 * coalesce(r.y, 0), 999) >= 500 THEN 1 ELSE 0 END AS yhat
FROM (SELECT DISTINCT l_orderkey AS sample_id FROM lineitem) s
CROSS JOIN (SELECT DISTINCT l_partkey % 9 AS cls FROM lineitem) c
LEFT JOIN (SELECT l_orderkey AS sample_id, l_partkey % 9 AS cls, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
           FROM lineitem GROUP BY l_orderkey, l_partkey % 9) r
  ON r.sample_id = s.sample_id AND r.cls = c.cls""",
    "tool_labels": """
SELECT DISTINCT l_orderkey AS sample_id, 'truth' AS tool, concat('CWE-', CAST(l_partkey % 9 AS VARCHAR(4))) AS cwe FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT DISTINCT l_orderkey, 'tool_a', concat('CWE-', CAST(l_partkey % 9 AS VARCHAR(4))) FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05
UNION ALL
SELECT DISTINCT l_orderkey, 'tool_b', concat('CWE-', CAST(l_partkey % 12 AS VARCHAR(4))) FROM lineitem WHERE l_linestatus = 'O' AND l_tax >= 0.04
UNION ALL
SELECT DISTINCT l_orderkey, 'tool_c', concat('CWE-', CAST(l_partkey % 9 AS VARCHAR(4))) FROM lineitem WHERE l_quantity > 45
UNION ALL
SELECT DISTINCT l_orderkey, 'model', concat('CWE-', CAST(l_partkey % 9 AS VARCHAR(4))) FROM lineitem WHERE l_returnflag IN ('R', 'A')""",
    "user_days": """
SELECT DISTINCT concat(CAST(user_id AS VARCHAR(20)), '_', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS id, event_type AS label FROM events""",
    "corpus": """
SELECT d.doc_id AS id, d.text AS code, d.source AS project, d.lang AS lang, d.n_chars AS size,
  CASE WHEN l.quality IS NULL AND l.toxic IS NULL THEN NULL
       ELSE list_filter([CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END],
                        lambda x: x IS NOT NULL) END AS cwe,
  CASE WHEN l.toxic = 1 THEN concat('CVE-', d.lang, '-', d.source) ELSE '' END AS cve_id,
  concat('https://github.com/', d.source, '/', d.lang, '/commit/', md5(CAST(d.doc_id AS VARCHAR))) AS commit_url
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "fn_code": ("code_lines",),
    "cfg_nodes": ("code_lines",),
    "cfg_edges": ("code_lines",),
}


#: Oracle views that several others read; they are computed once.
SHARED = ("gp", "gt", "gn0", "gn1", "gn2", "tn", "ge")


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None,
               extra_deps: dict[str, tuple[str, ...]] | None = None) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views (deps first)."""
    defs = dict(VIEW_SQL)
    deps = dict(VIEW_DEPS)
    if extra:
        defs.update(extra)
    if extra_deps:
        deps.update(extra_deps)
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in deps.get(n, ()):
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({defs[n].strip()})" for n in order)
    return f"WITH {ctes}\n{sql.strip()}"
