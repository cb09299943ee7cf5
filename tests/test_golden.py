"""Golden values from FIXTURES.md part B."""

import pytest
from pyspark.sql import functions as F

from cwescope.functions import naming as N
from cwescope.operators import codemetrics as CM
from cwescope.operators import graph as G
from cwescope.operators import metrics as M
from cwescope.operators import reach as R

# Naming: (name, first style) in reference rule order.
NAMING = [
    ("hello_world", "snake_case"), ("variable123Name", "camelCase"), ("HelloWorld", "PascalCase"),
    ("HELLO_WORLD", "SCREAMING_SNAKE"), ("hello-world", "kebab-case"), ("hello.world", "lower.dot.case"),
    ("MiXeD_cAsE", "unknown"), ("_invalid", "unknown"), ("invalid_", "unknown"), ("abc1", "unknown"),
    ("x2", "unknown"), ("", "unknown"), ("A", "PascalCase"), ("ABC", "PascalCase"), ("HELLO", "PascalCase"),
]


def test_naming_table(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMING], "name string")
    got = {r["name"]: r["c"] for r in df.select("name", N.naming_convention(F.col("name")).alias("c")).collect()}
    for name, want in NAMING:
        assert got[name] == want, name
    assert spark.createDataFrame([("hello",)], "name string").select(
        N.naming_conventions(F.col("name")).alias("s")).first()["s"] == ["snake_case", "kebab-case", "lower.dot.case"]


def test_identifier_parts_and_meaningful(spark):
    df = spark.createDataFrame([("getUserName",), ("HELLO_WORLD",), ("x",)], "name string")
    r = {x["name"]: (x["p"], x["m"]) for x in df.select(
        "name", N.identifier_parts(F.col("name")).alias("p"), N.meaningful_name(F.col("name")).alias("m")).collect()}
    assert r["getUserName"] == (["get", "user", "name"], True)
    assert r["HELLO_WORLD"] == ([], False)
    assert r["x"] == ([], False)


# Published per-class counts (CWE, TP, FP, FN) of the final run.
M1 = [("CWE-787", 875, 2419, 624), ("CWE-125", 489, 1110, 575), ("CWE-416", 473, 1931, 381),
      ("CWE-20", 301, 1378, 545), ("CWE-200", 218, 1501, 259), ("CWE-119", 704, 3632, 249),
      ("CWE-476", 224, 1034, 473), ("CWE-190", 140, 478, 271), ("CWE-400", 174, 584, 182)]


def test_metric_identities(spark):
    rows = []
    for c, (_, tp, fp, fn) in enumerate(M1):
        for y, yh, n in ((1, 1, tp), (0, 1, fp), (1, 0, fn)):
            rows.append((c, y, yh, n))
    base = spark.createDataFrame(rows, "cls long, y int, yhat int, n int")
    pred = base.select("cls", "y", "yhat", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")) \
        .select(F.monotonically_increasing_id().alias("sample_id"), "cls", "y", F.lit(0.5).alias("p"), "yhat")
    res = {r["average"]: r for r in M.prf_averaged(pred).collect()}
    assert res["macro"]["precision"] == pytest.approx(0.20786755878609336, abs=1e-4)
    assert res["macro"]["recall"] == pytest.approx(0.47772021680992793, abs=1e-4)
    assert res["macro"]["f1"] == pytest.approx(0.28217301574753284, abs=1e-4)
    assert res["micro"]["precision"] == pytest.approx(0.2037, abs=1e-4)
    assert res["micro"]["recall"] == pytest.approx(0.5027, abs=1e-4)
    assert res["micro"]["f1"] == pytest.approx(0.2899, abs=1e-4)


# Graph G1: id|parent|type|start|end|children
G1 = """0||translation_unit|0|74|1
1|0|function_definition|0|74|5
2|1|storage_class_specifier|0|6|1
3|2|static|0|6|0
4|1|storage_class_specifier|7|13|1
5|4|inline|7|13|0
6|1|primitive_type|14|17|0
7|1|function_declarator|18|35|2
8|7|identifier|18|28|0
9|7|parameter_list|28|35|3
10|9|(|28|29|0
11|9|parameter_declaration|29|34|2
12|11|primitive_type|29|32|0
13|11|identifier|33|34|0
14|9|)|34|35|0
15|1|compound_statement|36|74|3
16|15|{|36|37|0
17|15|return_statement|42|72|3
18|17|return|42|48|0
19|17|parenthesized_expression|49|71|3
20|19|(|49|50|0
21|19|binary_expression|50|70|3
22|21|binary_expression|50|58|3
23|22|identifier|50|51|0
24|22|>=|52|54|0
25|22|char_literal|55|58|3
26|25|'|55|56|0
27|25|character|56|57|0
28|25|'|57|58|0
29|21|&&|59|61|0
30|21|binary_expression|62|70|3
31|30|identifier|62|63|0
32|30|<=|64|66|0
33|30|char_literal|67|70|3
34|33|'|67|68|0
35|33|character|68|69|0
36|33|'|69|70|0
37|19|)|70|71|0
38|17|;|71|72|0
39|15|}|73|74|0"""


def test_graph_g1_edges(spark):
    rows = []
    for line in G1.splitlines():
        i, p, t, s, e, c = line.split("|")
        rows.append((1, int(i), int(p) if p else None, t, int(s), int(e), int(c), int(c) == 0))
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, parent long, node_type string, "
                                        "start_byte long, end_byte long, child_count int, is_leaf boolean")
    e = G.edge_union(nodes)
    counts = {r["edge_type"]: r["count"] for r in e.groupBy("edge_type").count().collect()}
    assert counts == {"ast": 39, "ast_reverse": 39, "next_token": 24}
    st = G.graph_global(nodes, e).first()
    assert st["num_nodes"] == 40 and st["num_edges"] == 102
    assert st["density"] == pytest.approx(0.0653846, abs=1e-6)
    assert st["edges_per_node"] == pytest.approx(2.55)


F1_CODE = """int copy_name(const char *from, int limit)
{
    char *to = malloc(limit);
    if (from && limit > 1) {
        strcpy(to, from);
    }
    puts(to);
    free(to);
    return 0;
}
"""


def test_function_f1(spark):
    texts = spark.createDataFrame([(1, F1_CODE)], "fn long, code string")
    lines = texts.select("fn", F.posexplode(F.split("code", "\n", -1)).alias("i", "code")) \
        .select("fn", (F.col("i") + 1).alias("line_no"), "code")
    ctx = CM.api_context(lines).orderBy("line_no").collect()
    # counted by hand: allocation, copy and release, one in five lines around each
    assert [(r["api"], r["line_no"], r["risk"]) for r in ctx] == [("malloc", 3, 0.2), ("strcpy", 5, 0.2),
                                                                  ("free", 8, 0.2)]
    m = CM.code_metrics(texts).first()
    assert m["cyclomatic"] == 3 and m["loc"] == 11  # if, &&; ten lines and the empty one at the end
    nodes = spark.createDataFrame([(1, 1, "char* buffer = malloc(100);"), (1, 2, "if (input != NULL)"),
                                   (1, 3, "strcpy(buffer, input);"), (1, 4, "free(buffer);"),
                                   (1, 5, 'printf("%s", buffer);')], "graph_id long, id long, code string")
    edges = spark.createDataFrame([(1, 1, 2, "Flow"), (1, 2, 3, "True"), (1, 2, 4, "False"),
                                   (1, 3, 4, "Flow"), (1, 4, 5, "Flow")],
                                  "graph_id long, src long, dst long, type string")
    vars_ = spark.createDataFrame([(1, "ptr"), (1, "buffer")], "graph_id long, var string")
    uaf = {r["var"]: (r["detected"], r["score"]) for r in R.reach_uaf(nodes, edges, vars_).collect()}
    assert uaf == {"ptr": (False, 0.0), "buffer": (True, 0.5)}
    taint = {r["var"]: r["taint"] for r in R.taint_source(nodes, vars_).collect()}
    assert taint["buffer"] == 0.0
