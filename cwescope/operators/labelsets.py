"""Label-set operators: findings of several tools against a truth set.

Input is the long table ``labels(sample_id, tool, cwe)`` (one row per label
a tool reports for a sample, truth included) and the sample universe
``samples(sample_id)``. Samples without any label still count (safe and
predicted safe), so the universe size enters every ratio.

Plan shape: labels are semi-joined with the universe part by part (it grows
with the input, and is larger than its compressed file lets expect: never
broadcast); the (sample, cwe) presence
aggregate subsumes a distinct of the input (max is duplicate-insensitive,
so Catalyst drops a distinct below it); per-sample and per-class results
aggregate map-side first, and the per-tool / per-class outputs are bounded
by #tools x #classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cwescope.operators.metrics import fbeta_from_counts, safe_div

TRUTH = "truth"
TOOLS = ("tool_a", "tool_b", "tool_c", "model")


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(1))


def restrict(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Labels of samples in the universe (findings for unknown ids are dropped)."""
    return labels.join(samples.select("sample_id").hint("shuffle_hash"), "sample_id", "left_semi")


def presence(labels: DataFrame, tools=TOOLS, truth: str = TRUTH) -> DataFrame:
    """(sample_id, cwe, tool, t, p): one row per tool for every (sample, cwe)
    that truth or any of ``tools`` reports; t / p are 0/1 membership flags.
    Findings of other tools neither score nor widen the class universe
    (``unknown_tools`` lists them)."""
    g = labels.where(F.col("tool").isin(truth, *tools)).groupBy("sample_id", "cwe").agg(
        F.max((F.col("tool") == truth).cast("int")).alias("t"),
        *[F.max((F.col("tool") == x).cast("int")).alias(f"p_{i}") for i, x in enumerate(tools)])
    per_tool = F.array(*[F.struct(F.lit(x).alias("tool"), F.col(f"p_{i}").alias("p"))
                         for i, x in enumerate(tools)])
    return g.select("sample_id", "cwe", "t", F.explode(per_tool).alias("x")) \
        .select("sample_id", "cwe", "x.tool", "t", "x.p")


def unknown_tools(labels: DataFrame, tools=TOOLS, truth: str = TRUTH) -> DataFrame:
    """(tool, findings) of tools that no comparison takes in."""
    return (labels.where(~F.col("tool").isin(truth, *tools)).groupBy("tool")
            .agg(F.count(F.lit(1)).alias("findings")))


def per_sample(pres: DataFrame) -> DataFrame:
    """(tool, sample_id, inter, uni, nt, np) over present samples."""
    t, p = F.col("t"), F.col("p")
    return pres.groupBy("tool", "sample_id").agg(
        F.sum(t * p).alias("inter"), F.sum(F.greatest(t, p)).alias("uni"),
        F.sum(t).alias("nt"), F.sum(p).alias("np"))


def per_class(pres: DataFrame) -> DataFrame:
    """(tool, cwe, tp, fp, fn, support) for every class in the label universe."""
    t, p = F.col("t"), F.col("p")
    return pres.groupBy("tool", "cwe").agg(
        F.sum(t * p).cast("bigint").alias("tp"), F.sum((1 - t) * p).cast("bigint").alias("fp"),
        F.sum(t * (1 - p)).cast("bigint").alias("fn"), F.sum(t).cast("bigint").alias("support"))


def universe_size(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("n_samples"))


def _sample_level(ps: DataFrame) -> DataFrame:
    i, u, nt, np_ = F.col("inter"), F.col("uni"), F.col("nt"), F.col("np")
    return ps.groupBy("tool").agg(
        F.count_if((nt > 0) & (np_ > 0)).alias("btp"),
        F.count_if((nt == 0) & (np_ > 0)).alias("bfp"),
        F.count_if((nt > 0) & (np_ == 0)).alias("bfn"),
        F.count_if((i != nt) | (i != np_)).alias("mismatch"),
        F.sum(safe_div(i, u)).alias("jac_sum"),
        F.count_if(i > 0).alias("partial"),
    )


def _class_level(pc: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    known = F.col("support") > 0
    f1 = fbeta_from_counts(tp, fp, fn)
    return pc.groupBy("tool").agg(
        F.sum(tp).alias("stp"), F.sum(fp).alias("sfp"), F.sum(fn).alias("sfn"),
        F.avg(f1).alias("f1_macro"),
        F.sum(F.when(known, tp)).alias("ktp"), F.sum(F.when(known, fp)).alias("kfp"),
        F.sum(F.when(known, fn)).alias("kfn"),
        F.avg(F.when(known, f1)).alias("f1_macro_known"),
    )


def binary_cols(n: Column) -> list[Column]:
    btp, bfp, bfn = F.col("btp"), F.col("bfp"), F.col("bfn")
    return [
        safe_div(n - bfp - bfn, n).alias("accuracy"),
        safe_div(btp, btp + bfp).alias("precision"),
        safe_div(btp, btp + bfn).alias("recall"),
        fbeta_from_counts(btp, bfp, bfn).alias("f1"),
    ]


def compare_tools(labels: DataFrame, samples: DataFrame, tools=TOOLS,
                  truth: str = TRUTH) -> DataFrame:
    """Full comparison: one row per tool with the binary table (safe vs
    vulnerable: accuracy, precision, recall, F1), the multi-label table over
    the universe of all labels (Jaccard, F1 micro/macro, exact match,
    partial match) and F1 micro/macro over the truth classes only."""
    pres = presence(restrict(labels, samples), tools, truth)
    sl = _sample_level(per_sample(pres))
    cl = _class_level(per_class(pres))
    n = universe_size(samples)
    # presence() emits a row for every tool, so both sides hold every tool.
    j = _one(sl.join(cl, "tool", "full")).join(F.broadcast(_one(n)), "_k")
    nn = F.col("n_samples")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    stp, sfp, sfn = z("stp"), z("sfp"), z("sfn")
    return j.select(
        "tool", nn.alias("n_samples"),
        *binary_cols(nn),
        safe_div(z("jac_sum"), nn).alias("jaccard"),
        fbeta_from_counts(stp, sfp, sfn).alias("f1_micro"),
        F.coalesce(F.col("f1_macro"), F.lit(0.0)).alias("f1_macro"),
        safe_div(nn - z("mismatch"), nn).alias("exact_match"),
        safe_div(z("partial"), nn).alias("partial_match"),
        fbeta_from_counts(z("ktp"), z("kfp"), z("kfn")).alias("f1_micro_known"),
        F.coalesce(F.col("f1_macro_known"), F.lit(0.0)).alias("f1_macro_known"),
    )


def binary_confusion(labels: DataFrame, samples: DataFrame, tools=TOOLS,
                     truth: str = TRUTH) -> DataFrame:
    """2x2 safe/vulnerable counts per tool, the grid completed with zeros."""
    pres = presence(restrict(labels, samples), tools, truth)
    sl = _sample_level(per_sample(pres))
    n = universe_size(samples)
    j = _one(sl).join(F.broadcast(_one(n)), "_k")
    nn = F.col("n_samples")
    cells = F.array(
        F.struct(F.lit(0).alias("y"), F.lit(0).alias("yhat"),
                 (nn - F.col("btp") - F.col("bfp") - F.col("bfn")).alias("n")),
        F.struct(F.lit(0).alias("y"), F.lit(1).alias("yhat"), F.col("bfp").alias("n")),
        F.struct(F.lit(1).alias("y"), F.lit(0).alias("yhat"), F.col("bfn").alias("n")),
        F.struct(F.lit(1).alias("y"), F.lit(1).alias("yhat"), F.col("btp").alias("n")),
    )
    return j.select("tool", F.explode(cells).alias("c")).select("tool", "c.y", "c.yhat", "c.n")


def label_universe(labels: DataFrame) -> DataFrame:
    """All labels of truth and tools, distinct (sorted on output by the caller)."""
    return labels.select("cwe").distinct()


def merge_findings(labels: DataFrame, tools=TOOLS, truth: str = TRUTH) -> DataFrame:
    """Per sample: sorted distinct label list per tool, pivoted to one column
    per tool (fixed tool list, so the pivot needs no extra pass)."""
    names = (truth, *tools)
    return (labels.groupBy("sample_id")
            .pivot("tool", list(names))
            .agg(F.array_sort(F.collect_set("cwe")))
            .select("sample_id", *[F.coalesce(F.col(x), F.array().cast("array<string>")).alias(x)
                                   for x in names]))


def top_classes(labels: DataFrame, k: int = 10, truth: str = TRUTH) -> DataFrame:
    """The k most frequent true labels (count desc, name asc breaks ties)."""
    c = labels.where(F.col("tool") == truth).groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "cwe").limit(k)


def recall_by_class_tool(labels: DataFrame, samples: DataFrame, k: int = 10,
                         tools=TOOLS, truth: str = TRUTH) -> DataFrame:
    """Recall per (true class, tool) for the k most frequent true classes."""
    top = top_classes(labels, k, truth).select("cwe")
    pres = presence(restrict(labels, samples), tools, truth)
    pc = per_class(pres).join(F.broadcast(top), "cwe", "left_semi")
    return pc.select("cwe", "tool", safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def fpr_coverage(labels: DataFrame, samples: DataFrame, tools=TOOLS,
                 truth: str = TRUTH) -> DataFrame:
    """Per tool: false-positive rate among safe samples and share of
    vulnerable samples detected."""
    pres = presence(restrict(labels, samples), tools, truth)
    sl = _sample_level(per_sample(pres))
    nt = restrict(labels, samples).where(F.col("tool") == truth) \
        .agg(F.count_distinct("sample_id").alias("n_vuln"))
    n = universe_size(samples)
    j = _one(sl).join(F.broadcast(_one(n)), "_k").join(F.broadcast(_one(nt)), "_k")
    neg = F.col("n_samples") - F.col("n_vuln")
    return j.select("tool", safe_div(F.col("bfp"), neg).alias("fpr"),
                    safe_div(F.col("btp"), F.col("n_vuln")).alias("coverage"))


def report_long(wide: DataFrame, id_col: str = "tool") -> DataFrame:
    """Wide metric table -> (tool, metric, score)."""
    vals = [c for c in wide.columns if c != id_col]
    return wide.unpivot(id_col, vals, "metric", "score")


def ensure_list(c: Column) -> Column:
    """string -> [string], '' -> [], null -> []; arrays pass through."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))


def label_overlap(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))
