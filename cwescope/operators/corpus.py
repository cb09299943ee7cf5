"""Corpus operators: filters, statistics, profiles, samples and splits.

Input is a function corpus ``(id, code, project, cwe array<string>, ...)``
where a null / empty / non-empty ``cwe`` list are three different cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.session import materialize
from cwescope.functions.labels import multi_hot



def empty_list() -> Column:
    return F.array().cast("array<string>")


def is_vulnerable(cwe: Column) -> Column:
    return F.size(F.coalesce(cwe, empty_list())) > 0


def label_filter(df: DataFrame, allow: list[str]) -> DataFrame:
    """Drop a row only if its CWE list is non-empty and disjoint from ``allow``."""
    allowed = F.array(*[F.lit(x) for x in allow])
    return df.where(~is_vulnerable(F.col("cwe")) | F.arrays_overlap(F.col("cwe"), allowed))


def filter_target(df: DataFrame, target: int = 1) -> DataFrame:
    return df.where(is_vulnerable(F.col("cwe")).cast("int") == target)


def filter_cwe(df: DataFrame, cwes: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap(F.col("cwe"), F.array(*[F.lit(x) for x in cwes])))


def filter_project(df: DataFrame, projects: list[str]) -> DataFrame:
    return df.where(F.col("project").isin(projects))


def corpus_stats(df: DataFrame) -> DataFrame:
    """One row: totals, ratio (0 when empty), distinct CVE ids and projects
    (empty strings dropped). The distinct lists themselves are unbounded and
    are returned as rows by ``distinct_values`` instead of one array."""
    vul = is_vulnerable(F.col("cwe"))
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(vul).alias("vulnerable_samples"),
        F.count_if(~vul).alias("non_vulnerable_samples"),
        F.coalesce(F.try_divide(F.count_if(vul), F.count(F.lit(1))), F.lit(0.0))
        .alias("vulnerability_ratio"),
        F.count_distinct(F.nullif(F.col("cve_id"), F.lit(""))).alias("unique_cve_ids"),
        F.count_distinct(F.nullif(F.col("project"), F.lit(""))).alias("unique_projects"),
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("value")).where(F.col("value") != "").distinct()


def project_profile(df: DataFrame) -> DataFrame:
    """Per project: samples, vulnerable samples, sorted CWE set, repo url of
    the last row (highest id). A null CWE list counts as empty."""
    base = df.groupBy("project").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(is_vulnerable(F.col("cwe"))).alias("vuln_samples"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("cwe", empty_list())))))
        .alias("cwes"),
        F.max_by("commit_url", "id").alias("repo_url"),
    )
    return base


def top_projects(df: DataFrame, k: int = 3) -> DataFrame:
    """The k largest projects by sample count (name breaks ties)."""
    c = df.groupBy("project").agg(F.count(F.lit(1)).alias("samples"))
    return c.orderBy(F.desc("samples"), "project").limit(k)


def export_ml(df: DataFrame) -> DataFrame:
    """Columnar export: function text, target, CWE list, project, size."""
    return df.select("id", F.col("code").alias("func"),
                     is_vulnerable(F.col("cwe")).cast("int").alias("target"),
                     F.coalesce("cwe", empty_list()).alias("cwes"), "project", "size")


def with_multi_hot(df: DataFrame, labels: str, classes: list[str]) -> DataFrame:
    return df.withColumn("vec", multi_hot(F.col(labels), classes))


def class_distribution(vecs: DataFrame, names: DataFrame) -> DataFrame:
    """Per class: count of samples with the label, percent, positive weight.

    ``vecs(id, vec)``; rows with a null vector are dropped; ``names(idx, name)``
    is class-sized (broadcast); a missing name becomes ``Idx_i``."""
    v = vecs.where(F.col("vec").isNotNull())
    n = v.agg(F.count(F.lit(1)).alias("n"))
    per = v.select(F.posexplode("vec").alias("idx", "x")).groupBy("idx") \
        .agg(F.sum("x").cast("bigint").alias("count"))
    j = per.withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k")
    j = j.join(F.broadcast(names), "idx", "left")
    return j.select(
        "idx", F.coalesce("name", F.concat(F.lit("Idx_"), F.col("idx").cast("string"))).alias("name"),
        "count",
        F.round(F.col("count") / F.col("n") * 100, 4).alias("percent"),
        F.round((F.col("n") - F.col("count")) / (F.col("count") + 1e-6), 2).alias("pos_weight"))


def label_density(vecs: DataFrame) -> DataFrame:
    """Histogram of labels per sample with percent (2 decimals)."""
    v = vecs.where(F.col("vec").isNotNull()).select(
        F.aggregate("vec", F.lit(0), lambda a, x: a + x).alias("n_labels"))
    h = v.groupBy("n_labels").agg(F.count(F.lit(1)).alias("samples"))
    tot = h.agg(F.sum("samples").alias("tot")).withColumn("_k", F.lit(1))
    return h.withColumn("_k", F.lit(1)).join(F.broadcast(tot), "_k").select(
        "n_labels", "samples", F.round(F.col("samples") / F.col("tot") * 100, 2).alias("percent"))


def hash32(c: Column) -> Column:
    """First 32 bits of md5 as a non-negative bigint (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def shuffle_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Repeatable 'shuffle then keep a fraction': keep rows whose md5-based
    hash is below fraction * 2^32. A per-row predicate: no shuffle at all."""
    limit = int(fraction * (1 << 32))
    return df.where(hash32(F.col(key)) < F.lit(limit))


RANK_BUCKET_SHIFT = 20  # 2^32 / 2^20 = 4096 buckets per group


def rank_in_group(df: DataFrame, group: str, order: Column, tie: str) -> DataFrame:
    """Exact 1-based rank of each row inside ``group`` by (order, tie).

    Two levels so that a hot group (a third of all rows) is not ranked in one
    task: bucket counts per (group, bucket) are a small table whose window
    gives each bucket's offset; rows are ranked inside (group, bucket).
    ``order`` must be a non-negative 32-bit hash-like value.
    """
    t = df.withColumn("_o", order).withColumn("_b", F.shiftright(F.col("_o"), RANK_BUCKET_SHIFT))
    bc = t.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(group).orderBy("_b")
    bc = bc.select(group, "_b",
                   (F.sum("_bn").over(wb.rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
                   F.sum("_bn").over(Window.partitionBy(group)).alias("_n"))
    bc = bc.fillna(0, subset=["_off"])
    wi = Window.partitionBy(group, "_b").orderBy("_o", tie)
    return (t.join(bc, [group, "_b"])
            .withColumn("_rank", F.col("_off") + F.row_number().over(wi))
            .drop("_o", "_b", "_off"))


def split_stratified(df: DataFrame, id_col: str, combo: str,
                     train: int = 70, val: int = 15) -> DataFrame:
    """Stratified 70/15/15 split by label combination.

    Within each combination rows are ordered by md5(id); a per-combination
    phase from md5(combo) rotates the order so single-row combinations do
    not all land in train. Position p of n goes to train if 100p < 70n, to
    val if 100p < 85n, else test. Disjoint and complete by construction."""
    r = rank_in_group(df, combo, hash32(F.col(id_col)), id_col)
    ph = F.pmod(hash32(F.col(combo)), F.col("_n"))
    pos = F.pmod(F.col("_rank") - 1 + ph, F.col("_n"))
    split = (F.when(pos * 100 < F.col("_n") * train, "train")
             .when(pos * 100 < F.col("_n") * (train + val), "val").otherwise("test"))
    return r.withColumn("split", split).drop("_rank", "_n")


def global_index(df: DataFrame, order_cols: list[str], partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order without a
    single-partition window.

    Only the keys are range-partitioned, and their partition numbers are
    stored before they are used twice: for the counts per partition
    (#partitions rows, broadcast) and for the row number inside. The position
    is then joined back on the keys, so it does not depend on what other
    columns the table has. Rows with equal keys take consecutive positions."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_key{i}" for i in range(len(order_cols))]
    among = Window.partitionBy(*keys).orderBy(*keys)
    r = materialize(df.select(*[F.col(c).alias(k) for c, k in zip(order_cols, keys)])
                    .repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    cnt = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.select("_pid", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*keys)
    pos = (r.join(F.broadcast(off), "_pid")
           .withColumn("_idx", F.col("_off") + F.row_number().over(w) - 1)
           .withColumn("_tie", F.row_number().over(among)).drop("_pid", "_off"))
    own = Window.partitionBy(*order_cols).orderBy(*order_cols)
    rows = df.withColumn("_own", F.row_number().over(own))
    same = F.col("_own") == F.col("_tie")
    for c, k in zip(order_cols, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return rows.join(pos, same).drop("_own", "_tie", *keys)


def split_sequential(df: DataFrame, order_cols: list[str], train: float = 0.7,
                     val: float = 0.15) -> DataFrame:
    """First int(n*0.7) rows train, next int(n*0.15) val, the rest test."""
    idx = global_index(df, order_cols)
    n = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    j = idx.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    ntr = F.floor(F.col("_n") * train)
    nva = F.floor(F.col("_n") * val)
    split = (F.when(F.col("_idx") < ntr, "train")
             .when(F.col("_idx") < ntr + nva, "val").otherwise("test"))
    return j.withColumn("split", split).drop("_k", "_n", "_idx")


def split_shuffled(df: DataFrame, id_col: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Sequential split after a repeatable shuffle (md5 order, id breaks ties)."""
    t = df.withColumn("_h", hash32(F.col(id_col)))
    return split_sequential(t, ["_h", id_col], train, val).drop("_h")
