"""Small dimension tables: the label space and per-class thresholds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cwescope.operators.metrics import DEFAULT_THRESHOLD

# The 9-class label space (index, name, cwe_id, cves_in_kev,
# rank_last_year, trend, label, label_id), in index order.
LABEL_DIM_ROWS = [
    (0, "Out-of-bounds Write", "CWE-787", 18, 1, "downward", "Memory Corruption", 1),
    (1, "Out-of-bounds Read", "CWE-125", 3, 7, "upward", "Memory Corruption", 1),
    (2, "Use After Free", "CWE-416", 5, 4, "downward", "Memory Corruption", 1),
    (3, "Improper Input Validation", "CWE-20", 1, 6, "downward", "Input Validation", 4),
    (4, "Exposure of Sensitive Information to an Unauthorized Actor", "CWE-200", 0, 30,
     "upward", "Information Disclosure", 7),
    (5, "Improper Restriction of Operations within the Bounds of a Memory Buffer", "CWE-119",
     2, 17, "downward", "Memory Corruption", 1),
    (6, "NULL Pointer Dereference", "CWE-476", 0, 12, "downward", "Memory Corruption", 1),
    (7, "Integer Overflow or Wraparound", "CWE-190", 3, 14, "downward", "Memory Corruption", 1),
    (8, "Uncontrolled Resource Consumption", "CWE-400", 0, 37, "upward", "Resource Management", 8),
]
LABEL_DIM_SCHEMA = ("idx int, name string, cwe_id string, cves_in_kev int, rank_last_year int, "
                    "trend string, label string, label_id int")

# The label space of the ``user_days`` view (event types);
# ``signup`` is left out on purpose and plays the unknown label.
EVENT_CLASSES = ["click", "view", "purchase", "error"]


def label_dim(spark: SparkSession) -> DataFrame:
    """9-row label dimension (always broadcast: its size is fixed)."""
    return spark.createDataFrame(LABEL_DIM_ROWS, LABEL_DIM_SCHEMA)


def label_dim_sql() -> str:
    def q(s):
        return "'" + str(s).replace("'", "''") + "'"
    rows = ", ".join(
        f"({i}, {q(n)}, {q(c)}, {k}, {r}, {q(t)}, {q(lb)}, {li})"
        for i, n, c, k, r, t, lb, li in LABEL_DIM_ROWS)
    return (f"SELECT * FROM (VALUES {rows}) v(idx, name, cwe_id, cves_in_kev, "
            f"rank_last_year, trend, label, label_id)")


def class_names(spark: SparkSession) -> DataFrame:
    """cls -> cwe id, for decoding prediction rows."""
    return label_dim(spark).select(F.col("idx").cast("bigint").alias("cls"),
                                   F.col("cwe_id").alias("name"))


def event_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(EVENT_CLASSES)), "idx int, name string")


def event_dim_sql() -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(EVENT_CLASSES))
    return f"SELECT * FROM (VALUES {rows}) v(idx, name)"


def read_thresholds(spark: SparkSession, path: str, num_classes: int = 9) -> DataFrame:
    """One text line of comma-separated per-class floats -> (cls, threshold).

    Classes without a value get 0.5, also when the file is absent. Any other
    failure to read, and a field that is no number, is an error."""
    classes = spark.range(num_classes).select(F.col("id").alias("cls"))
    try:
        line = spark.read.text(path).limit(1)
        vals = line.select(F.posexplode(F.split(F.trim("value"), ",")).alias("cls", "v")) \
            .select(F.col("cls").cast("bigint").alias("cls"),
                    F.trim("v").cast("double").alias("threshold"))
        j = classes.join(F.broadcast(vals), "cls", "left")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        j = classes.withColumn("threshold", F.lit(None).cast("double"))
    return j.select("cls", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"))
