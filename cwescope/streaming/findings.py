"""Scanner findings as a stream.

The original work reads whole report files; nothing in it streams. The
row-local operators (result URL -> sample key, rule name -> CWE) are plain
column expressions, so the same code runs on a ``readStream`` DataFrame:
new report files landing in a folder are classified incrementally, and the
per-sample CWE sets are kept as streaming state (update mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cwescope.functions.labels import key_from_filename, key_from_url, rule_to_cwe

RULE_CSV_SCHEMA = "`Line Of Code Url` string, `Rule Name` string"


def classify_rules(df: DataFrame) -> DataFrame:
    """(key, rule, cwe) for every rule finding; batch or streaming input."""
    url = F.coalesce(F.col("`Line Of Code Url`"), F.lit(""))
    rule = F.coalesce(F.col("`Rule Name`"), F.lit(""))
    return df.select(key_from_filename(key_from_url(url)).alias("key"), rule.alias("rule"),
                     rule_to_cwe(rule).alias("cwe"))


def rule_findings_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming source: rule CSV files as they arrive in ``folder``."""
    src = spark.readStream.schema(RULE_CSV_SCHEMA).option("header", True).csv(folder)
    return classify_rules(src)


def cwe_sets(findings: DataFrame) -> DataFrame:
    """Per sample key: sorted set of mapped CWEs (rows without key or CWE are
    skipped: an empty key never joins a sample)."""
    f = findings.where((F.col("key") != "") & F.col("cwe").isNotNull())
    return f.groupBy("key").agg(F.array_sort(F.collect_set("cwe")).alias("cwes"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything available now into an in-memory table ``name``."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
