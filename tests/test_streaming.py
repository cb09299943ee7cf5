"""Row-local operators run unchanged on a streaming source."""

from pyspark.sql import functions as F

from cwescope.sources import io as IO
from cwescope.sources import views as V
from cwescope.streaming import findings as S


def test_rule_stream_matches_batch(spark, sf):
    lab = V.tool_labels(spark, sf).where(F.col("tool") == "tool_b")
    rows = lab.select(
        F.concat(F.lit("https://scan.example/r/proj_x_"), F.col("sample_id").cast("string"), F.lit(".c#L1"))
        .alias("Line Of Code Url"),
        F.concat(F.lit("c.lang."), F.when(F.col("sample_id") % 2 == 0, F.lit("double-free"))
                 .otherwise(F.lit("insecure-hash"))).alias("Rule Name"))
    folder = IO.scratch(spark, "stream-in")
    rows.write.option("header", True).csv(folder)
    batch = S.cwe_sets(S.classify_rules(spark.read.schema(S.RULE_CSV_SCHEMA).option("header", True).csv(folder)))
    S.run_available(S.cwe_sets(S.rule_findings_stream(spark, folder)), "rule_sets",
                    IO.scratch(spark, "stream-ckpt"))
    got = spark.table("rule_sets")
    assert sorted(got.collect()) == sorted(batch.collect())
    assert got.count() > 0
