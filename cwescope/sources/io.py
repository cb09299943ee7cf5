"""Readers and writers for corpora, scanner reports, code files, graphs,
vocabularies, metric tables and the comparison report.

JSON files are split over tasks in every form (``json_records``): lines, one
array, or objects over several lines, mixed freely in a folder.
"""

from __future__ import annotations

import fnmatch
import io
import os
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cwescope.functions.labels import key_from_filename, key_from_url, parse_git_url, rule_to_cwe
from cwescope.session import ship
from cwescope.sources.json_records import CORRUPT, read_records, scratch

ship(__name__)

# Every field is read as text, so one odd value does not spoil its record;
# expressions convert it.
CORPUS_A_SCHEMA = ("func string, target string, cwe string, project string, commit_id string, "
                   "hash string, size string, message string, _corrupt_record string")
CORPUS_B_SCHEMA = ("func string, is_vul string, cve_id string, cwe_ids string, git_url string, "
                   "commit_msg string, file_path string, _corrupt_record string")
LOOKUP_SCHEMA = "hash string, cwe array<string>, project string, _corrupt_record string"
SCAN_SCHEMA = "affected_file string, cwe_classes array<string>, _corrupt_record string"


# --- corpora ----------------------------------------------------------------------

def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files of any form; malformed rows keep
    _corrupt_record."""
    return read_records(spark, path, schema).select("record.*")


def text_list(c: Column) -> Column:
    """JSON text of a list, or a plain string, as a list of strings; null and
    '' are empty."""
    return (F.when(c.startswith("["), F.from_json(c, "array<string>"))
            .when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c)))


def truthy(c: Column) -> Column:
    """1 for what a truth test accepts of a JSON value read as text."""
    number = F.try_to_number(c, F.lit("S999999999.999999"))
    empty = c.isin("", "false", "[]", "{}", "null") | F.coalesce(number == 0, F.lit(False))
    return F.coalesce(~empty, F.lit(False)).cast("int")


def quarantine(raw: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, bad): bad = unparsable / non-object rows or rows
    missing a required key. Both sides come from one scan plan; counting
    kept / skipped rows is an ordinary aggregate over the marked rows."""
    bad_cond = F.col("_corrupt_record").isNotNull()
    for c in required:
        bad_cond = bad_cond | F.col(c).isNull()
    marked = raw.withColumn("_bad", bad_cond)
    good = marked.where(~F.col("_bad")).drop("_bad", "_corrupt_record")
    bad = marked.where(F.col("_bad")).drop("_bad")
    return good, bad


def functions_from_a(good: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Corpus A record -> sample: id <- hash (default ''), code <- func,
    cwe_ids <- cwe (default []), label = non-empty cwe list (``target`` is
    kept as a column but does not decide the label)."""
    cwe = text_list(F.col("cwe"))
    out = good.select(
        F.coalesce("hash", F.lit("")).alias("id"), F.col("func").alias("code"),
        cwe.alias("cwe_ids"), F.coalesce("project", F.lit("")).alias("project"),
        F.coalesce("commit_id", F.lit("")).alias("commit_id"), F.col("message").alias("bug_info"),
        F.expr("try_cast(target AS int)").alias("target"), (F.size(cwe) > 0).cast("int").alias("label"))
    if allow is not None:
        allowed = F.array(*[F.lit(x) for x in allow])
        out = out.where((F.size("cwe_ids") == 0) | F.arrays_overlap("cwe_ids", allowed))
    return out


def read_functions(spark: SparkSession, path: str, allow: list[str] | None = None) -> DataFrame:
    good, _ = quarantine(read_json_records(spark, path, CORPUS_A_SCHEMA), ["func"])
    return functions_from_a(good, allow)


def read_functions_git(spark: SparkSession, path: str) -> DataFrame:
    """Corpus B: ``is_vul`` and ``func`` required; label from is_vul; project
    and commit from the commit URL ('' when it does not parse; a URL that is
    a number is null)."""
    good, _ = quarantine(read_json_records(spark, path, CORPUS_B_SCHEMA), ["func", "is_vul"])
    url = F.when(~F.col("git_url").rlike(r"^-?[0-9.]+$"), F.col("git_url"))
    pg = parse_git_url(url)
    return good.select(
        F.col("func").alias("code"), truthy(F.col("is_vul")).alias("label"), "cve_id",
        text_list(F.col("cwe_ids")).alias("cwe_ids"), url.alias("commit_url"), F.coalesce(pg["project"], F.lit("")).alias("project"),
        F.coalesce(pg["commit_id"], F.lit("")).alias("commit_id"), F.col("commit_msg").alias("bug_info"), "file_path")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays, single objects (either in any layout) or JSON Lines
    (what does not parse is dropped) -> lookup (hash, cwes, project default
    'unknown'); for a duplicate hash the last record wins, by file and place."""
    r = read_records(spark, path, LOOKUP_SCHEMA).where(F.col("record." + CORRUPT).isNull())
    e = r.select("file", "pos", F.coalesce("record.hash", F.lit("")).alias("hash"),
                 F.coalesce("record.cwe", F.array().cast("array<string>")).alias("cwes"),
                 F.coalesce("record.project", F.lit("unknown")).alias("project"))
    return e.groupBy("hash").agg(F.max_by(F.struct("cwes", "project"), F.struct("file", "pos")).alias("x")) \
        .select("hash", "x.cwes", "x.project")


# --- scanner reports ------------------------------------------------------------

def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def read_scan_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scanner CSV -> (file, cwe) findings (rows without a file are skipped).
    ``multi_line`` admits line breaks inside quotes, at one task per file;
    without it files are split."""
    df = _read_csv(spark, path, multi_line)
    return df.select(F.col("File").alias("file"), F.col("`Classification ID`").alias("cwe")) \
        .where(F.col("file").isNotNull() & (F.col("file") != ""))


def read_rule_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rule CSV -> (key, rule, cwe): key from the result URL, CWE from the rule.
    URLs and rules have no line breaks, so files are split unless
    ``multi_line`` is set."""
    df = _read_csv(spark, path, multi_line)
    url = F.coalesce(F.col("`Line Of Code Url`"), F.lit(""))
    rule = F.coalesce(F.col("`Rule Name`"), F.lit(""))
    return df.select(key_from_filename(key_from_url(url)).alias("key"), rule.alias("rule"),
                     rule_to_cwe(rule).alias("cwe"))


def read_scan_json(spark: SparkSession, path: str) -> DataFrame:
    """Scanner JSON array [{affected_file, cwe_classes[]}] -> (key, file, cwe)."""
    df = read_json_records(spark, path, SCAN_SCHEMA).where(F.col(CORRUPT).isNull())
    return df.select(key_from_filename(F.col("affected_file")).alias("key"),
                     F.col("affected_file").alias("file"),
                     F.explode_outer("cwe_classes").alias("cwe"))


def read_code_files(spark: SparkSession, path: str, glob: str = "*.c", packed: bool = False) -> DataFrame:
    """Every ``*.c`` file as one row: file name, key (last '_' part) and text.
    ``packed``: the files inside the zip archives of the folder."""
    if packed:
        df = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip") \
            .option("recursiveFileLookup", True).load(path).select("content")
        df = df.mapInArrow(_unpacked(glob), "file_name string, code binary")
        name, text = F.col("file_name"), F.col("code").cast("string")
    else:
        df = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob) \
            .option("recursiveFileLookup", True).load(path)
        name, text = F.col("_metadata.file_name"), F.col("value")
    return df.select(name.alias("file_name"), key_from_filename(name).alias("key"), text.alias("code"))


#: Bytes of text in an archive of code files, about.
ARCHIVE_BYTES = 4 << 20


def _unpacked(glob: str):
    """Archives as rows of (file name, bytes), some megabytes of text at a time."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names, texts, size = [], [], 0
                    for info in z.infolist():
                        name = info.filename.rsplit("/", 1)[-1]
                        if not info.file_size or not fnmatch.fnmatchcase(name, glob):
                            continue  # Spark's reader of whole files has no row for an empty one either
                        names.append(name)
                        texts.append(z.read(info))
                        size += len(texts[-1])
                        if size >= ARCHIVE_BYTES:
                            yield _files(names, texts)
                            names, texts, size = [], [], 0
                    if names:
                        yield _files(names, texts)

    return run


def _files(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["file_name", "code"])


def _packed(folder: str):
    """Writes the rows of a task, sorted by name, into archives that an attempt
    after a failure writes again under the same names."""
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        task, number, z, size, last = TaskContext.get(), 0, None, 0, None

        def end():
            z.close()
            os.replace(z.filename, os.path.join(folder, f"part-{task.partitionId():06d}-{number:06d}.zip"))

        for batch in batches:
            for name, code in zip(*(c.to_pylist() for c in batch.columns)):
                if name is None:
                    raise ValueError("a code file needs a name")
                if name == last:
                    continue  # a folder holds one file of a name
                if z is None:
                    z = zipfile.ZipFile(os.path.join(folder, f".part-{task.taskAttemptId()}-{number}"), "w")
                    size = 0
                data, last = (code or "").encode(), name
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    end()
                    z, number = None, number + 1
        if z is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["archives"])

    return run


# --- sinks ----------------------------------------------------------------------

def write_samples(df: DataFrame, path: str) -> bool:
    """Samples as (nested) JSON Lines; nothing is written for an empty input."""
    if df.isEmpty():
        return False
    df.write.mode("errorifexists").json(path)
    return True


def code_file_name(project, commit, key):
    return F.concat(project, F.lit("_"), commit, F.lit("_"), key, F.lit(".c"))


def write_code_files(df: DataFrame, path: str, real_files: bool = False, packed: bool = False) -> None:
    """One cleaned file per sample named ``{project}_{commit}_{id}.c``.

    Default: a parquet table keyed by file name (splittable, no small-file
    storm). ``real_files`` writes actual files from each partition to a
    shared file system path (one task writes its own rows' files), with
    ``packed`` into zip archives: a small file of its own takes a whole block
    of the disk, and a place in the driver's listing."""
    if not real_files:
        df.select("file_name", "code").write.mode("errorifexists").parquet(path)
        return

    local = path[len("file:"):] if path.startswith("file:") else path
    if "://" in local:
        raise ValueError("real_files needs a shared file system path mounted on every executor")
    if packed:
        os.makedirs(local, exist_ok=True)
        rows = df.select("file_name", "code").repartition("file_name").sortWithinPartitions("file_name")
        rows.mapInArrow(_packed(local), "archives int").write.format("noop").mode("overwrite").save()
        return

    def write_part(rows):
        os.makedirs(local, exist_ok=True)
        for r in rows:
            with open(os.path.join(local, r["file_name"]), "w", encoding="utf-8") as fh:
                fh.write(r["code"] or "")

    df.select("file_name", "code").foreachPartition(write_part)


def write_partitioned(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Processed table of one split (partition pruning on ``split``)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_vocab(vocab: DataFrame, path: str, dim: int, frozen: bool) -> None:
    vocab.select("node_type", "type_id", F.lit(dim).alias("dim"), F.lit(frozen).alias("frozen")) \
        .write.mode("errorifexists").json(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node_type string, type_id int, dim int, frozen boolean").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Small metric table (one row, or one per class) as one headed CSV."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def update_report(report: DataFrame, result: DataFrame, key: str, path: str) -> DataFrame:
    """New report = report left-joined with new columns of ``result`` by key,
    written to a new path (Spark cannot overwrite a path it reads); missing
    list columns become []."""
    cols = [c for c in result.columns if c != key]
    j = report.join(result, key, "left")
    for c, t in result.dtypes:
        if c in cols and t.startswith("array"):
            j = j.withColumn(c, F.coalesce(F.col(c), F.array().cast(t)))
    j.write.mode("errorifexists").parquet(path)
    return report.sparkSession.read.parquet(path)
