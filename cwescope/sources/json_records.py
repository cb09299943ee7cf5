"""Records of JSON corpora: JSON Lines, arrays and multi-line objects, mixed
freely in one folder, each file split over many tasks.

The form of each file follows from its first line that is not blank
(``file_forms``). Lines are parsed where they are read. Files that hold one
array (or objects over several lines) are read in pieces that end at ``}``, a
byte that every record has, so the reader splits them wherever blocks end, also
when the file is a single line:

1. ``block_states``: one pass counts, per block, the quotes and the brackets
   outside strings, for both answers to "does the block start inside a string".
   Running sums over the few blocks of a file then give each block the string
   state and the bracket depth at its start.
2. ``_chunks``: a second pass adds the running sums inside the blocks. A piece
   that ends outside strings at the depth of the file's records ends a record.
   What a block has before its first and after its last end of a record is
   joined with its neighbours' parts, a few rows per block.

So a record may span blocks, and no task reads more than its blocks. The
records are written once into the shared folder. A value of an array that is not
an object, an object that does not parse, and what follows a file's last record
if the file is cut off, are rows with ``_corrupt_record``.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cwescope.session import checkpoint_dir, ship

ship(__name__)

CORRUPT = "_corrupt_record"
#: Blocks whose states are sent to all tasks; beyond, the pieces are shuffled to them.
BROADCAST_BLOCKS = 500_000
LEAD = r"^[\s,\x{FEFF}]*"
#: Everything before the first object of a chunk.
BEFORE_OBJECT = r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+'


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never reused)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/cwescope-io/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _text(spark: SparkSession, paths: str | list[str], end: str | None = None) -> DataFrame:
    """value, file, size, block (offset of the split) and row (rises within a
    task, so it orders the rows of a block)."""
    reader = spark.read.option("recursiveFileLookup", True)
    if end:
        reader = reader.option("lineSep", end)
    meta = "_metadata.file_"
    return reader.text(paths).select(
        "value", F.col(meta + "path").alias("file"), F.col(meta + "size").alias("size"),
        F.col(meta + "block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


# ---- forms -----------------------------------------------------------------------

def file_forms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, form of every file that is not blank: ``array`` if it opens with
    '[', ``object`` if its first line opens an object that goes on in the next
    line, else ``lines``. Pieces end at ``}``, so no task holds a long line."""
    head = F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")
    line = F.rtrim(F.substring_index(head, "\n", 1))
    look = F.struct(F.substring(line, 1, 1).alias("first"), F.right(line, F.lit(1)).alias("last"),
                    F.contains(head, F.lit("\n")).alias("ends"))
    first = (_text(spark, path, "}").where(F.col("value").rlike(r"[^\s\x{FEFF}]"))
             .groupBy("file").agg(F.min_by(look, F.struct("block", "row")).alias("x")))
    goes_on = (F.col("x.first") == "{") & F.col("x.ends") & F.col("x.last").isin("{", "[", ",")
    return first.select("file", F.when(F.col("x.first") == "[", "array").when(goes_on, "object")
                        .otherwise("lines").alias("form"))


# ---- pieces ------------------------------------------------------------------------

def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pieces with their quotes (q, modulo 2) and change of depth if they start
    outside (d0) or inside (d1) a string, the closing ``}`` included."""
    clean = F.regexp_replace("value", r"(?s)\\.", "")

    def change(start: Column, odd: int) -> Column:
        outside = F.regexp_replace(start, r'"[^"]*("|$)', "")
        return (F.regexp_count(outside, F.lit(r"[{\[]")) - F.regexp_count(outside, F.lit(r"\]"))
                - (F.col("q") == odd).cast("int")).cast("int")

    df = _text(spark, paths, "}").withColumn("clean", clean)
    df = df.withColumn("q", (F.regexp_count("clean", F.lit('"')) % 2).cast("int"))
    return df.select(F.xxhash64("file").alias("fkey"), "file", "size", "block", "row", "value", "q",
                     change(F.col("clean"), 0).alias("d0"),
                     change(F.concat(F.lit('"'), "clean"), 1).alias("d1"))


def _runs(batch: pa.RecordBatch):
    """(fkey, block, first row, end) of the runs of one block in a batch."""
    fkey, block = (np.asarray(batch.column(c)) for c in ("fkey", "block"))
    cuts = np.flatnonzero((fkey[1:] != fkey[:-1]) | (block[1:] != block[:-1])) + 1
    edges = np.concatenate([[0], cuts, [len(fkey)]]) if len(fkey) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(fkey[lo]), int(block[lo]), lo, hi


STATE = "fkey long, block long, rows long, bytes long, q int, d0 long, d1 long"
STATE_SCHEMA = pa.schema([(c, pa.int64()) for c in ("fkey", "block", "rows", "bytes")] + [
    ("q", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64())])


def _states(batches):
    """Totals of each block, for a start outside and inside a string."""
    key, total = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((*key, *total), STATE_SCHEMA.types)], schema=STATE_SCHEMA)

    for batch in batches:
        q, d0, d1, size = (np.asarray(batch.column(c)).astype(np.int64) for c in ("q", "d0", "d1", "bytes"))
        for fkey, block, lo, hi in _runs(batch):
            if (fkey, block) != key:
                if key:
                    yield row()
                key, total = (fkey, block), [0, 0, 0, 0, 0]
            part = q[lo:hi]
            inside = (total[2] + np.cumsum(part) - part) % 2 == 1
            total = [total[0] + hi - lo, total[1] + int(size[lo:hi].sum()), (total[2] + int(part.sum())) % 2,
                     total[3] + int(np.where(inside, d1[lo:hi], d0[lo:hi]).sum()),
                     total[4] + int(np.where(inside, d0[lo:hi], d1[lo:hi]).sum())]
    if key:
        yield row()


def block_states(pieces: DataFrame, base: DataFrame) -> DataFrame:
    """Per block: rows, inside (starts inside a string), depth (at its start),
    base (depth of the file's records), cut (its last piece has no ``}``)."""
    narrow = pieces.select("fkey", "block", (F.octet_length("value") + 1).alias("bytes"), "q", "d0", "d1")
    totals = stored(narrow.mapInArrow(_states, STATE), "json-blocks")
    before = Window.partitionBy("fkey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1
    states = totals.withColumn("inside", inside).withColumn("d", F.when(F.col("inside"), F.col("d1")).otherwise(
        F.col("d0"))).withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0)))
    per_file = Window.partitionBy("fkey")
    cut = (F.sum("bytes").over(per_file) > F.col("size")) & (F.col("block") == F.max("block").over(per_file))
    return states.join(base, "fkey").select("fkey", "block", "rows", "inside", "depth", "base", cut.alias("cut"))


# ---- chunks ------------------------------------------------------------------------

HEAD, RECORD, WHOLE, TAIL = range(4)
CHUNK = "fkey long, block long, n long, kind int, base int, text string"
CHUNK_SCHEMA = pa.schema([("fkey", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()),
                          ("base", pa.int32()), ("text", pa.large_string())])


class _Block:
    """Running state of the block that a task reads."""

    def __init__(self, fkey: int, block: int, r: dict):
        self.key = (fkey, block)
        self.inside, self.depth, self.base = int(r["inside"]), r["depth"], r["base"]
        self.left, self.cut = r["rows"], r["cut"]
        self.n, self.pending = 0, []

    def add(self, texts: list[str], q, d0, d1):
        """Rows for the records that end among these pieces."""
        inside = (self.inside + np.cumsum(q) - q) % 2
        depth = self.depth + np.cumsum(np.where(inside == 1, d1, d0))
        self.left -= len(texts)
        ends = ((inside + q) % 2 == 0) & (depth == self.base)
        last = self.left == 0 and self.cut
        if last:
            ends[-1] = False
        self.inside, self.depth = int((inside[-1] + q[-1]) % 2), int(depth[-1])
        at = 0
        for end in (np.flatnonzero(ends) + 1).tolist():
            text = "".join(self.pending) + "}".join(texts[at:end]) + "}"
            yield (*self.key, self.n, RECORD if self.n else HEAD, self.base, text)
            self.pending, at, self.n = [], end, self.n + 1
        if at < len(texts):
            self.pending.append("}".join(texts[at:]) + ("" if last else "}"))

    def rest(self):
        """An empty tail too: the next block's head is not of the same record
        as this block's."""
        if self.pending or self.n:
            yield (*self.key, self.n, TAIL if self.n else WHOLE, self.base, "".join(self.pending))


def _chunks(batches):
    """Chunks that end with a record, and what a block has around them."""
    state = None

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNK_SCHEMA.types)],
                                          schema=CHUNK_SCHEMA)

    for batch in batches:
        q, d0, d1 = (np.asarray(batch.column(c)).astype(np.int64) for c in ("q", "d0", "d1"))
        rows = []
        for fkey, block, lo, hi in _runs(batch):
            if state is None or state.key != (fkey, block):
                if state:
                    rows += state.rest()
                state = _Block(fkey, block, {c: batch.column(c)[lo].as_py() for c in (
                    "inside", "depth", "base", "rows", "cut")})
            rows += state.add(batch.column("value").slice(lo, hi - lo).to_pylist(), q[lo:hi], d0[lo:hi], d1[lo:hi])
        if rows:
            yield made(rows)
    if state and (rows := list(state.rest())):
        yield made(rows)


def structured_chunks(spark: SparkSession, files: DataFrame, paths: str | list[str]) -> DataFrame:
    """file, pos, base, opens (the file starts here), ends (a record ends
    here), text: the files' text cut behind every record."""
    pieces = _pieces(spark, paths)
    base = files.select(F.xxhash64("file").alias("fkey"), "file", (F.col("form") == "array").cast("int").alias("base"))
    sizes = pieces.groupBy("fkey").agg(F.max("size").alias("size"))
    states = stored(block_states(pieces, base.join(sizes, "fkey")), "json-states")
    rows = pieces.select("fkey", "block", "row", "value", "q", "d0", "d1")
    if states.count() <= BROADCAST_BLOCKS:
        met = rows.join(F.broadcast(states), ["fkey", "block"])  # keeps the order of the scan
    else:
        met = rows.join(states, ["fkey", "block"]).repartition("fkey", "block").sortWithinPartitions(
            "fkey", "block", "row")
    chunks = stored(met.drop("row").mapInArrow(_chunks, CHUNK), "json-chunks")
    whole = chunks.where(F.col("kind") == RECORD).select(
        "fkey", F.struct("block", "n").alias("pos"), "base", F.lit(False).alias("opens"), F.lit(True).alias("ends"),
        "text")
    # a tail goes on in the blocks behind it, up to the next head
    parts = chunks.where(F.col("kind") != RECORD)
    tails = Window.partitionBy("fkey").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(tails))
    joined = parts.groupBy("fkey", "base", "chain").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "n", "text"))).alias("x"),
        F.max(F.col("kind") == HEAD).alias("ends"))
    joined = joined.select("fkey", F.struct(F.col("x")[0]["block"].alias("block"), F.col("x")[0]["n"].alias("n"))
                           .alias("pos"), "base", (F.col("chain") == 0).alias("opens"), "ends",
                           F.concat_ws("", F.transform("x", lambda s: s["text"])).alias("text"))
    return whole.unionByName(joined).join(base.select("fkey", "file"), "fkey").drop("fkey")


def _parsed(chunks: DataFrame, schema: str) -> DataFrame:
    """file, pos, record of each value in the chunks."""
    body = F.when(F.col("opens") & (F.col("base") == 1), F.regexp_replace("text", r"^[\s\x{FEFF}]*\[", "")).otherwise(
        F.col("text"))
    c = chunks.withColumn("body", F.regexp_replace(body, LEAD, ""))
    before = F.when(F.col("ends"), F.regexp_extract("body", BEFORE_OBJECT, 0)).otherwise(
        F.regexp_replace("body", r"\]\s*$", ""))
    closed = F.col("ends") | F.when(F.col("base") == 1, F.col("body").rlike(r"\]\s*$")).otherwise(F.col("body") == "")
    c = c.withColumn("before", before).withColumn("plain", F.regexp_replace("before", r"[\s,]+$", ""))
    values = F.from_json(F.concat(F.lit("["), "plain", F.lit("]")), "array<string>")
    values = F.transform(values, lambda v: F.coalesce(v, F.lit("null")))
    none = F.array().cast("array<string>")
    # a bracket that stays open: an array with objects stands before the record
    torn = F.col("ends") & (F.col("plain") != "") & values.isNull()
    all_ = F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>")
    split = torn & all_.isNotNull() & (F.size(all_) > 1)
    others = (F.when(~closed, F.array("body")).when(F.col("plain") == "", none)
              .when(split, F.slice(all_, 1, F.size(all_) - 1)).otherwise(F.coalesce(values, F.array("body"))))
    own = (F.when(split, F.slice(all_, -1, 1))
           .when(F.col("ends") & ~torn, F.array(F.expr("substring(body, length(before) + 1)"))).otherwise(none))
    items = F.concat(F.transform(others, lambda v: F.struct(v.alias("raw"), F.lit(False).alias("object"))),
                     F.transform(own, lambda v: F.struct(v.alias("raw"), F.lit(True).alias("object"))))
    rows = c.select("file", "pos", F.posexplode(items).alias("k", "v"))
    return rows.select("file", F.struct("pos.block", "pos.n", F.col("k").alias("k")).alias("pos"),
                       _record(F.col("v.raw"), schema, F.col("v.object")).alias("record"))


def _record(raw: Column, schema: str, is_object: Column) -> Column:
    # here the column is data like any other
    bad = F.from_json(F.to_json(F.struct(raw.alias(CORRUPT))), schema, {"columnNameOfCorruptRecord": "_none"})
    return F.coalesce(F.when(is_object, F.from_json(raw, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})), bad)


def _paths(files: DataFrame) -> list[str]:
    """Names as the reader takes them: not URL-encoded, glob signs escaped."""
    names = (unquote(r["file"]) for r in files.select("file").collect())
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", name) for name in names]


# ---- reader -------------------------------------------------------------------------

def read_records(spark: SparkSession, path: str, schema: str, form: str = "auto") -> DataFrame:
    """file, pos (a struct that orders the records of a file) and record (a
    struct of ``schema``, which must have ``_corrupt_record string``). ``form``
    spares the look at the files where all have one form. In ``auto`` the
    driver holds the names of the files when the forms are mixed, as it does
    for any folder that Spark lists."""
    forms = stored(file_forms(spark, path), "json-forms") if form == "auto" else None
    kinds = [r["form"] for r in forms.select("form").distinct().collect()] if form == "auto" else [form]
    structured = [k for k in kinds if k != "lines"]
    out = None
    if "lines" in kinds or not kinds:
        paths = path if not structured else _paths(forms.where("form = 'lines'"))
        lines = _text(spark, paths).where(F.trim("value") != "")
        object_line = F.col("value").rlike(r"^[\s\x{FEFF}]*\{")
        out = lines.select("file", F.struct("block", F.col("row").alias("n"), F.lit(0).alias("k")).alias("pos"),
                           _record(F.col("value"), schema, object_line).alias("record"))
    if structured:
        if forms is None:
            forms = _text(spark, path, "}").select("file", F.lit(form).alias("form")).distinct()
        files = forms.where("form <> 'lines'")
        paths = path if "lines" not in kinds else _paths(files)
        parsed = _parsed(structured_chunks(spark, files, paths), schema)
        out = parsed if out is None else out.unionByName(parsed)
    return out
