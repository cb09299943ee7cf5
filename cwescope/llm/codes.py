"""Vector code compression with equal-average nearest-entry search.

Components become ``floor(scale * x)``. A vector is cut into equal consecutive
parts; each part position has a codebook that starts as that part of the
smallest ids. A round assigns every part to its nearest entry and replaces each
used entry by the componentwise floor of its parts' mean. Finally all parts are
assigned again: one byte per part is the vector's code.

Nearest entry (``nearest``): entries are sorted by the sum of their components.
From the place of the part's own sum the search goes outward, the nearer sum
first, and ends when the squared gap of the sums over the part's dimension
strictly exceeds the best squared distance: by Cauchy and Schwarz no entry
beyond can be as near. Ties go to the lower index, so equal bounds go on. The
steps of all parts of a block run together.

Rows are packed into blocks where they are read and stored once. A pass joins
blocks with the codebooks (one short row per vector length; broadcast while all
of them are below ``BROADCAST_BYTES``, else joined on a salted length), sums up
in the task and shuffles one row per task and entry. Codebooks stay tables.

All arithmetic is in integers: 64 bits where nothing can overflow, else Python's
own. An error above 2**63 - 1 is returned as that number.

Vectors that are null or hold a null or a component that is not finite take no
part, nor do those whose length the number of parts does not divide. Vectors of
other lengths do not meet: each length has its own codebooks (an empty vector
has codebooks without components). The first codebooks take rows by id, nulls
last, then by vector, so rows of one id are entries of their own; fewer rows
than entries make smaller codebooks. Null labels are one label. Columns other
than the id, the vector and the label are not read. Empty tables give no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cwescope.llm.common import ship, store

ship(__name__)

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK_BYTES = 1 << 21
BROADCAST_BYTES = 32 << 20
#: Blocks that meet one copy of the codebooks where these are too many to broadcast.
SALT_BLOCKS = 64
LABEL_SALTS = 16
LONGEST = (1 << 63) - 1


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """id, label, x (array of double) of the vectors that take part."""
    def finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                          x.alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", finite) & (F.size("x") % parts == 0))


# ---- integers, inside tasks ------------------------------------------------------

def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: int64, or Python integers where those of a
    part of this length could overflow."""
    scaled = x * scale
    if not scaled.size or np.abs(scaled).max() < 1 << 52:
        return np.floor(scaled).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 1 << 52 else int(np.floor(v * scale)) for v in row] for row in x],
                    dtype=object)


def same_kind(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if squared distances and gaps stay below 2**62."""
    d = max(1, points.shape[1])
    top = max((int(abs(a).max()) for a in (points, entries) if a.size), default=0)
    kind = np.int64 if 4 * d * d * top * top < 1 << 62 else object
    return points.astype(kind), entries.astype(kind)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each point."""
    points, entries = same_kind(points, entries)
    n, d = points.shape
    k = len(entries)
    sums = entries.sum(axis=1) if d else np.zeros(k, np.int64)
    by = np.argsort(sums, kind="stable")
    entries, sums = entries[by], sums[by]
    own = points.sum(axis=1) if d else np.zeros(n, np.int64)
    right = np.searchsorted(sums, own)
    left = right - 1
    index = np.full(n, -1)
    best = np.zeros(n, points.dtype)
    at = np.arange(n)
    while len(at):
        lo, hi = left[at], right[at]
        below, above = own[at] - sums[np.maximum(lo, 0)], sums[np.minimum(hi, k - 1)] - own[at]
        down = (lo >= 0) & ((hi >= k) | (below <= above))
        gap = np.where(down, below, above)
        go = ((lo >= 0) | (hi < k)) & ((index[at] < 0) | (gap * gap <= max(1, d) * best[at])).astype(bool)
        at, lo, hi, down = at[go], lo[go], hi[go], down[go]
        place = np.where(down, lo, hi)
        off = points[at] - entries[place]
        far = (off * off).sum(axis=1) if d else np.zeros(len(at), np.int64)
        found = by[place]
        old = index[at]
        better = (old < 0) | (far < best[at]).astype(bool) | ((far == best[at]).astype(bool) & (found < old))
        index[at[better]], best[at[better]] = found[better], far[better]
        left[at[down]] -= 1
        right[at[~down]] += 1
    return index, best


def book_of(text: str, dim: int, parts: int) -> np.ndarray:
    """Codebooks (parts, entries, dim / parts) from their decimal form."""
    if not dim:
        return np.zeros((parts, 1, 0), np.int64)
    flat = np.array([int(v) for v in text.split(",")], dtype=object)
    return flat.reshape(parts, -1, dim // parts)


# ---- blocks, inside tasks -----------------------------------------------------------

BLOCK_SCHEMA = pa.schema([("dim", pa.int32()), ("salt", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())),
                          ("labels", pa.list_(pa.int64())), ("x", pa.binary())])
BLOCKS = "dim int, salt long, n long, ids array<long>, labels array<long>, x binary"


def _blocks(batches):
    """Rows as blocks of one length, about ``BLOCK_BYTES`` each."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    made = 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        size = np.asarray(pa.compute.list_value_length(batch.column("x")), dtype=np.int64)
        for dim in np.unique(size):
            of_dim = np.flatnonzero(size == dim)
            step = max(1, BLOCK_BYTES // (8 * max(1, int(dim))))
            for lo in range(0, len(of_dim), step):
                part = rows.take(pa.array(of_dim[lo:lo + step])).combine_chunks()
                x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([{
                    "dim": int(dim), "salt": (first + made) // SALT_BLOCKS, "n": len(part),
                    "ids": part.column("id").to_pylist(), "labels": part.column("label").to_pylist(),
                    "x": x.astype(np.float64).tobytes()}], schema=BLOCK_SCHEMA)
                made += 1


def _parts_of(r: dict, parts: int, scale: int) -> np.ndarray:
    x = to_integers(np.frombuffer(r["x"], np.float64).reshape(r["n"], r["dim"]), scale)
    return x.reshape(r["n"], parts, r["dim"] // parts)


SUM_SCHEMA = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                        ("sums", pa.string())])
SUMS = "dim int, part int, entry int, n long, sums string"


def _sum_up(parts: int, scale: int):
    """Per task: number and sums of the parts assigned to each entry."""
    def run(batches):
        total: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                book = book_of(r["book"], r["dim"], parts)
                points = _parts_of(r, parts, scale)
                for p in range(parts):
                    index, _ = nearest(points[:, p], book[p])
                    used, code, n = np.unique(index, return_inverse=True, return_counts=True)
                    small = points.dtype != object
                    sums = np.zeros((len(used), points.shape[2]), np.int64 if small else object)
                    np.add.at(sums, code.reshape(-1), points[:, p])
                    for e, count, row in zip(used.tolist(), n.tolist(), sums.tolist()):
                        had = total.setdefault((r["dim"], p, e), [0, [0] * len(row)])
                        had[0] += count
                        had[1] = [a + int(b) for a, b in zip(had[1], row)]
        yield pa.RecordBatch.from_pylist(
            [{"dim": d, "part": p, "entry": e, "n": n, "sums": ",".join(map(str, s))}
             for (d, p, e), (n, s) in total.items()], schema=SUM_SCHEMA)
    return run


def _mean(table: pa.Table) -> pa.Table:
    """The floored mean of one entry from the tasks' sums."""
    rows = table.to_pylist()
    n = sum(r["n"] for r in rows)
    sums = [sum(c) for c in zip(*([int(v) for v in r["sums"].split(",") if v] for r in rows))]
    key = {c: rows[0][c] for c in ("dim", "part", "entry")}
    return pa.Table.from_pylist([{**key, "n": n, "sums": ",".join(str(s // n) for s in sums)}], schema=SUM_SCHEMA)


def _first_book(parts: int, scale: int):
    """The first codebooks of a length from its few chosen rows."""
    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = to_integers(np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), keys[0]), scale)
        book = x.reshape(len(pdf), parts, keys[0] // parts).transpose(1, 0, 2)
        return pd.DataFrame({"dim": [keys[0]], "book": [",".join(map(str, book.reshape(-1).tolist()))]})
    return run


def _next_book(parts: int):
    """Old codebooks of a length with the means of the used entries."""
    def run(keys, old: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        dim = int(keys[0])
        book = book_of(old["book"].iloc[0], dim, parts)
        for p, e, sums in zip(means["part"], means["entry"], means["sums"]) if dim else ():
            book[p, e] = [int(v) for v in sums.split(",")]
        return pd.DataFrame({"dim": [dim], "book": [",".join(map(str, book.reshape(-1).tolist()))]})
    return run


CODE_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("code", pa.binary()),
                         ("error", pa.int64())])
CODES = "vec_id long, label long, dim int, code binary, error long"


def _encode(parts: int, scale: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                book = book_of(r["book"], r["dim"], parts)
                points = _parts_of(r, parts, scale)
                found = [nearest(points[:, p], book[p]) for p in range(parts)]
                codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                error = sum(far.astype(object) for _, far in found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["ids"], pa.int64()), pa.array(r["labels"], pa.int64()),
                    pa.array([r["dim"]] * r["n"], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array([min(int(e), LONGEST) for e in error], pa.int64())], schema=CODE_SCHEMA)
    return run


# ---- operator ---------------------------------------------------------------------------

class Compression:
    """``codes``: vec_id, label, dim, code (one byte per part), error.
    ``books``: dim, book (decimal components by part, entry and place)."""

    def __init__(self, codes: DataFrame, books: DataFrame):
        self.codes, self.books = codes, books


def _met(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """Blocks with the codebooks of their length."""
    size = books.agg(F.coalesce(F.sum(F.length("book")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(books), "dim")
    salts = blocks.select("dim", "salt").distinct()
    return blocks.join(salts.join(books, "dim"), ["dim", "salt"])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> Compression:
    """Trains the codebooks on all vectors and encodes all of them (at most 256
    entries; ``scale`` is an integer)."""
    rows = usable(vectors, parts)
    blocks = store(rows.mapInArrow(_blocks, BLOCKS), "codes-blocks")
    order = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "x")
    first = (rows.withColumn("dim", F.size("x")).withColumn("rank", F.row_number().over(order))
             .where(F.col("rank") <= entries).select("dim", "rank", "x"))
    books = store(first.groupBy("dim").applyInPandas(_first_book(parts, scale), "dim int, book string"), "codes-books")
    for _ in range(rounds):
        means = (_met(blocks, books).mapInArrow(_sum_up(parts, scale), SUMS)
                 .groupBy("dim", "part", "entry").applyInArrow(_mean, SUMS))
        books = store(books.groupBy("dim").cogroup(means.groupBy("dim")).applyInPandas(
            _next_book(parts), "dim int, book string"), "codes-books")
    return Compression(store(_met(blocks, books).mapInArrow(_encode(parts, scale), CODES), "codes"), books)


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256."""
    made = compress(vectors)
    # a label may hold a third of all rows: its sum meets them under several salts
    per_label = made.codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    total = F.least("total", F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    per_label = per_label.select(F.col("label").alias("of"), total.alias("label_error"),
                                 F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).alias("of_salt"))
    rows = made.codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALTS)).cast("int"))
    digest = made.books.select(F.col("dim").alias("of_dim"), F.sha2("book", 256).alias("codebooks_sha256"))
    return (rows.join(per_label, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
            .join(digest, F.col("dim") == F.col("of_dim"))
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for vectors of one length that the number of parts divides."""
    nearest_sql = """
a{n} AS MATERIALIZED (
  SELECT vec_id, part, v, min_by(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, p.v, b.entry,
               list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) AS d
        FROM parts p JOIN b{n} b USING (part))
  GROUP BY vec_id, part, v)"""
    step_sql = """
b{m} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
  FROM b{n} b LEFT JOIN (
    SELECT part, entry, list(c ORDER BY i) AS v
    FROM (SELECT part, entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS c
          FROM a{n}, range(1, (SELECT max(len(v)) + 1 FROM parts)) r(i) GROUP BY part, entry, i)
    GROUP BY part, entry) m USING (part, entry))"""
    ctes = [f"""
ints AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS v
  FROM ints, range({parts}) r(part)),
b0 AS MATERIALIZED (
  SELECT part, entry, v
  FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ints) USING (vec_id)
  WHERE entry < {entries})"""]
    for n in range(rounds):
        ctes += [nearest_sql.format(n=n), step_sql.format(n=n, m=n + 1)]
    ctes.append(nearest_sql.format(n=rounds))
    return "WITH" + ",".join(ctes) + f""",
e AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e JOIN ints USING (vec_id)
"""


ORACLE = _oracle()
