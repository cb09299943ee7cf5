"""Helpers shared by the training-data operators.

Words of a text are maximal runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``). Python code that runs inside tasks is pickled by
value (``ship``), so executors need no copy of this package.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cwescope.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value when they go to a task."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: one
    evaluation, no lineage behind it, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that columns which an operator
    adds beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def word_count(text):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- inside tasks ------------------------------------------------------------

def compact(texts: pa.Array) -> pa.Array:
    """The texts as an array of their own, nulls as ''. Arrow's lower-casing
    goes wrong on a slice whose offsets do not start at 0."""
    return pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts)))), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text: (start offsets, one more than texts; flat words)."""
    if len(texts) == 0:
        return np.zeros(1, np.int64), pa.array([], pa.large_string())
    lists = pc.ascii_split_whitespace(compact(texts))
    size = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    seen = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    return seen[offsets], flat if full.all() else flat.filter(pa.array(full))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser on uint64 (wraps)."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; every distinct word is hashed once."""
    import xxhash

    if len(words) == 0:
        return np.zeros(0, np.uint64)
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
    return table[np.asarray(coded.indices)]


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash (polynomial, modulo 2**64) of each run of ``length``
    consecutive word hashes; doubling needs about log2(length) passes."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    n_out = len(words) - length + 1
    out, size, block, span = None, 0, words, 1
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out, size = block, span
            else:
                shift = np.uint64(pow(base, span, 1 << 64))
                n = min(len(out), len(block) - size)
                out = out[:n] * shift + block[size:size + n]
                size += span
        rest >>= 1
        if rest:
            n = len(block) - span
            block = block[:n] * np.uint64(pow(base, span, 1 << 64)) + block[span:span + n]
            span *= 2
    return out[:n_out]
