"""Substring dedup: token windows that occur earlier are removed.

A window is ``length`` consecutive words of one document. Every word covered
by a window whose word sequence also starts earlier (smaller id, or the same
document and an earlier start) goes.

1. Tasks read documents in chunks of about ``CHUNK_WORDS`` words, give each
   window its Rabin-Karp hash (64 bits, then a bijective mix), and keep the
   first window of each hash per chunk. The others are repeats already, so a
   passage that fills a third of the corpus leaves a chunk once.
2. The first windows go to buckets by the leading hash bits, packed as byte
   arrays (the bucket holds the bits that are not sent). Each bucket sorts
   its hashes; all but the earliest of equal ones are repeats.
3. Repeats come back per document, already merged into intervals; a join on
   the id merges them into maximal ones and cuts them out of the text.

Two different windows share a hash with probability 2**-64 each pair.

Null and empty texts have no words and keep the empty text. A text shorter
than the window keeps all its words. Null ids come last and count as one id.
Rows that repeat an id share their intervals; windows at the same place of
rows with one id are not earlier than each other. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import mixed, ship, split_words, window_hashes, word_hashes

ship(__name__)

LENGTH = 20
CHUNK_WORDS = 1_500_000
BUCKET_WINDOWS = 1 << 20
CHARS_PER_WORD = 6
#: Stands for a null id; greater than every id.
NO_ID = (1 << 63) - 1

PACKED = "bucket int, hashes binary, ids binary, counts binary, starts binary"


# ---- inside tasks ------------------------------------------------------------

def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each integer, one plane after the other
    (even planes compress)."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def from_planes(b: bytes, width: int, dtype) -> np.ndarray:
    n = len(b) // width
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)


def packed_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of equal ids: (differences, run lengths)."""
    if not len(ids):
        return b"", b""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    runs = np.diff(np.append(at, len(ids))).astype(np.int32)
    return planes(np.diff(ids[at], prepend=0).astype(np.int64), 8), planes(runs, 4)


def unpacked_ids(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.cumsum(from_planes(ids, 8, np.int64)), from_planes(counts, 4, np.int32))


def merged(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of each id; touching ones join."""
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(ids):
        return ids, starts, ends
    # a running maximum of the ends that never leaks into the next id
    group = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
    reach = np.maximum.accumulate(ends + (group << 33)) - (group << 33)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return ids[at], starts[at], reach[np.append(at[1:], len(ids)) - 1]


def not_first(key: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For rows sorted by (key, id, start): which come after another place."""
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0)) if len(key) else head
    return (ids != ids[lead]) | (starts != starts[lead]) if len(key) else head


def _rows(bucket, hashes, ids, counts, starts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), *(pa.array(c, pa.binary()) for c in (hashes, ids, counts, starts))],
        names=["bucket", "hashes", "ids", "counts", "starts"])


def _interval_rows(ids, starts, ends, bucket) -> pa.RecordBatch:
    """All intervals of a chunk or bucket as one row without hashes."""
    a, b = packed_ids(ids)
    return _rows([bucket], [None], [a], [b],
                 [planes(starts.astype(np.int32), 4) + planes((ends - starts).astype(np.int32), 4)])


def _chunk(texts: list[pa.Array], ids: np.ndarray, length: int, bits: int):
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    offsets, words = split_words(pa.concat_arrays(texts).take(pa.array(order)))
    hashes = mixed(window_hashes(word_hashes(words), length))
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.maximum(size - length + 1, 0))
    many = np.maximum(size - length + 1, 0)
    first = np.repeat(np.cumsum(many) - many, many)
    starts = (np.arange(len(doc)) - first).astype(np.int32)
    hashes = hashes[offsets[:-1][doc] + starts] if len(doc) else np.zeros(0, np.uint64)
    by_hash = np.argsort(hashes, kind="stable")
    key = hashes[by_hash]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    again = by_hash[not_first(key, ids[doc[by_hash]], starts[by_hash])]
    if len(again):
        found = merged(ids[doc[again]], starts[again], starts[again] + length)
        yield _interval_rows(*found, int(found[0][0]) & ((1 << bits) - 1))
    sent = by_hash[head]
    cuts = np.searchsorted(hashes[sent], np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    out = []
    for bucket, part in enumerate(np.split(sent, cuts)):
        if len(part):
            part = np.sort(part)
            out.append((bucket, planes(hashes[part], 7), *packed_ids(ids[doc[part]]), planes(starts[part], 4)))
        if len(out) == 256:
            yield _rows(*zip(*out))
            out = []
    if out:
        yield _rows(*zip(*out))


def _windows(length: int, bits: int):
    def run(batches):
        texts, ids, words = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                text = part.column("text").cast(pa.large_string())
                texts.append(text)
                ids.append(part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64))
                words += text.nbytes // CHARS_PER_WORD
                if words >= CHUNK_WORDS:
                    yield from _chunk(texts, np.concatenate(ids), length, bits)
                    texts, ids, words = [], [], 0
        if texts:
            yield from _chunk(texts, np.concatenate(ids), length, bits)
    return run


def _bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, ids, starts, done = [], [], [], []
        for r in table.to_pylist():
            its = unpacked_ids(r["ids"], r["counts"])
            if r["hashes"] is None:  # intervals found within a chunk
                half = len(r["starts"]) // 2
                a = from_planes(r["starts"][:half], 4, np.int32)
                done.append((its, a, a + from_planes(r["starts"][half:], 4, np.int32)))
                continue
            hashes.append(from_planes(r["hashes"], 7, np.uint64))
            ids.append(its)
            starts.append(from_planes(r["starts"], 4, np.int32))
        if hashes:
            key, its, at = np.concatenate(hashes), np.concatenate(ids), np.concatenate(starts)
            order = np.argsort(key)
            k = key[order]
            same = k[1:] == k[:-1]
            shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            shared = shared[np.lexsort((at[shared], its[shared], key[shared]))]
            again = shared[not_first(key[shared], its[shared], at[shared])]
            done.append((its[again], at[again], at[again] + length))
        its, a, b = merged(*(np.concatenate(x) for x in zip(*done)))
        cut = np.flatnonzero(np.concatenate([[True], its[1:] != its[:-1]])) if len(its) else np.zeros(0, int)
        pairs = np.stack([a, b], axis=1).astype(np.int32)
        return pa.table({
            "doc_id": pa.array(its[cut], pa.int64()),
            "found": pa.array([p.tobytes() for p in np.split(pairs, cut[1:])] if len(cut) else [], pa.binary())})
    return run


def _cut(batches):
    for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
        ids, n_words, n_removed, kept, spans = [], [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            words = (text or "").encode().split()
            span = np.zeros((0, 2), np.int64)
            if found:
                pairs = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 2) for b in found]).astype(np.int64)
                _, a, b = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                span = np.stack([a, b], axis=1)
            left, at = [], 0
            for a, b in span.tolist():
                left += words[at:a]
                at = max(at, min(b, len(words)))
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
            spans.append([{"start": a, "end": b} for a, b in span.tolist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_words", "n_removed", "kept", "intervals"])


# ---- operator ----------------------------------------------------------------

def repeated_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id (null ids as ``NO_ID``), found: packed (start, end) word
    intervals of the repeated windows; a document may have several rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, math.ceil(math.log2(max(1, chars / CHARS_PER_WORD / BUCKET_WINDOWS))))
    packed = rows.mapInArrow(_windows(length, bits), PACKED)
    return packed.groupBy("bucket").applyInArrow(_bucket(length), "doc_id long, found binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words that stay, joined by
    one blank), intervals (maximal removed word intervals)."""
    found = repeated_intervals(docs, length).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list("found").alias("found"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(found, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_id"), "left").drop("_id")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, "
                                 "intervals array<struct<start:long,end:long>>")


def substring_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return remove_repeats(docs, length).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
        F.size("intervals").cast("long").alias("n_intervals"))
