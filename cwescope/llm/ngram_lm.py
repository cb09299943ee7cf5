"""LM scoring with Elias-Fano bigram tries.

Model: log10 p(w | v) with Dirichlet smoothing,

    p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU),
    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1)),

over words and one end per document; the end also stands before the first
word. Probabilities are quantised: p(w) to 1/``P_STEPS`` of a decade, those of
the stored pairs to one byte per trie. A pair that was not seen backs off to
MU / (c(v) + MU) p(w). A text's score is the sum over its words and its end.

1. Tasks turn documents into chunks of about ``CHUNK_WORDS`` words: a table of
   word hashes and the documents as numbers into it, stored once.
2. Each chunk sends its distinct words and their training counts, packed, to
   buckets by hash. A bucket adds up the counts, numbers its words, and answers
   each chunk in the order it asked. Sums over the buckets give N and V.
3. Each chunk, joined with its answers, computes the base score and the score
   as if no pair had been seen, and sends its distinct known pairs to shards by
   context. A context with a large share of all words goes to several shards
   by successor, so the most frequent word is spread out.
4. A shard adds up the pair counts of all chunks, builds its trie in
   memory-mapped files (contexts, monotone pointers, successors relative to the
   context before, one byte each), and looks up the pairs of all chunks by
   successor search. What the seen pairs add to each document goes back to the
   chunk, which sums it up.

What moves grows with the text: nothing of the corpus passes through the
driver but N and V. Words are known by a 64-bit hash.

Training rows: crc32 of the id as text modulo 5 is not 1; a null id trains.
Null and empty texts are one end. Rows that repeat are documents of their own.
Other columns are not read. Without training rows all counts are 0.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import compact, mixed, ship, split_words, store, word_hashes
from cwescope.llm.eliasfano import BigramTrie

ship(__name__)

CHUNK_WORDS = 2_000_000
CHARS_PER_WORD = 6
#: Words and pairs per bucket and shard.
BUCKET_CHARS = 1 << 24
MU = 50.0
P_STEPS = 16
END = 0x9E3779B97F4A7C15
GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- packing, inside tasks -----------------------------------------------------

def squeezed(x: np.ndarray, width: int) -> bytes:
    """Byte planes of the low ``width`` bytes, compressed."""
    planes = np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(len(x), 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def spread(b: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(b, decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


CHUNK = "chunk long, n_docs long, n_words long, n_tokens long, ids binary, valid binary, held binary, " \
        "sizes binary, hashes binary, codes binary"
CHUNK_SCHEMA = pa.schema([(n, pa.int64()) for n in ("chunk", "n_docs", "n_words", "n_tokens")] + [
    (n, pa.binary()) for n in ("ids", "valid", "held", "sizes", "hashes", "codes")])


def _chunk_row(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    columns = [pa.chunked_array([p.column(c) for p in parts]).combine_chunks() for c in ("doc_id", "held", "text")]
    ids, held, texts = columns
    offsets, words = split_words(pc.ascii_lower(compact(texts)))
    hashes = word_hashes(words)
    del words
    size = np.diff(offsets) + 1
    tokens = np.full(size.sum(), END, np.uint64)
    last = np.cumsum(size) - 1
    inside = np.ones(len(tokens), bool)
    inside[last] = False
    tokens[inside] = hashes
    names, codes, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    valid = np.asarray(ids.is_valid())
    return _batch(CHUNK_SCHEMA, [(
        number, len(ids), len(names), len(tokens),
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
        valid.astype(np.uint8).tobytes(), np.asarray(held.fill_null(False)).astype(np.uint8).tobytes(),
        size.astype(np.int64).tobytes(), names[order].tobytes(), squeezed(rank[codes.reshape(-1)], 4))])


def _chunks(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    parts, words = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            parts.append(part)
            words += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if words >= CHUNK_WORDS * CHARS_PER_WORD:
                yield _chunk_row(number, parts)
                number, parts, words = number + 1, [], 0
    if parts:
        yield _chunk_row(number, parts)


class Chunk:
    def __init__(self, r: dict):
        self.number, self.n_docs = r["chunk"], r["n_docs"]
        self.ids = np.frombuffer(r["ids"], np.int64)
        self.valid = np.frombuffer(r["valid"], np.uint8).astype(bool)
        self.held = np.frombuffer(r["held"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(r["sizes"], np.int64)
        self.hashes = np.frombuffer(r["hashes"], np.uint64)
        self.codes = spread(r["codes"], 4, r["n_tokens"])
        self.doc = np.repeat(np.arange(self.n_docs), self.sizes)


# ---- words -----------------------------------------------------------------------

ASK = "bucket int, chunk long, n long, hashes binary, counts binary"
ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()),
                        ("hashes", pa.binary()), ("counts", pa.binary())])


def _ask_words(bits: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r)
                counts = np.bincount(c.codes[~c.held[c.doc]], minlength=len(c.hashes))
                order = np.argsort(c.hashes)
                hashes, counts = c.hashes[order], counts[order]
                cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                rows = [(b, c.number, len(h), h.tobytes(), squeezed(n, 4)) for b, (h, n) in enumerate(
                    zip(np.split(hashes, cuts), np.split(counts, cuts))) if len(h)]
                yield _batch(ASK_SCHEMA, rows)
    return run


ANSWER = "bucket int, chunk long, n long, counts binary, numbers binary, total long, distinct long"


def _answer_words(bits: int):
    """Adds up one bucket; a word's number is its rank there and the bucket."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        counts = np.concatenate([spread(r["counts"], 4, r["n"]) for r in rows])
        names, code = np.unique(hashes, return_inverse=True)
        sums = np.bincount(code.reshape(-1), weights=counts, minlength=len(names)).astype(np.int64)
        order = np.argsort(-sums, kind="stable")
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        number = (number << bits) | rows[0]["bucket"]
        out, at = [], 0
        for k, r in enumerate(rows):
            own = code.reshape(-1)[at:at + r["n"]]
            at += r["n"]
            out.append({"bucket": r["bucket"], "chunk": r["chunk"], "n": r["n"],
                        "counts": squeezed(sums[own], 6), "numbers": squeezed(number[own], 5),
                        "total": int(sums.sum()) if k == 0 else 0, "distinct": int((sums > 0).sum()) if k == 0 else 0})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()),
            ("numbers", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())]))
    return run


# ---- pairs -------------------------------------------------------------------------

PAIRS = "shard int, chunk long, n long, m long, k long, context binary, context_count binary, follow binary, " \
        "word binary, p_code binary, trained binary, uses binary, docs binary, doc_uses binary, base binary"
PAIRS_SCHEMA = pa.schema([("shard", pa.int32())] + [(n, pa.int64()) for n in ("chunk", "n", "m", "k")] + [
    (n, pa.binary()) for n in ("context", "context_count", "follow", "word", "p_code", "trained", "uses",
                               "docs", "doc_uses", "base")])
DIGEST = np.dtype([("id", np.int64), ("valid", np.bool_), ("held", np.bool_), ("n_tokens", np.int64),
                   ("n_known", np.int64), ("base", np.float64), ("score", np.float64)])


def p_codes(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """Quantised -log10 p(w)."""
    p = (counts + 0.5) / (n + 0.5 * (v + 1))
    return np.rint(-np.log10(p) * P_STEPS).astype(np.int64)


def back_off(counts: np.ndarray) -> np.ndarray:
    return np.log10(MU / (counts + MU))


def _ask_pairs(bits: int, n_shards: int, n: int, v: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _pairs_of(Chunk(r), r["answers"], bits, n_shards, n, v)
    return run


def _pairs_of(c: Chunk, answers: list[dict], bits: int, n_shards: int, n: int, v: int):
    answers = sorted(answers, key=lambda a: a["bucket"])
    order = np.argsort(c.hashes)
    counts, number = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    counts[order] = np.concatenate([spread(a["counts"], 6, a["n"]) for a in answers])
    number[order] = np.concatenate([spread(a["numbers"], 5, a["n"]) for a in answers])
    p_code = p_codes(counts, n, v)
    first = np.cumsum(c.sizes) - c.sizes
    end = c.codes[first[0] + c.sizes[0] - 1]
    before = np.concatenate([[end], c.codes[:-1]])
    before[first] = end
    digest = np.zeros(c.n_docs, DIGEST)
    digest["id"], digest["valid"], digest["held"], digest["n_tokens"] = c.ids, c.valid, c.held, c.sizes
    exact = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
    digest["base"] = np.add.reduceat(exact[c.codes], first)
    digest["n_known"] = np.add.reduceat((counts > 0)[c.codes].astype(np.int64), first)
    digest["score"] = np.add.reduceat(back_off(counts)[before] - p_code[c.codes] / P_STEPS, first)
    yield _batch(PAIRS_SCHEMA, [(int(c.number % n_shards), c.number, 0, 0, 0, *[None] * 9, digest.tobytes())])

    # pairs of known words; only these can have been seen
    known = (counts[before] > 0) & (counts[c.codes] > 0)
    a, b, doc = before[known], c.codes[known], c.doc[known]
    parts = 1 + counts * n_shards * 4 // max(n, 1)  # shards over which a context spreads
    salt = mixed(number.astype(np.uint64))[b] % parts[a].astype(np.uint64)
    shard = (mixed(number.astype(np.uint64)[a] + salt * GOLD) % np.uint64(n_shards)).astype(np.int64)
    del known, salt
    by = np.lexsort((doc, number[b], number[a], shard))
    a, b, doc, shard = a[by], b[by], doc[by], shard[by]
    del by
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    pair = np.cumsum(head) - 1
    use = head | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(a) else head  # one per pair and document
    trained = np.bincount(pair, weights=~c.held[doc], minlength=int(head.sum())).astype(np.int64)
    at = np.flatnonzero(use)
    doc_uses = np.diff(np.append(at, len(a)))
    doc, pair_of_use = doc[at], pair[at]
    uses = np.bincount(pair_of_use, minlength=len(trained))
    a, b, shard = a[head], b[head], shard[head]
    cuts = np.searchsorted(shard, np.arange(n_shards + 1))
    use_cuts = np.searchsorted(pair_of_use, cuts)
    for s in range(n_shards):
        lo, hi = cuts[s], cuts[s + 1]
        if lo == hi:
            continue
        left, right = a[lo:hi], b[lo:hi]
        top = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        docs = slice(use_cuts[s], use_cuts[s + 1])
        context = number[left[top]]
        yield _batch(PAIRS_SCHEMA, [(
            s, c.number, len(top), hi - lo, docs.stop - docs.start,
            squeezed(np.diff(context, prepend=0), 5), squeezed(counts[left[top]], 6),
            squeezed(np.diff(np.append(top, hi - lo)), 4), squeezed(number[right], 5),
            squeezed(p_code[right], 2), squeezed(trained[lo:hi], 4), squeezed(uses[lo:hi], 4),
            squeezed(doc[docs], 4), squeezed(doc_uses[docs], 4), None)])


GAIN = "chunk long, k long, docs binary, gains binary, base binary"
GAIN_SCHEMA = pa.schema([("chunk", pa.int64()), ("k", pa.int64()), ("docs", pa.binary()),
                         ("gains", pa.binary()), ("base", pa.binary())])


def _score_shard(table: pa.Table) -> pa.Table:
    """Builds the shard's trie and answers its chunks."""
    rows, out = [], []
    for r in table.to_pylist():
        if r["base"] is not None:
            out.append((r["chunk"], 0, b"", b"", r["base"]))
        else:
            context = np.cumsum(spread(r["context"], 5, r["n"]))
            r |= {"context": context, "context_count": spread(r["context_count"], 6, r["n"]),
                  "follow": spread(r["follow"], 4, r["n"]), "word": spread(r["word"], 5, r["m"]),
                  "p_code": spread(r["p_code"], 2, r["m"])}
            rows.append(r)
    if rows:
        context = np.concatenate([np.repeat(r["context"], r["follow"]) for r in rows])
        word = np.concatenate([r["word"] for r in rows])
        count = np.concatenate([spread(r["trained"], 4, r["m"]) for r in rows])
        of_context = np.concatenate([np.repeat(r["context_count"], r["follow"]) for r in rows])
        p_code = np.concatenate([r["p_code"] for r in rows])
        by = np.lexsort((word, context))
        head = np.concatenate([[True], (context[by][1:] != context[by][:-1]) | (word[by][1:] != word[by][:-1])])
        at = np.flatnonzero(head)
        count = np.add.reduceat(count[by], at)
        kept = by[at][count > 0]
        count = count[count > 0]
        p = 10.0 ** (-p_code[kept] / P_STEPS)
        log_prob = np.log10((count + MU * p) / (of_context[kept] + MU))
        context, word = context[kept], word[kept]
        del by, head, of_context, p_code
        with tempfile.TemporaryDirectory() as folder:
            trie = BigramTrie(context, word, log_prob, folder)
            for r in rows:
                found = trie.query(r["context"], r["follow"], r["word"])
                unseen = np.repeat(back_off(r["context_count"]), r["follow"]) - r["p_code"] / P_STEPS
                gain = np.where(np.isnan(found), 0.0, found - unseen)
                doc = spread(r["docs"], 4, r["k"])
                each = np.repeat(gain, spread(r["uses"], 4, r["m"])) * spread(r["doc_uses"], 4, r["k"])
                total = np.bincount(doc, weights=each)
                docs = np.flatnonzero(total)
                if len(docs):
                    out.append((r["chunk"], len(docs), squeezed(np.diff(docs, prepend=0), 4),
                                total[docs].tobytes(), None))
            del trie
    return pa.Table.from_batches([_batch(GAIN_SCHEMA, out)] if out else [], schema=GAIN_SCHEMA)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sum_chunk(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    digest = np.frombuffer(next(r["base"] for r in rows if r["base"] is not None), DIGEST).copy()
    for r in rows:
        if r["base"] is None:
            docs = np.cumsum(spread(r["docs"], 4, r["k"]))
            digest["score"][docs] += np.frombuffer(r["gains"], np.float64)
    return pa.table({
        "doc_id": pa.array(digest["id"], pa.int64(), mask=~digest["valid"]), "held_out": pa.array(digest["held"]),
        "n_tokens": pa.array(digest["n_tokens"]), "n_known": pa.array(digest["n_known"]),
        "base_score": pa.array(digest["base"]), "score": pa.array(digest["score"])})


# ---- operator -------------------------------------------------------------------------

def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, chars / BUCKET_CHARS))))
    chunks = store(rows.mapInArrow(_chunks, CHUNK), "lm-chunks")
    answers = store(chunks.mapInArrow(_ask_words(bits), ASK).groupBy("bucket").applyInArrow(
        _answer_words(bits), ANSWER), "lm-words")
    n, v = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    per_chunk = answers.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "n", "counts", "numbers")).alias("answers"))
    asked = chunks.join(per_chunk.hint("shuffle_hash"), "chunk").mapInArrow(_ask_pairs(bits, 1 << bits, n, v), PAIRS)
    gains = asked.groupBy("shard").applyInArrow(_score_shard, GAIN)
    return gains.groupBy("chunk").applyInArrow(_sum_chunk, RESULT).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score")
