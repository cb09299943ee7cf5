"""Harmonic packing of tokenized documents into sequences of fixed capacity.

A document is its ids and one end id. Each task is a worker of its own: it
tokenizes the documents of its partition and packs them while it reads, so
nothing is shuffled and a lost task is repeated from its input.

* Whole capacities are cut from the front, each a full sequence.
* The rest, of length r, belongs to the reciprocal class k = capacity // r, and
  a sequence of class k holds exactly k pieces of that class. A rest that would
  leave more than 1 / ``SLACK`` of its sequence empty is cut first: its head has
  the length capacity // k' of the next class k' = ceil(capacity / r), which
  fills sequences almost wholly, and what remains is classed again. Pieces of at
  most capacity / ``SLACK`` ids are not cut. So each sequence of a class is
  filled by more than (SLACK - 1) / SLACK, and a rest has few pieces.
* At the end of the task the classes' open sequences (fewer than k pieces each)
  are laid end to end and cut into full sequences; the last rest is cut into
  sequences whose lengths are powers of two, which need no padding.

Ids come from a byte-level BPE file of the ``tokenizers`` library. If the
file's ids are the ranks of its merges, the same merges run in ``tiktoken``
(equal ids, a quarter of the time); a text that contains one of the file's
special tokens, and any other kind of file, goes through ``tokenizers`` itself.
A long text is encoded in stretches cut between a letter and a space, where the
file's pattern always splits; its ids are the same, its memory is bounded.

A null text is empty and still has its end id. A null id is packed like any
other. Repeated rows are documents of their own. Columns other than the id and
the text are not read, so their names cannot clash. An empty table packs into
nothing. Sequence numbers are unique, not consecutive: the task's number and a
counter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import ship

ship(__name__)

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
SLACK = 32
END_ID = 0
#: Characters of a text that are encoded at a time.
STRETCH = 1 << 18
FLUSH_PIECES = 4096


# ---- tokens, inside tasks --------------------------------------------------------

#: How the file's byte-level splitter cuts a text (fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: a byte
    that prints stands for itself, the others follow from code point 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes with their ids, if the ids rank the merges; else None."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space")
             and splitter.get("use_regex", True) and not spec.get("normalizer"))
    if not plain:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    to_byte = byte_of_letter()
    return {bytes(to_byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Ids of texts, by the file's text (JSON)."""

    def __init__(self, spec: str):
        import json

        parsed = json.loads(spec)
        self.spec, self.slow = spec, None
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        ranks = merge_ranks(parsed)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.spec)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact(text)
        return np.concatenate([np.array(self.fast.encode_ordinary(part), np.uint32) for part in stretches(text)])


def stretches(text: str) -> list[str]:
    """The text in parts of about ``STRETCH`` characters, cut after a letter
    and before a space."""
    out, at = [], 0
    cut = re.compile(r"[A-Za-z](?= )")
    while len(text) - at > STRETCH:
        found = cut.search(text, at + STRETCH - 1)
        if found is None:
            break
        out.append(text[at:found.end()])
        at = found.end()
    return [*out, text[at:]]


# ---- packing, inside tasks ---------------------------------------------------------

PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def piece_lengths(n: int, capacity: int, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        if r * slack <= capacity or (capacity - k * r) * slack <= capacity:
            out.append(r)
            break
        head = capacity // -(-capacity // r)
        out.append(head)
        r -= head
    return out


class Packer:
    """Sequences of one worker. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, capacity: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        for length in piece_lengths(len(ids), self.capacity):
            piece = (doc_id, start, ids[start:start + length], len(ids))
            start += length
            k = self.capacity // length
            group = self.open.setdefault(k, [])
            # a view would keep the whole document's ids while its piece waits
            group.append(piece if k == 1 else (*piece[:2], piece[2].copy(), piece[3]))
            if len(group) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        """Lays what is open end to end; the last rest ends in powers of two."""
        queue = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in queue)
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        queue.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, total = queue.pop()
                pieces.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    queue.append((doc_id, start + size, ids[size:], total))
                size -= min(size, len(ids))
            self._close(pieces)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [[] for _ in PIECE_SCHEMA]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_SCHEMA.types)],
                                          schema=PIECE_SCHEMA)


def _pack(spec, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        encode = None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            encode = encode or Encoder(spec.value)
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc_id.as_py(), np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) >= FLUSH_PIECES:
                    yield packer.taken()
        packer.finish()
        yield packer.taken()
    return run


# ---- operator --------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start and length in its document, ids
    (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset in the
    sequence. ``tokenizer`` is the path of a ``tokenizers`` file; the driver
    reads it (a few MB) and sends its text to the executors once."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(spec, capacity, end_id), PIECES)


def pack_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``pack`` with a CRC in place of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                        "doc_tokens", "sequence_id", "offset")


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, tokens, padded: one row; a sequence whose length is a power
    of two needs no padding, any other is padded to the capacity."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.bit_count("used") == 1
    return used.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
                    F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("used"))), F.lit(0)).alias("padded"))
