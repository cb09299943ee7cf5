"""Spelling variants: words within one edit, by a bit-sliced position index.

Words are runs of letters (ASCII, and code points C0 to FF), A-Z lower-cased;
one occurrence in ``DROP_EVERY`` loses a code point, chosen by a CRC of the
document's id and the run. Words of at least ``MIN_LENGTH`` code points that
occur at least ``MIN_COUNT`` times make the vocabulary, counted in Spark.

Two words within one edit share their first ``HEAD`` or their last ``TAIL`` code
points (an edit cannot touch both: words are long enough). So the vocabulary is
dealt twice, by first and by last code points, into shards; a shard that a
frequent beginning makes large is cut into blocks, and each pair of its blocks
is a group of its own. No pair of words becomes a row.

In a group the index holds, for each (position, letter), the bitset of the words
that have that letter there; words are numbered by falling count. All queries of
one length go through their letters together, and every step updates four
bitsets for all words at once: no error so far, and one error so far by
replacement, by a letter more in the word (positions shifted by 1) or by a
letter less (shifted by -1). Word lengths mask the end. The number of bits is
the number of near words, the lowest bit is the most frequent one.

A pair that shares its first code points counts in a shard of beginnings only;
any other pair in a shard of endings.

A null id counts as an empty string before the colon; a null text has no words.
Repeated rows and repeated ids are rows of their own. Only the id and the text
are read, so other columns cannot clash. An empty table gives no row. Very long
runs are words like any other: blocks are measured in code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import ship, store

ship(__name__)

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DROP_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
HEAD = 3
TAIL = 4
#: Code points per shard, and per block of a large shard.
BLOCK_POINTS = 1 << 16
#: Bits of an index that a task holds at a time, and words of 64 bits per step.
INDEX_BITS = 1 << 27
STEP_WORDS = 1 << 16


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts and how often they occur."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))
    long_runs = F.filter(runs, lambda w: F.length(w) >= min_length)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(long_runs).alias("run")).withColumn("run", F.translate("run", upper, upper.lower()))
    rows = rows.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP_EVERY == 0, cut).otherwise(F.col("run"))
    return (rows.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


# ---- index, inside tasks -------------------------------------------------------------

class PositionIndex:
    """Bitsets over ``words`` (latin-1 bytes), numbered in the given order."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        self.width = (n + 63) // 64
        size = np.array([len(w) for w in words])
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        number = np.repeat(np.arange(n), size)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
        self.keys, row = np.unique(place * 256 + letters, return_inverse=True)
        self.sets = self._bitsets(len(self.keys) + 1, row.reshape(-1), number)  # the last one is empty
        self.lengths, row = np.unique(size, return_inverse=True)
        self.of_length = self._bitsets(len(self.lengths) + 1, row.reshape(-1), np.arange(n))

    def _bitsets(self, rows: int, row: np.ndarray, number: np.ndarray) -> np.ndarray:
        sets = np.zeros((rows, self.width), np.uint64)
        np.bitwise_or.at(sets, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
        return sets

    def at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """Per query: the words with its letter at this place."""
        key = place * 256 + letters
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.sets[np.where(self.keys[row] == key, row, len(self.keys))]

    def long(self, length: int) -> np.ndarray:
        row = np.searchsorted(self.lengths, length)
        return self.of_length[row if row < len(self.lengths) and self.lengths[row] == length else -1]

    def near(self, queries: np.ndarray, same_head: bool, head: int) -> np.ndarray:
        """Bitsets of the words at distance one of each query (a row of
        letters), with the first ``head`` code points in common or without."""
        q, length = queries.shape
        none = np.full((q, self.width), ~np.uint64(0))
        replaced, more, less = (np.zeros((q, self.width), np.uint64) for _ in range(3))
        heads = none
        for i in range(length):
            letters = queries[:, i].astype(np.int64)
            here = self.at(i, letters)
            replaced = (replaced & here) | none
            more = (more | none) & self.at(i + 1, letters)
            less = ((less & self.at(i - 1, letters)) if i else less) | none
            none = none & here
            if i + 1 == head:
                heads = none
            if not (replaced.any() or more.any() or less.any()):
                return np.zeros_like(none)
        found = ((replaced & ~none & self.long(length)) | ((more | none) & self.long(length + 1))
                 | (less & self.long(length - 1)))
        return found & (heads if same_head else ~heads)


def index_blocks(words: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of words whose index stays within ``INDEX_BITS``."""
    out, lo, points = [], 0, 0
    for i, w in enumerate(words):
        if i > lo and (points + len(w)) * (i + 64 - lo) > INDEX_BITS:
            out.append((lo, i))
            lo, points = i, 0
        points += len(w)
    return [*out, (lo, len(words))] if words else []


NEAR = "word string, n_near long, best_n long, best string"
NEAR_SCHEMA = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near_in_group(head: int):
    """Near words of a group's queries among its index words; side 1 is index,
    2 is query, 0 is both."""
    def run(table: pa.Table) -> pa.Table:
        same_head = bool(table.column("head")[0].as_py())
        words, n, side = (table.column(c).to_pylist() for c in ("word", "n", "side"))
        index = sorted((-k, w) for w, k, s in zip(words, n, side) if s != 2)
        coded = [w.encode("latin-1") for _, w in index]
        asked: dict[int, list[str]] = {}
        for w, s in zip(words, side):
            if s != 1:
                asked.setdefault(len(w), []).append(w)
        found: dict[str, list] = {}
        for lo, hi in index_blocks(coded):
            bits = PositionIndex(coded[lo:hi])
            step = max(1, STEP_WORDS // bits.width)
            for length, group in asked.items():
                for at in range(0, len(group), step):
                    some = group[at:at + step]
                    letters = np.frombuffer("".join(some).encode("latin-1"), np.uint8).reshape(len(some), length)
                    near = bits.near(letters, same_head, head)
                    count = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
                    for k in np.flatnonzero(count):
                        word = int(np.flatnonzero(near[k])[0])
                        low = int(near[k, word])
                        first = lo + word * 64 + (low & -low).bit_length() - 1
                        had = found.setdefault(some[k], [0, *index[first]])  # earlier blocks are more frequent
                        had[0] += int(count[k])
        rows = [(w, c, -k, best) for w, (c, k, best) in found.items()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, NEAR_SCHEMA.types)],
                        schema=NEAR_SCHEMA)
    return run


# ---- operator ----------------------------------------------------------------------------

def near_words(vocab: DataFrame, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """word, n_near, best, best_n of the words that have near words; ``vocab``
    is a stored table of word and n, words of at least head + tail code points."""
    total = vocab.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    shards = max(1, -(-total // BLOCK_POINTS))
    key = F.when(F.col("head"), F.substring("word", 1, head)).otherwise(F.expr(f"right(word, {tail})"))
    dealt = (vocab.withColumn("head", F.explode(F.array(F.lit(True), F.lit(False))))
             .withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("long")))
    blocks = F.ceil(F.sum(F.length("word")) / F.lit(BLOCK_POINTS)).alias("blocks")
    dealt = dealt.join(dealt.groupBy("head", "shard").agg(blocks), ["head", "shard"])
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("long")
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def place(index, query, side):
        return F.struct(index.alias("index"), query.alias("query"), F.lit(side).alias("side"))

    rest = F.filter(others, lambda b: b != F.col("own"))
    places = F.concat(F.array(place(F.col("own"), F.col("own"), 0)),
                      F.transform(rest, lambda b: place(F.col("own"), b, 1)),
                      F.transform(rest, lambda b: place(b, F.col("own"), 2)))
    groups = dealt.withColumn("own", own).select("head", "shard", "word", "n", F.explode(places).alias("place"))
    # few bytes and much work: as many tasks as shards, not as the bytes would ask for
    group = ["head", "shard", "index", "query"]
    found = (groups.select("head", "shard", "place.index", "place.query", "place.side", "word", "n")
             .repartition(2 * shards, *group).groupBy(*group).applyInArrow(_near_in_group(head), NEAR))
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.k")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word on the way from form to form (``forms``: word,
    form, without circles). Each round doubles the way that is done."""
    done = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = done.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if done.join(step, "root", "left_semi").isEmpty():
            return done
        done = store(done.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                     "spelling-roots")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = store(vocabulary(docs), "spelling-words")
    near = near_words(vocab)
    takes = F.col("best_n") >= ratio * F.col("n")
    rows = store(vocab.join(near, "word", "left").select(
        "word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best_n")).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
