"""Near copies: BagMinHash signatures, bands, exact multiset overlap.

A document is the multiset of its word shingles (``SHINGLE`` consecutive
words, A-Z lowered; a shorter text with words is one shingle). Two documents
are near copies if their weighted Jaccard similarity (sum of the lesser counts
over the sum of the greater ones) is ``MIN_SIMILARITY`` or more; classes are
the connected groups.

1. Equal word sequences are one node (a 64-bit hash of the sequence).
2. BagMinHash (Ertl 2018). The weight axis of a shingle is cut at 1, 2, 4, ...;
   on each interval a Poisson process, seeded by the shingle and the interval,
   throws points (time, weight, register). A document with weight w sees the
   points below w, so its registers, the first times, agree between two
   documents with probability equal to their weighted Jaccard similarity. Only
   points up to the time by which all registers are filled are drawn, about
   ``m (ln m + c)`` of them a document, whatever its length.
3. Nodes that agree in a band of registers share a bucket. Candidates are
   verified bucket by bucket (``components.linked``): a pair needs no check
   once its ends are connected, so a large group costs few checks, and no link
   between candidates is lost.
4. Verification compares the full multisets of shingles.

With 20 bands of 5 registers a pair at similarity 0.8 becomes a candidate
with probability 0.9996. A bucket that stays open after ``STAR_ROUNDS`` rounds
holds many members that resemble each other, but not enough. It is cut into
blocks; each pair of blocks is compared in one task by a product of 0 / 1
matrices (members by shingle occurrences), which returns only links.

Documents without words (null, empty) are alone in their class. Rows that
repeat an id have their own nodes, and the class id is the smallest id of the
class. Null ids come last. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import boxed, compact, mixed, ship, split_words, store, window_hashes, word_hashes
from cwescope.llm.components import linked

ship(__name__)

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Rounds of centres after which an open bucket is compared in blocks.
STAR_ROUNDS = 3
#: Members, and their shingles, in a block of a crowded bucket.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 20
#: Numbers of a matrix of members and shingles that a task holds at a time.
MATRIX = 1 << 24
#: Open pairs per member up to which a bucket is verified pair by pair.
FEW = 4
LAST_ID = (1 << 63) - 1
#: Up to so many ids, 16 bytes each, are broadcast to fetch texts.
BROADCAST_ROWS = 1_000_000

GOLD = np.uint64(0x9E3779B97F4A7C15)
LOW48 = np.uint64((1 << 48) - 1)


# ---- inside tasks ------------------------------------------------------------

def shingles(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """Word offsets, document of each shingle, shingle hashes, word hashes."""
    offsets, words = split_words(pc.ascii_lower(compact(texts)))
    hashes = word_hashes(words)
    size = np.diff(offsets)
    many = np.where(size >= length, size - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), many)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][doc]
    rolled = window_hashes(hashes, length)
    values = rolled[place] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((size > 0) & (size < length))
    if len(short):
        extra = np.array([_whole(hashes[offsets[d]:offsets[d + 1]]) for d in short], np.uint64)
        doc, values = np.concatenate([doc, short]), np.concatenate([values, extra])
    return offsets, doc, mixed(values), hashes


def _whole(hashes: np.ndarray) -> int:
    return int(window_hashes(hashes, len(hashes))[0]) ^ (len(hashes) << 1)


def sequence_hashes(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash of the word sequence of each document (0 without words)."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], size)).astype(np.uint64)
        each = mixed(hashes + place * GOLD)
        out[full] = mixed(np.add.reduceat(each, offsets[:-1][full]) + size[full].astype(np.uint64))
    return out


def _unit(seed: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    bits = mixed(seed + np.uint64((2 * step * int(GOLD)) & ((1 << 64) - 1)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """First point times, (documents, registers). ``weight`` counts >= 1;
    documents without elements keep infinity."""
    first = np.full(n_docs * m, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    streams = []
    low, length = 0, 1
    while len(weight) and (on := weight > low).any():
        d, w = doc[on], weight[on]
        seed = mixed(element[on] + np.uint64((low + 1) * 0xD1342543DE82EF95 & ((1 << 64) - 1)))
        streams.append((d, seed, w - low, np.full(len(d), float(length))))
        low, length = low + length, low + length
    if not streams:
        return first.reshape(n_docs, m)
    d, seed, room, length = (np.concatenate(x) for x in zip(*streams))
    limit = np.zeros(n_docs)
    limit[total > 0] = m / total[total > 0] * (math.log(m) + 7)
    while len(d):
        _throw(first, d, seed, room, length, limit, m)
        open_docs = np.isinf(first.reshape(n_docs, m)).any(axis=1) & (total > 0)
        again = open_docs[d]  # a register is still empty: draw again, for twice as long
        d, seed, room, length = d[again], seed[again], room[again], length[again]
        limit *= 2
    return first.reshape(n_docs, m)


def _throw(first, d, seed, room, length, limit, m) -> None:
    time = -np.log(_unit(seed, 0)) / length
    step = 0
    while True:
        alive = time <= limit[d]
        if not alive.all():
            d, seed, room, length, time = d[alive], seed[alive], room[alive], length[alive], time[alive]
        if not len(d):
            return
        bits = mixed(seed + np.uint64(((2 * step + 1) * int(GOLD)) & ((1 << 64) - 1)))
        register = ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        level = (bits >> np.uint64(32)).astype(np.float64) * 2.0 ** -32 * length
        seen = level < room
        np.minimum.at(first, (d * m + register.astype(np.int64))[seen], time[seen])
        step += 1
        time = time - np.log(_unit(seed, step)) / length


def signatures(doc: np.ndarray, values: np.ndarray, n_docs: int, bands: int, rows: int) -> np.ndarray:
    """Band hashes, (documents, bands)."""
    m = bands * rows
    out = np.zeros((n_docs, bands), np.int64)
    for lo in range(0, n_docs, 1 << 14):  # the document's number fits above 48 bits of hash
        hi = min(n_docs, lo + (1 << 14))
        a, b = np.searchsorted(doc, [lo, hi])
        key = np.sort(((doc[a:b] - lo).astype(np.uint64) << np.uint64(48)) | (values[a:b] & LOW48))
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        weight = np.diff(np.append(head, len(key)))
        key = key[head]
        first = bag_min_hash((key >> np.uint64(48)).astype(np.int64), key & LOW48, weight, hi - lo, m)
        bits = first.view(np.uint64).reshape(hi - lo, bands, rows)
        band = np.zeros((hi - lo, bands), np.uint64)
        for r in range(rows):
            band = mixed(band * GOLD + bits[:, :, r])
        out[lo:hi] = band.view(np.int64)
    return out


def _sign(bands: int, rows: int):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                offsets, doc, values, hashes = shingles(batch.column("text"))
                order = np.argsort(doc, kind="stable")
                marks = signatures(doc[order], values[order], batch.num_rows, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"),
                     pa.array(sequence_hashes(offsets, hashes).view(np.int64)),
                     pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, batch.num_rows * bands + 1, bands, dtype=np.int32),
                                              pa.array(marks.reshape(-1)))],
                    names=["doc_id", "row", "node", "n_shingles", "bands"])
    return run


def _own_node(batches):
    """Rows (node, text) whose text is the node's."""
    for batch in batches:
        offsets, words = split_words(pc.ascii_lower(compact(batch.column("text"))))
        found = sequence_hashes(offsets, word_hashes(words)).view(np.int64)
        yield batch.filter(pa.array(found == np.asarray(batch.column("node"))))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays of hashes."""
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    in_a = np.zeros(len(both), np.int64)
    np.add.at(in_a, np.searchsorted(both, a), 1)
    less = np.minimum(in_a, counts - in_a).sum()
    return float(less) / (len(a) + len(b) - less)


def _verify(least: float):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                batch = whole.slice(lo, 100)
                pair = [shingles(batch.column(c)) for c in ("x", "y")]
                parts = []
                for _, doc, values, _ in pair:
                    order = np.argsort(doc, kind="stable")
                    parts.append(np.split(values[order], np.searchsorted(doc[order], np.arange(1, batch.num_rows))))
                good = [overlap(a, b) >= least - 1e-12 for a, b in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "similar"])
    return run


def _occurrences(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets: the k-th occurrence of a shingle in a document is an
    element of its own. (document, element), by document."""
    by = np.lexsort((values, doc))
    doc, values = doc[by], values[by]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(head)
    k = np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))
    return doc, mixed(values + k.astype(np.uint64) * GOLD)


def similar_members(texts: pa.Array, least: float) -> np.ndarray:
    """Which members are similar, as a matrix."""
    n = len(texts)
    _, doc, values, _ = shingles(texts)
    doc, element = _occurrences(doc, values)
    size = np.bincount(doc, minlength=n)
    names, code, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count > 1  # others add nothing to an overlap
    place = np.cumsum(shared) - 1
    on = shared[code]
    doc, column = doc[on], place[code[on]]
    both = np.zeros((n, n), np.float32)
    step = max(1, MATRIX // max(n, 1))
    by = np.argsort(column, kind="stable")
    doc, column = doc[by], column[by]
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n, step), np.float32)
        part[doc[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    return both >= (least - 1e-9) * (size[:, None] + size[None, :] - both)


def _block_links(least: float):
    """Links that connect the similar members of two blocks of a bucket (of
    one, where i = j) whose roots differ."""
    def run(table: pa.Table) -> pa.Table:
        node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        alike = similar_members(table.column("text").combine_chunks(), least)
        if table.column("i")[0] != table.column("j")[0]:
            alike &= own[:, None] != own[None, :]
        alike &= root[:, None] != root[None, :]
        names, group = np.unique(root, return_inverse=True)
        group = group.reshape(-1).copy()
        links = []
        for x, y in np.argwhere(np.triu(alike, 1)):
            if group[x] != group[y]:
                links.append((min(node[x], node[y]), max(node[x], node[y])))
                group[group == group[y]] = group[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return run


# ---- operator ----------------------------------------------------------------

def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text for the wanted nodes (node, first_id), from a row that has them."""
    wanted = wanted.select("node", F.col("first_id").alias("_id"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), "text")
    rows = rows.where(F.col("text").isNotNull()).join(wanted, "_id").select("node", "text")
    return store(rows.mapInArrow(_own_node, "node long, text string").dropDuplicates(["node"]), "near-texts")


def classes(docs: DataFrame, least: float = MIN_SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, class_id, kept (the first
    of its class): one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(
        _sign(bands, rows), "doc_id long, row long, node long, n_shingles long, bands array<long>"), "near-signed")
    rank = F.coalesce("doc_id", F.lit(LAST_ID))
    nodes = store(signed.where("n_shingles > 0").groupBy("node").agg(
        F.min(rank).alias("first_id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")),
        "near-nodes")
    each = nodes.select("node", F.posexplode("bands").alias("band", "value")) \
        .select("node", F.xxhash64("band", "value").alias("bucket"))
    many = store(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-buckets")
    members = store(each.join(many, "bucket"), "near-members")

    texts = _texts(docs, store(members.select("node").distinct().join(nodes, "node"), "near-wanted"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b"))
        return both.mapInArrow(_verify(least), "a long, b long, similar boolean")

    sizes = nodes.select("node", "n_shingles")

    def resolve(crowded: DataFrame) -> DataFrame:
        """Links of crowded buckets, compared block by block."""
        sized = crowded.join(sizes, "node")
        blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_NODES), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)))
        per = sized.groupBy("bucket").agg(blocks.alias("blocks"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
        pairs = F.transform(every, lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
        rows = sized.join(per, "bucket").withColumn("own", own).select("bucket", "node", "root", "own",
                                                                       F.explode(pairs).alias("pair"))
        rows = rows.join(texts, "node").select("bucket", "pair.i", "pair.j", "own", "node", "root", "text")
        return rows.groupBy("bucket", "i", "j").applyInArrow(_block_links(least), "a long, b long").distinct()

    roots = linked(members, verify, FEW, resolve, STAR_ROUNDS)
    named = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    first = store(named.groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("f")), "near-classes")
    named = store(named.join(first, "root").select(
        "node", F.col("f.first_id").alias("class_id"), F.col("f.node").alias("lead")), "near-named")
    out = signed.select("doc_id", "row", "node", "n_shingles").join(named, "node", "left")
    worded = F.col("n_shingles") > 0
    kept = ~worded | ((F.col("node") == F.col("lead")) & (rank == F.col("class_id")))
    return out.select(
        "doc_id", "row", "n_shingles",
        F.when(~worded, F.col("doc_id")).when(F.col("class_id") != LAST_ID, F.col("class_id")).alias("class_id"),
        kept.alias("kept"))


def near_report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_shingles", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; rows
    that repeat that id and text stay once. Documents without words all stay."""
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stay = store(classes(docs).where("kept").select("row", (F.col("n_shingles") > 0).alias("worded")).distinct(),
                 "near-stay")
    # the table's own columns are one struct here, so no name can clash
    rows = docs.select(row.alias("row"), boxed(docs).alias("doc"))
    kept = rows.join(stay, "row")
    return (kept.where("worded").dropDuplicates(["row"])
            .unionByName(kept.where(~F.col("worded"))).select("doc.*"))
