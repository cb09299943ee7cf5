"""Quality by importance resampling: target against raw text, Gumbel top-k.

Two generative models over hashed n-grams, one of target documents and one of
all documents, are counted in Spark; the log importance weight of a document
is the mean log ratio of the two over its n-grams, per ``REFERENCE`` n-grams.
Adding Gumbel noise to it and taking the k largest keys samples k documents
without replacement with probabilities that follow the weights.

* N-grams: words and runs of symbols of the lower-cased text, one by one and
  in pairs; a token that repeats the one before it counts as "again". An
  n-gram that occurs t times in a document counts at its occurrences 1, 2, 4,
  8, ..., as an n-gram of that level, so floods of one word are n-grams of
  their own and do not weigh down the word elsewhere.
* Each n-gram falls into one of ``BUCKETS`` buckets. Both models are arrays of
  that size: tasks send them in slices, slices are added up, and the ratios
  (4 MB each) go to the tasks. Ratios with little evidence (fewer than ``Z``
  standard deviations, or within a factor e of 1) count as 1.
* Harm: a mean over a document hides a few toxic words in a long text. So a
  second ratio, documents labelled toxic against target documents, is summed
  over each ``PASSAGE`` tokens in a row, positive evidence only; a document is
  as harmful as its worst passage. Documents above the harm that ``SAFE`` of
  the target documents stay within are never selected. A target document is
  left out of the counts that judge it.
* Target: labelled rows of quality 1 that are not toxic, at most about
  ``TARGET_DOCS`` of them by a hash of the id. Everything else, raw counts
  above all, covers all documents.
* k: as many documents as reach the weight that ``KEEP`` of the target
  documents reach. The k-th key is found by counting keys in ever narrower
  ranges; the driver sees at most ``CELLS`` counts at a time.

Null and empty texts have no n-grams and are never selected. Without target
documents all weights are 0 and all documents with n-grams are selected;
without toxic ones no document is harmful. A
document that is labelled twice is a target if all its labels say so. Noise
depends on id and text: reruns agree, equal rows are taken or left together,
and so are all rows at the k-th key. Other columns pass through ``select``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import boxed, compact, mixed, ship, split_words, store

ship(__name__)

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
SLICES = 64
TARGET_DOCS = 50_000
PRIOR = 1.0
Z = 3.0
MIN_RATIO = 1.0
SHORT = 50
REFERENCE = 1000.0
KEEP = 0.995
#: Tokens of a passage, and the share of target documents that are not harmful.
PASSAGE = 50
SAFE = 0.995
CELLS = 4096
#: Documents whose n-grams a task holds at a time.
PART_ROWS = 500

#: Documents that are counted: all, target, toxic.
MODELS = ("raw", "target", "toxic")
GOLD = np.uint64(0x9E3779B97F4A7C15)
AGAIN, START = np.uint64(7), np.uint64(1)
TOKEN = re.compile(r"\w+|[^\w\s]+")


# ---- inside tasks ------------------------------------------------------------

def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document of each token, token hash); each distinct word is cut once."""
    import xxhash

    offsets, words = split_words(pc.utf8_lower(compact(texts)))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    coded = pc.dictionary_encode(words)
    cut = [TOKEN.findall(w) or [w] for w in coded.dictionary.to_pylist()]
    size = np.array([len(c) for c in cut])
    first = np.cumsum(size) - size
    table = np.fromiter((xxhash.xxh64_intdigest(t) for c in cut for t in c), np.uint64, count=int(size.sum()))
    code = np.asarray(coded.indices)
    many = size[code]
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[code], many)
    doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offsets)), many)
    return doc, table[place]


def token_buckets(doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and of each with the one before it."""
    opens = np.concatenate([[True], doc[1:] != doc[:-1]])
    same = np.concatenate([[False], token[1:] == token[:-1]]) & ~opens
    token = np.where(same, AGAIN, token)
    before = np.where(opens, START, np.concatenate([[START], token[:-1]]))
    low = np.uint64(BUCKETS - 1)
    return mixed(token) & low, mixed(before * GOLD + token) & low


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each counted n-gram occurrence, by document."""
    doc, token = token_hashes(texts)
    return counted_ngrams(doc, *token_buckets(doc, token)) if len(doc) else (doc, np.zeros(0, np.int64))


def counted_ngrams(doc: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(BUCKETS - 1)
    both = np.concatenate([one, two])
    key = np.sort((np.concatenate([doc, doc]).astype(np.uint64) << np.uint64(BUCKET_BITS)) | both)
    at = np.arange(len(key))
    head = np.concatenate([[True], key[1:] != key[:-1]])
    nth = at - np.maximum.accumulate(np.where(head, at, 0)) + 1
    counted = (nth & (nth - 1)) == 0
    key, nth = key[counted], nth[counted].astype(np.uint64)
    bucket = key & low
    bucket = np.where(nth > 1, mixed(bucket + nth * GOLD) & low, bucket)
    return (key >> np.uint64(BUCKET_BITS)).astype(np.int64), bucket.astype(np.int64)


def _parts(batches, rows: int = PART_ROWS):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _sums(part: int, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), *(pa.array([c.tobytes()]) for c in counts)], names=["part", *MODELS])


def _count(batches):
    sums = [np.zeros(BUCKETS, np.int32) for _ in MODELS]
    for batch in _parts(batches):
        doc, bucket = ngrams(batch.column("text"))
        sums[0] += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
        for total, name in zip(sums[1:], ("wanted", "toxic")):
            mine = np.asarray(batch.column(name).fill_null(False))
            total += np.bincount(bucket[mine[doc]], minlength=BUCKETS).astype(np.int32)
    for part, counts in enumerate(zip(*(np.split(x, SLICES) for x in sums))):
        if counts[0].any():
            yield _sums(part, counts)


def _add(batches):
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            totals = sums.setdefault(r["part"], [np.zeros(BUCKETS // SLICES, np.int64) for _ in MODELS])
            for total, name in zip(totals, MODELS):
                total += np.frombuffer(r[name], np.int32)
    for part, totals in sums.items():
        yield _sums(part, totals)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the target model to the raw one, by bucket."""
    raw, target = raw.astype(np.float64), target.astype(np.float64)
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    sure = (np.abs(ratio) >= MIN_RATIO) & (np.abs(target - expected) >= Z * np.sqrt(expected + 1))
    return np.where(sure, ratio, 0).astype(np.float32)


def harm_ratio(toxic: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the toxic model to the target one, by bucket, where it
    speaks for the toxic one."""
    toxic, target = toxic.astype(np.float64), target.astype(np.float64)
    if not toxic.sum() or not target.sum():
        return np.zeros(len(toxic), np.float32)
    share = toxic.sum() / (toxic.sum() + target.sum())
    expected = (toxic + target) * share
    ratio = np.log((toxic + PRIOR) / (target + PRIOR) * (target.sum() / toxic.sum()))
    sure = (ratio >= MIN_RATIO) & (toxic - expected >= Z * np.sqrt(expected + 1))
    return np.where(sure, ratio, 0).astype(np.float32)


def worst_passages(doc: np.ndarray, evidence: np.ndarray, n: int) -> np.ndarray:
    """Largest sum of ``evidence`` over PASSAGE tokens in a row, by document."""
    out = np.zeros(n)
    if not len(doc):
        return out
    opens = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    first = np.repeat(opens, np.diff(np.append(opens, len(doc))))
    total = np.concatenate([[0], np.cumsum(evidence, dtype=np.float64)])
    at = np.arange(len(doc))
    sums = total[at + 1] - total[np.maximum(first, at + 1 - PASSAGE)]
    out[doc[opens]] = np.round(np.maximum.reduceat(sums, opens), 6)
    return out


def _score(ratio: np.ndarray, harm: np.ndarray, own: np.ndarray):
    """``own``: the harm ratio of n-grams in a target document, without it."""
    def run(batches):
        for batch in _parts(batches):
            doc, token = token_hashes(batch.column("text"))
            worst, bucket = np.zeros(batch.num_rows), np.zeros(0, np.int64)
            if len(doc):
                one, two = token_buckets(doc, token)
                target = np.asarray(batch.column("wanted").fill_null(False))[doc]
                worst = worst_passages(doc, np.where(target, own[one] + own[two], harm[one] + harm[two]),
                                       batch.num_rows)
                doc, bucket = counted_ngrams(doc, one, two)
            n = np.bincount(doc, minlength=batch.num_rows)
            total = np.bincount(doc, weights=ratio[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("wanted"),
                 pa.array(n.astype(np.int64)), pa.array(total / (n + SHORT) * REFERENCE), pa.array(worst)],
                names=["row", "doc_id", "wanted", "n_grams", "log_weight", "harm"])
    return run


# ---- operator ----------------------------------------------------------------

def target_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """doc_id of at most about ``most`` target documents."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
            .where("q = 1 and t = 0").select("doc_id"))
    return _at_most(good, most)


def toxic_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """doc_id of at most about ``most`` documents with a toxic label."""
    return _at_most(labels.where(F.col("doc_id").isNotNull() & (F.col("toxic") == 1)).select("doc_id").distinct(), most)


def _at_most(ids: DataFrame, most: int) -> DataFrame:
    share = min(1.0, most / max(1, ids.count()))
    cells = 1 << 30
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(cells)) < int(share * cells))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, 1 <= k <= rows."""
    x = F.col(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    while low < high:
        cell = F.least(F.lit(CELLS - 1), F.floor((x - low) / (high - low) * CELLS))
        counts = (df.where(x.between(low, high)).groupBy(cell.alias("cell"))
                  .agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
                  .orderBy(F.desc("cell")).collect())  # at most CELLS rows
        for r in counts:
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (hash of id and text), doc_id, wanted, n_grams, log_weight, harm."""
    known = target_ids(labels).withColumn("wanted", F.lit(True)).unionByName(
        toxic_ids(labels).withColumn("wanted", F.lit(False)))  # about 2 x TARGET_DOCS ids, each once
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(known), "doc_id", "left") \
        .select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.expr("nullif(wanted, false)").alias("wanted"),
                (~F.col("wanted")).alias("toxic"), "text")
    schema = "part int, " + ", ".join(f"{m} binary" for m in MODELS)
    sums = (rows.select("wanted", "toxic", "text").mapInArrow(_count, schema)
            .repartition(SLICES, "part").mapInArrow(_add, schema).collect())  # 3 x BUCKETS numbers
    raw, target, toxic = (np.zeros(BUCKETS, np.int64) for _ in MODELS)
    for r in sums:
        at = slice(r.part * (BUCKETS // SLICES), (r.part + 1) * (BUCKETS // SLICES))
        for total, name in zip((raw, target, toxic), MODELS):
            total[at] += np.frombuffer(r[name], np.int64)
    ratios = log_ratio(raw, target), harm_ratio(toxic, target), harm_ratio(toxic, np.maximum(target - 1, 0))
    return store(rows.drop("toxic").mapInArrow(_score(*ratios), (
        f"row long, doc_id {dict(docs.dtypes)['doc_id']}, wanted boolean, n_grams long, log_weight double, "
        "harm double")), "quality-weights")


def harmless(weighted: DataFrame) -> DataFrame:
    """The rows within the harm that ``SAFE`` of the target documents keep to."""
    most = weighted.where("wanted and n_grams > 0").agg(F.percentile("harm", F.lit(SAFE))).first()[0]
    return weighted if most is None else weighted.where(F.col("harm") <= most)


def keys(weighted: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``key``: the log weight plus Gumbel noise drawn from row and seed."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return weighted.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def sample(weighted: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The rows with the k largest keys; k by ``KEEP`` if not given."""
    keyed = store(keys(weighted.where("n_grams > 0"), seed), "quality-keys")
    if k is None:
        cut = keyed.where("wanted").agg(F.percentile("log_weight", F.lit(1 - KEEP))).first()[0]
        k = keyed.where(F.col("log_weight") >= (float("-inf") if cut is None else cut)).count()
    n = keyed.count()
    if k >= n:
        return keyed
    if k < 1:
        return keyed.limit(0)
    return keyed.where(F.col("key") >= kth_largest(keyed, "key", k))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected documents: doc_id, log_weight, key."""
    return sample(harmless(weights(docs, labels))).select("doc_id", "n_grams", "log_weight", "key")


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Selected rows, columns as they came."""
    stay = store(sample(harmless(weights(docs, labels))).select("row").distinct(), "quality-stay")
    rows = docs.select(F.xxhash64("doc_id", F.col("text").cast("string")).alias("row"), boxed(docs).alias("doc"))
    return rows.join(stay, "row", "left_semi").select("doc.*")
