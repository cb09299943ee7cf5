"""Benchmark decontamination with a positional inverted index.

Words: A-Z become lower case, then runs of ``WORD_CHARS``. A window is
``LENGTH`` consecutive words of an item; an item with fewer words, but not
none, is one window.

* ``build_index`` stores a posting (doc, pos, term) for each document word
  that is a test term, as Parquet in the shared folder. Postings are written
  where they are read: no shuffle.
* ``phrase_matches`` intersects offset-adjusted lists from the rarest terms:
  each window's rarest term proposes places, its second rarest must stand at
  its own offset from there, and only places that pass are compared with all
  words of the item. Consecutive matching words that are at least a window
  long are the matches; every window has such a place, so none is lost.
* ``proximity_matches`` asks only that the two rarest terms of a window stand
  within ``slop`` words of their places relative to each other.

The lists of a document are keyed by ``doc``, a hash of id and text, so rows
that repeat an id stay apart and equal rows share one result. Whatever is
joined to the postings is read from a stored table, so Spark broadcasts it
only when its files are below the session's limit, and splits a hot term
otherwise. DataFrame functions only.

Null or empty texts have no words. Items without words have no windows. An
item with a null id marks words but is not listed. Equal items count by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.llm.common import boxed, store

LENGTH = 10
SLOP = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a text whose A-Z are not lowered yet, and what lies between them.
WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Splitting takes half the time of extracting; ends may be empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def lowered(word: Column) -> Column:
    """A-Z to a-z only. A word that ``lower`` leaves alone has none of them."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, UPPER.lower()))


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


@dataclass
class Index:
    """items: item, item_id, n_words; item_words: item, off, term;
    postings: doc, pos, term (numbers of test terms)."""

    items: DataFrame
    item_words: DataFrame
    postings: DataFrame
    length: int


def build_index(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> Index:
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).distinct()
    items = store(items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words",
                               F.size("words").alias("n_words")).where("n_words > 0"), "index-items")
    tests = items.select("item", F.posexplode("words").alias("off", "word")) \
        .select("item", "off", lowered(F.col("word")).alias("word"))
    terms = store(tests.select("word").distinct()
                  .select("word", F.monotonically_increasing_id().alias("term")), "index-terms")
    item_words = store(tests.join(terms, "word").select("item", "off", "term"), "index-item-words")
    found = docs.select(doc_key().alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    found = found.select("doc", "pos", lowered(F.col("word")).alias("word"))
    postings = store(found.join(terms, "word").select("doc", "pos", "term"), "index-postings")
    return Index(items.drop("words"), item_words, postings, length)


def rarest_pairs(index: Index) -> DataFrame:
    """item, off1, term1, off2, term2: the two rarest terms of each window (the
    same one twice if the window has one word), each pair of places once.
    Windows with a term that no document has are left out."""
    count = index.postings.groupBy("term").agg(F.count("*").alias("cf"))
    placed = index.item_words.join(count, "term", "left").join(index.items, "item")
    size = F.least(F.col("n_words"), F.lit(index.length))
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - size + 1),
                        F.least(F.col("off"), F.col("n_words") - size))
    rows = placed.withColumn("start", F.explode(starts))
    by_rarity = F.sort_array(F.collect_list(F.struct("cf", "off", "term")))
    windows = rows.groupBy("item", "start").agg(
        by_rarity.alias("w"), F.count("cf").alias("known"), F.first(size).alias("size"))
    windows = windows.where(F.col("known") == F.col("size"))
    one, two = F.get("w", F.lit(0)), F.coalesce(F.get("w", F.lit(1)), F.get("w", F.lit(0)))
    return windows.select(
        "item", one["off"].alias("off1"), one["term"].alias("term1"),
        two["off"].alias("off2"), two["term"].alias("term2")).distinct()


def _proposed(index: Index, pairs: DataFrame) -> DataFrame:
    """Places of the rarest terms: doc, at (place of the item's word 0), and the pair."""
    lists = index.postings.withColumnRenamed("term", "term1")
    return lists.join(pairs, "term1").select(
        "doc", (F.col("pos") - F.col("off1")).alias("at"), "item", "off2", "term2")


def _second_lists(index: Index, pairs: DataFrame) -> DataFrame:
    return index.postings.join(pairs.select(F.col("term2").alias("term")).distinct(), "term", "left_semi")


def phrase_matches(index: Index) -> DataFrame:
    """doc, item, item_id, start, end: maximal places at which consecutive
    words of a document are consecutive words of the item, a window or more."""
    pairs = store(rarest_pairs(index), "index-pairs")
    second = _second_lists(index, pairs).select(
        "doc", F.col("pos").alias("pos2"), F.col("term").alias("term2"))
    places = _proposed(index, pairs).withColumn("pos2", F.col("at") + F.col("off2"))
    places = store(places.join(second, ["doc", "pos2", "term2"], "left_semi")
                   .select("doc", "item", "at").distinct(), "index-places")
    at_doc = index.postings.join(places.select("doc").distinct(), "doc", "left_semi")
    asked = places.join(index.item_words, "item").withColumn("pos", F.col("at") + F.col("off"))
    same = asked.join(at_doc, ["doc", "pos", "term"], "left_semi")
    in_order = Window.partitionBy("doc", "item", "at").orderBy("off")
    runs = (same.withColumn("run", F.col("off") - F.row_number().over(in_order))
            .groupBy("doc", "item", "at", "run")
            .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")))
    return (runs.join(index.items, "item")
            .where(F.col("end") - F.col("start") >= F.least(F.col("n_words"), F.lit(index.length)))
            .select("doc", "item", "item_id", "start", "end"))


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """doc, item, item_id, pos1, pos2: the two rarest terms of a window, the
    second at most ``slop`` words from where the window has it."""
    pairs = store(rarest_pairs(index), "index-pairs")
    second = _second_lists(index, pairs).select(
        "doc", F.col("pos").alias("pos2"), F.col("term").alias("term2"),
        F.floor(F.col("pos") / (slop + 1)).alias("cell"))
    places = _proposed(index, pairs).withColumn("want", F.col("at") + F.col("off2"))
    cell = F.floor(F.col("want") / (slop + 1))
    places = places.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = places.join(second, ["doc", "term2", "cell"]).where(
        F.abs(F.col("pos2") - F.col("want")) <= slop)
    return near.join(index.items, "item").select(
        "doc", "item", "item_id", F.col("at").alias("pos1"), "pos2").distinct()


def marked(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (ids, as strings, sorted); a
    column of one of these names in ``docs`` is a ``ValueError``."""
    clash = sorted({"n_words", "n_hit", "hit_items", "_doc"} & set(docs.columns))
    if clash:
        raise ValueError(f"the input already has columns {', '.join(clash)}")
    index = build_index(docs.select("doc_id", "text"), benchmark, length)
    matches = store(phrase_matches(index), "index-matches")
    hit = matches.select("doc", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")) \
        .distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    named = matches.groupBy("doc").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("hit_items"))
    per_doc = hit.join(named, "doc").withColumnRenamed("doc", "_doc")
    none = F.array().cast("array<string>")
    return (docs.withColumn("_doc", doc_key())
            .withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD_CHARS)), F.lit(0)).cast("long"))
            .join(per_doc, "_doc", "left").drop("_doc")
            .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
                          "hit_items": F.coalesce("hit_items", none)}))


def decontam_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = marked(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows without a hit, columns as they came, whatever their names."""
    rows = docs.select("doc_id", "text", boxed(docs).alias("doc"))
    return marked(rows, benchmark, length).where("n_hit = 0").select("doc.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS win
  FROM (SELECT item_id, w, least({LENGTH}, len(w)) AS k,
               unnest(range(0, len(w) - least({LENGTH}, len(w)) + 1)) AS s
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s
        FROM d, (SELECT DISTINCT k FROM iw) ks WHERE len(w) >= k)),
m AS (SELECT doc_id, iw.item_id, dw.k, dw.s FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL)
      GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
