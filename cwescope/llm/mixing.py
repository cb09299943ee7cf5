"""Mixing sources to target weights with a time-varying curriculum.

1. ``source_targets``: sources weigh 5, 2, 1, repeating by code point (null
   last) and share a budget of ``EXTRA`` times all words. A target stops at
   ``MAX_EPOCHS`` times its source's size; the excess goes to the others by
   weight until none is above, which is one water level over the sources
   ordered by the budget that fills them.
2. ``take``: the documents of a source stand in a fixed pseudo-random order
   (MD5 of the id, then the id) and are read in passes until the target is
   used up, so all but one document of the last pass are whole.
3. ``schedule``: each source has a piecewise-linear weight over training time
   0..1. Its integral, scaled to the target, is the source's cumulative token
   demand; inverting it at the middle of a document's words gives the
   document's training position. Sorting by position orders the mix.

The running sums are two-level (per source and hash bucket, then inside a
bucket), so a source with most of the rows is spread over many tasks. The
number of buckets follows the number of rows and does not change results.

Null or empty texts have size 0 and take nothing. Null sources form one
source, last in order. Rows that repeat an id each take their share, in the
order of their size. Only ``doc_id``, ``source`` and the size column are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwescope.llm.common import store, word_count

WEIGHTS = (5, 2, 1)
EXTRA = 1.5
MAX_EPOCHS = 2
ROWS_PER_BUCKET = 256

#: Weight over training time, by the source's place in ``WEIGHTS``: knots
#: (time, weight). Heavy sources lead, light ones grow towards the end.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)),
)


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def sized(docs: DataFrame) -> DataFrame:
    """row (hash), doc_id, source, size (words)."""
    return docs.select(row_key().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """source, place, weight, source_size, target; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight.cast("long"))
    # sources in the order in which a rising level fills them
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    full = F.lit(float(MAX_EPOCHS)) * F.col("source_size")
    per = (per
           .withColumn("_total", F.sum("source_size").over(everything))
           .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
           .withColumn("_rest", F.sum("weight").over(rest))
           .withColumn("_level", (F.lit(EXTRA) * F.col("_total")
                                  - F.lit(float(MAX_EPOCHS)) * F.col("_full")) / F.col("_rest"))
           # the first source that its level does not fill sets the level of all after it
           .withColumn("_open", F.col("_level") * F.col("weight") <= full)
           .withColumn("_level", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True)
                       .over(Window.orderBy((F.col("source_size") / F.col("weight")),
                                            F.col("source").asc_nulls_last())
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .withColumn("target", F.when(F.col("_level").isNull(), full).otherwise(
               F.least(full, F.col("_level") * F.col("weight")))))
    return per.select("source", "place", "weight", "source_size", "target")


def take(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``before`` (words of the source that precede the document) and
    ``taken`` (words the mix takes, repeats counted)."""
    n = sizes.count()
    digits = min(4, max(1, math.ceil(math.log(max(n / ROWS_PER_BUCKET, 2), 16))))
    rows = sizes.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) \
        .withColumn("_bucket", F.substring("_key", 1, digits))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    offset = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")
                                .rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                             F.coalesce(offset, F.lit(0)).alias("_offset"))
    inside = F.sum("size").over(
        Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("_s"))
                     & (F.col("_bucket") == F.col("_b")))
    t = targets.withColumnRenamed("source", "_t")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_t"))) \
        .withColumn("before", F.col("_offset") + F.col("_inside"))
    words = F.floor("target")
    taken = F.lit(0).cast("long")
    for epoch in range(MAX_EPOCHS):
        left = words - epoch * F.col("source_size") - F.col("before")
        taken = taken + F.least(F.col("size"), F.greatest(left, F.lit(0))).cast("long")
    return rows.select("row", "doc_id", "source", "size", "source_size", "place", "target", "before",
                       taken.alias("taken"))


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of a piecewise-linear weight has reached
    ``share`` (0..1) of its total."""
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, done = None, total
    for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:]))):
        done -= (t1 - t0) * (w0 + w1) / 2
        area = share * F.lit(total) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            t = F.lit(t0) + area / F.lit(w0)
        else:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * area, F.lit(0.0)))
            t = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        out = t if out is None else F.when(share * F.lit(total) <= F.lit(done + (t1 - t0) * (w0 + w1) / 2), t) \
            .otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def schedule(taken: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """Adds ``uses``: for each pass that takes words of the document, its
    number, the words and the training position (0..1)."""
    uses = []
    words = F.floor("target")
    for epoch in range(MAX_EPOCHS):
        start = epoch * F.col("source_size") + F.col("before")
        n = F.least(F.col("size"), F.greatest(words - start, F.lit(0))).cast("long")
        share = (start + n / F.lit(2.0)) / F.greatest(F.col("target"), F.lit(1.0))
        at = inverse_demand(share, schedules[-1])
        for place, knots in reversed(list(enumerate(schedules[:-1]))):
            at = F.when(F.col("place") == place, inverse_demand(share, knots)).otherwise(at)
        uses.append(F.when(n > 0, F.struct(F.lit(epoch).alias("epoch"), n.alias("words"),
                                           at.alias("position"))))
    return taken.withColumn("uses", F.filter(F.array(*uses), lambda u: u.isNotNull()))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: size, source_size, target, taken, uses."""
    sizes = store(sized(docs), "mix-sizes")  # the texts are read once
    return schedule(take(sizes, source_targets(sizes)))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """One row for each use of a document, in training order: the columns of
    ``docs`` with epoch, words and position. Equal rows share their uses."""
    clash = [c for c in ("epoch", "words", "position", "_row", "_uses") if c in docs.columns]
    if clash:
        raise ValueError(f"reserved column names in the input: {clash}")
    used = store(mix(docs).where(F.size("uses") > 0).groupBy(F.col("row").alias("_row"))
                 .agg(F.flatten(F.collect_list("uses")).alias("_uses")), "mix-uses")
    rows = docs.withColumn("_row", row_key()).join(used, "_row").dropDuplicates(["_row"])
    out = rows.select(*docs.columns, F.explode("_uses").alias("_use"))
    return out.select(*docs.columns, "_use.epoch", "_use.words", "_use.position").orderBy("position", "doc_id")


def mix_report(docs: DataFrame) -> DataFrame:
    """The mix, one row per document, sorted by first training position."""
    rows = mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("uses").cast("long").alias("n_uses"),
        F.get("uses", F.lit(0))["position"].alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _inverse_sql(share: str, knots: Sequence[tuple[float, float]]) -> str:
    """``inverse_demand`` as SQL text."""
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, done = None, total
    for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:]))):
        done -= (t1 - t0) * (w0 + w1) / 2
        area = f"({share} * {total!r}::DOUBLE - {done!r}::DOUBLE)"
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            t = f"({t0!r}::DOUBLE + {area} / {w0!r}::DOUBLE)"
        else:
            root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {area}, 0.0::DOUBLE))"
            t = f"({t0!r}::DOUBLE + ({root} - {w0!r}::DOUBLE) / {slope!r}::DOUBLE)"
        top = done + (t1 - t0) * (w0 + w1) / 2
        out = t if out is None else (
            f"CASE WHEN {share} * {total!r}::DOUBLE <= {top!r}::DOUBLE THEN {t} ELSE {out} END")
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {out}))"


_SHARE = "((before + w0 / 2.0::DOUBLE) / greatest(target, 1.0::DOUBLE))"

ORACLE = rf"""
WITH s AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][place + 1] AS weight FROM per),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled,
         CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * filled) / rest AS level FROM f),
o AS (SELECT *, first_value(CASE WHEN level * weight <= 2.0::DOUBLE * source_size THEN level END IGNORE NULLS)
              OVER (ORDER BY source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lvl FROM l),
t AS (SELECT source, source_size, place,
             CASE WHEN lvl IS NULL THEN 2.0::DOUBLE * source_size
                  ELSE least(2.0::DOUBLE * source_size, lvl * weight) END AS target FROM o),
b AS (
  SELECT s.*, t.source_size, t.target, t.place,
         CAST(coalesce(sum(size) OVER (
              PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, CAST(least(size, greatest(floor(target) - before, 0)) AS BIGINT) AS w0,
            CAST(least(size, greatest(floor(target) - source_size - before, 0)) AS BIGINT) AS w1
  FROM b)
SELECT doc_id, size, source_size, target, w0 + w1 AS taken,
       CAST(w0 > 0 AS BIGINT) + CAST(w1 > 0 AS BIGINT) AS n_uses,
       CASE WHEN w0 > 0 THEN CASE place
         WHEN 0 THEN {_inverse_sql(_SHARE, SCHEDULES[0])}
         WHEN 1 THEN {_inverse_sql(_SHARE, SCHEDULES[1])}
         ELSE {_inverse_sql(_SHARE, SCHEDULES[2])} END END AS position
FROM u
"""
