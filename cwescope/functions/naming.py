"""Identifier naming rules as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Naming styles in the order they are tried.
NAMING_PATTERNS = [
    ("snake_case", r"^[a-z]+(_[a-z0-9]+)*$"),
    ("camelCase", r"^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"),
    ("PascalCase", r"^[A-Z][a-z0-9]*([A-Z][a-z0-9]*)*$"),
    ("SCREAMING_SNAKE", r"^[A-Z]+(_[A-Z0-9]+)*$"),
    ("kebab-case", r"^[a-z]+(-[a-z0-9]+)*$"),
    ("lower.dot.case", r"^[a-z]+(\.[a-z0-9]+)*$"),
]

# Placeholder names.
BAD_NAMES = ["temp", "asdf", "foo", "bar", "baz", "data", "value", "val", "thing", "stuff",
             "var", "obj", "x", "y", "z"]

IDENT_RE = r"[A-Za-z_][A-Za-z0-9_]*"
# Identifier pieces and the gaps between them tile the text, so running sums
# of piece lengths give byte offsets.
PIECE_RE = r"[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+"


def naming_convention(name: Column) -> Column:
    """First matching style, else 'unknown'."""
    out = None
    for style, rx in NAMING_PATTERNS:
        c = F.coalesce(name, F.lit("")).rlike(rx)
        out = F.when(c, F.lit(style)) if out is None else out.when(c, F.lit(style))
    return out.otherwise(F.lit("unknown"))


def naming_conventions(name: Column) -> Column:
    """All matching styles in rule order."""
    n = F.coalesce(name, F.lit(""))
    arr = F.array(*[F.when(n.rlike(rx), F.lit(style)) for style, rx in NAMING_PATTERNS])
    return F.filter(arr, lambda x: x.isNotNull())


def bad_name(name: Column) -> Column:
    return name.isin(BAD_NAMES)


def identifier_parts(name: Column) -> Column:
    """Split on '_' or before an upper-case letter; keep parts longer than 1, lower-cased."""
    parts = F.split(F.coalesce(name, F.lit("")), r"_|(?=[A-Z])", -1)
    return F.transform(F.filter(parts, lambda p: F.length(p) > 1), lambda p: F.lower(p))


def meaningful_in(names: DataFrame, words: DataFrame) -> DataFrame:
    """Dictionary rule: (name, meaningful), true if any part of the name is one
    of ``words`` (word, any case). ``names`` (name) has a row per name."""
    known = words.select(F.lower("word").alias("part")).distinct()
    hit = (names.select("name", F.explode(identifier_parts(F.col("name"))).alias("part"))
           .join(known, "part", "left_semi").select("name").distinct().withColumn("_hit", F.lit(True)))
    return names.join(hit, "name", "left").select("name", F.coalesce("_hit", F.lit(False)).alias("meaningful"))


def meaningful_name(name: Column) -> Column:
    """Faithful rule: true if any part (len > 1) is alphabetic."""
    return F.exists(identifier_parts(name), lambda p: p.rlike(r"^\p{L}+$"))
