"""Query registry: key -> (Spark builder, DuckDB oracle SQL).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The
oracle is portable SQL over the driver tables; derived views are inlined
as CTEs (``with_views``). Double columns listed in ``rnd`` are rounded to
9 digits on both sides, since float sums depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_DIGITS = 9

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    build: Builder
    sql: str | None = None
    rnd: tuple[str, ...] = field(default_factory=tuple)

    def spark_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if self.rnd:
            df = df.withColumns({c: F.round(F.col(c), ROUND_DIGITS) for c in self.rnd})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rnd:
            return self.sql.strip()
        repl = ", ".join(f"round({c}, {ROUND_DIGITS}) AS {c}" for c in self.rnd)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql.strip()}\n) q"


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None, rnd: tuple[str, ...] | list[str] = ()):
    """Decorator: ``@register("key", sql, rnd=(...))`` on a builder."""
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Query(fn, sql, tuple(rnd))
        return fn
    return deco
