"""Compare a Spark result with its DuckDB oracle (used by tests and scripts).

Rows are compared as multisets after normalization: doubles to 1e-6,
lists element-wise, structs as sorted (key, value) pairs, NaN as null.
"""

from __future__ import annotations

import math

import duckdb

from cwescope.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(cols, records):
    out = [tuple(norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: repr(t))


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return abs(float(a) - float(b)) <= 1e-6 * max(1.0, abs(float(a)), abs(float(b)))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b



SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    return SPARK_TO_DUCK.get(spark_type, spark_type)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal (names, scalar / list column types, rows), else a
    short description of the first difference."""
    srows = [r.asDict(recursive=True) for r in spark_df.collect()]
    scols = sorted(spark_df.columns)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dtypes = {c: str(t) for c, t in zip(dcols, rel.types)}
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    if sorted(dcols) != scols:
        return f"columns spark={scols} duck={sorted(dcols)}"
    for c, t in spark_df.dtypes:
        if "struct" in t or "STRUCT" in dtypes[c]:
            continue
        if duck_type(t) != dtypes[c]:
            return f"type of {c}: spark={t} duck={dtypes[c]}"
    sr, dr = rows_of(scols, srows), rows_of(scols, drows)
    if len(sr) != len(dr):
        return f"rows spark={len(sr)} duck={len(dr)}"
    for x, y in zip(sr, dr):
        if not close(x, y):
            return f"differs: spark={x} duck={y}"
    return None
