"""Exact comparison of a Spark result with its oracle SQL on DuckDB."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def problem(df, con, sql: str) -> tuple[str | None, int]:
    """What differs, or ``None``; and the number of rows."""
    cols, got = spark_rows(df)
    rel = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in rel.description}
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(got)} vs {len(want)} rows, {len(diff)} differ: {str(diff[:2])[:900]}", len(got)
    odd = [f"{c}: {t} vs {kinds[c]}" for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]]
    return ("types " + ", ".join(odd) if odd else None), len(got)
