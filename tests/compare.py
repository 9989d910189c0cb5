"""Compare a Spark result with the DuckDB result of the same query."""

from __future__ import annotations

import datetime
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """``None`` when both hold the same names, value kinds and rows."""
    rel = con.sql(sql)
    want_names, got_names = sorted(rel.columns), sorted(spark_df.columns)
    if want_names != got_names:
        return f"columns {got_names} != {want_names}"
    want = rows_of(rel.columns, rel.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    return None
