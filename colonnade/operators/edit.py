"""Column and cell edits. Each returns a new frame; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import casts
from colonnade.operators import filters as flt
from colonnade.operators.ordered import PLACE, Order, file_slice, with_place
from colonnade.operators.paging import rows
from colonnade.types import LogicalType, check_distinct_names, classify, col, field_type

NULL_MARK = "(null)"
_HEAD_ROWS = 100


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[col(name) for name in columns])


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    field_type(df, old)
    names = [new if name == old else name for name in df.columns]
    check_distinct_names(names)
    return df.withColumnRenamed(old, new)


def hide(df: DataFrame, *columns: str) -> DataFrame:
    return select(df, [name for name in df.columns if name not in columns])


def retype(df: DataFrame, column: str, to: LogicalType, lenient_int: bool = False) -> DataFrame:
    """Cast one column to a logical type; values that do not fit become null."""
    have = classify(field_type(df, column))
    return df.withColumn(column, casts.recast(col(column), have, LogicalType(to), lenient_int))


def empty_columns(df: DataFrame) -> DataFrame:
    """``(column, non_null)`` of every text column, from one pass over the table."""
    text = [f.name for f in df.schema if classify(f.dataType) is LogicalType.STRING]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint")
    counts = df.agg(*[F.count(col(name)).alias(f"c{i}") for i, name in enumerate(text)])
    pairs = [F.struct(F.lit(name).alias("column"), F.col(f"c{i}").alias("non_null"))
             for i, name in enumerate(text)]
    return counts.select(F.inline(F.array(*pairs)))


def find_empty(df: DataFrame) -> list[str]:
    """Names of text columns without any value.

    Most columns show a value in the first rows. Each of the others is searched until
    one is found; Parquet skips row groups that hold none.
    """
    text = [f.name for f in df.schema if classify(f.dataType) is LogicalType.STRING]
    if not text:
        return []
    head = df.select(*[col(name).isNotNull() for name in text]).take(_HEAD_ROWS)
    unseen = [name for i, name in enumerate(text) if not any(row[i] for row in head)]
    return [name for name in unseen if not df.where(col(name).isNotNull()).select(F.lit(1)).take(1)]


def drop_empty(df: DataFrame) -> DataFrame:
    return hide(df, *find_empty(df))


def null_display(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The cells as text with ``(null)`` where there is no value."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[
            F.coalesce(col(name).cast("string"), F.lit(NULL_MARK)).alias(name)
            if name in chosen
            else col(name)
            for name in df.columns
        ]
    )


def edited_value(value, kind: LogicalType) -> Column:
    """A typed literal for what was entered in a cell; null when it does not fit."""
    target = kind.spark_type
    nothing = F.lit(None).cast(target)
    if value is None or str(value) == NULL_MARK:
        return nothing
    if kind in (LogicalType.STRING, LogicalType.EMPTY):
        return F.lit(str(value))
    if isinstance(value, (date, datetime)):
        return F.lit(value.isoformat()[:10]).cast(target) if kind.is_date else nothing
    text = str(value).lower() if isinstance(value, bool) else str(value)
    if not text.strip():
        return nothing
    if kind is LogicalType.DOUBLE:
        return casts.to_double(F.lit(text))
    return casts.recast(F.lit(text), LogicalType.STRING, kind)


def update_cell(
    df: DataFrame,
    row: int,
    column: str,
    value,
    order: Order = (),
    filters: Iterable[flt.Filter] = (),
    key: Sequence[str] = (),
) -> DataFrame:
    """Replace one cell, addressed by its 0-based row in the filtered, ordered view.

    ``key`` names columns that identify a row. Without it the frame must scan
    Parquet files, and a row is identified by its place in its file, which also
    is the order rows have where ``order`` leaves them tied.
    """
    spark_type = field_type(df, column)
    new = edited_value(value, classify(spark_type)).cast(spark_type)
    keyed = df if key else with_place(df)
    names = list(key) or [name for name, _ in PLACE]
    total = [*order, *[(name, True) for name in names]]
    if not key and not order:
        found = file_slice(flt.apply(df, filters), row, 1)
    else:
        seen = [col(name) for name in dict.fromkeys(name for name, _ in total)]
        found = rows(flt.apply(keyed, filters).select(*seen), total, 1, row)
    # A single row, so it is safe to broadcast whatever the size of the table.
    target = found.limit(1).select(
        *[col(name).alias(f"__t{i}") for i, name in enumerate(names)], F.lit(True).alias("__hit")
    )
    match = F.lit(True)
    for i, name in enumerate(names):
        match &= col(name).eqNullSafe(F.col(f"__t{i}"))
    joined = keyed.join(F.broadcast(target), match, "left")
    return joined.select(
        *[
            F.when(F.col("__hit"), new).otherwise(col(name)).alias(name)
            if name == column
            else col(name)
            for name in df.columns
        ]
    )
