"""Sorting, limits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.ordered import (
    PLACE,
    Order,
    file_slice,
    number_rows,
    sort_columns,
    tie_break,
    with_place,
)
from colonnade.operators.ranks import RankIndex
from colonnade.types import col

DEFAULT_PAGE_SIZE = 1000


def sort(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*sort_columns(order))


def rows(df: DataFrame, order: Order, limit: int = -1, offset: int = -1, index: RankIndex | None = None) -> DataFrame:
    """``limit`` rows after ``offset`` rows of the order; -1 leaves either out.

    Equal rows of the order follow each other by their place in the file, or by a hash of
    the row where there is none, at every depth. So pages never share or leave out rows.
    Without an offset this is a plain sort with a limit; with one, a rank index (``index``, or
    one made for the call) tells which stretch of the order is read.
    """
    start = max(offset, 0)
    if limit < 0 and start == 0:
        return sort(df, order)
    if limit < 0:
        # An offset without a limit would pull every row into one task.
        numbered = number_rows(df, order, "__row_number") if index is None else index.numbered("__row_number")
        return sort(numbered.where(F.col("__row_number") > start).drop("__row_number"), order)
    if start == 0:
        ties = {f"__tie{i}": tie for i, tie in enumerate(tie_break(df))}
        return df.withColumns(ties).orderBy(*sort_columns(order), *[F.col(tie).asc() for tie in ties]).limit(limit).drop(*ties)
    return (index or RankIndex(df, order)).rows(start, limit)


def page(df: DataFrame, order: Order, index: int, size: int = DEFAULT_PAGE_SIZE, ranks: RankIndex | None = None) -> DataFrame:
    """Page ``index`` (0-based). For several pages of a frame make one ``ranks`` and pass it."""
    if size <= 0 or index < 0:
        raise ValueError("page size must be positive and the index not negative")
    return rows(df, order, size, index * size, ranks)


def numbered_page(
    df: DataFrame,
    order: Order,
    index: int,
    size: int = DEFAULT_PAGE_SIZE,
    name: str = "row_number",
) -> DataFrame:
    """A page with the 1-based position of each row in the whole order."""
    # The window has no key, but it only sees the rows of one page.
    place = F.row_number().over(Window.orderBy(*sort_columns(order)))
    return page(df, order, index, size).withColumn(name, F.lit(index * size).cast("bigint") + place)


def file_page(df: DataFrame, index: int, size: int = DEFAULT_PAGE_SIZE, order: Order = ()) -> DataFrame:
    """Page of a (filtered) Parquet scan without a key: rows in file order.

    With ``order`` the place in the file settles the order of equal rows.
    """
    if size <= 0 or index < 0:
        raise ValueError("page size must be positive and the index not negative")
    if order:
        placed = rows(with_place(df), [*order, *PLACE], size, index * size)
    else:
        placed = file_slice(df, index * size, size)
    return placed.select(*[col(name) for name in df.columns])


def page_count(df: DataFrame, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(
        "row_count", F.ceil(F.col("row_count") / F.lit(size)).cast("bigint").alias("page_count")
    )


def top(df: DataFrame, order: Order, k: int) -> DataFrame:
    return rows(df, order, k)


def cell(df: DataFrame, order: Order, row: int, column: str) -> DataFrame:
    """One cell by 0-based row of the order; empty past the last row."""
    if row < 0:
        return df.select(col(column)).where(F.lit(False))
    return rows(df, order, 1, row).select(col(column))
