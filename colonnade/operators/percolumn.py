"""The same aggregates over many columns, in one scan and a plan of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_columns(
    df: DataFrame,
    cells: Mapping[str, Column],
    aggregates: Callable[[Column], Mapping[str, Column]],
    prepare: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(ordinal, column, <aggregates>)``, one row per entry of ``cells``.

    ``cells`` are expressions of one type. Rows turn into (ordinal, value) pairs that
    are aggregated before they leave their task. Aggregating hundreds of columns side
    by side instead makes generated code too large for the JVM to compile.
    """
    pairs = [
        F.struct(F.lit(i).alias("ordinal"), value.alias("x"))
        for i, value in enumerate(cells.values())
    ]
    made = (
        df.select(F.inline(F.array(*pairs)))
        .select("ordinal", F.col("x") if prepare is None else prepare(F.col("x")).alias("x"))
        .groupBy("ordinal")
        .agg(*[value.alias(name) for name, value in aggregates(F.col("x")).items()])
    )
    # A table without rows still gets a row per column.
    labels = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"))
        for i, name in enumerate(cells)
    ]
    every = df.sparkSession.range(1).select(F.inline(F.array(*labels)))
    # At most one row per column.
    return every.join(F.broadcast(made), "ordinal", "left")
