"""Whole-column statistics that need more than one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import aggregates as agg
from colonnade.operators.heavy import frequent
from colonnade.operators.percolumn import aggregate_columns
from colonnade.operators.quantiles import date_median
from colonnade.types import LogicalType, col, field_type, is_nested, require, require_numeric

# Fixed value: longer category lists are reported by their number only.
MENU_CATEGORIES = 25
# Columns whose distinct values are counted together.
DISTINCT_GROUP = 8


def numeric_statistics(
    df: DataFrame, columns: Sequence[str], statistics: Sequence[str] | None = None
) -> DataFrame:
    """``(column, statistic, value)`` for any of ``aggregates.NUMERIC``, in one scan."""
    names = list(agg.NUMERIC if statistics is None else statistics)
    for name in columns:
        require_numeric(df, name)
    cells = {name: col(name).cast("double") for name in columns}
    made = aggregate_columns(
        df, cells, lambda x: {name: agg.NUMERIC[name](x).cast("double") for name in names}
    )
    counts = [name for name in names if name in ("count", "null_count")]
    return made.fillna(0.0, counts).unpivot("column", names, "statistic", "value")


def whole_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, statistic, value)``: exact min, max, range and sum of whole-number columns.

    Values are 38-digit decimals, where :func:`numeric_statistics` gives doubles, which
    round whole numbers beyond 2**53.
    """
    for name in columns:
        require(df, name, LogicalType.INTEGER)
    cells = {name: col(name).cast("decimal(19,0)") for name in columns}
    wide = "decimal(38,0)"
    made = aggregate_columns(
        df,
        cells,
        lambda x: {
            "min": F.min(x).cast(wide),
            "max": F.max(x).cast(wide),
            "range": (F.max(x) - F.min(x)).cast(wide),
            "sum": F.sum(x).cast(wide),
        },
    )
    return made.unpivot("column", ["min", "max", "range", "sum"], "statistic", "value")


def mean_absolute_deviation(df: DataFrame, column: str) -> DataFrame:
    """Mean distance from the mean. The mean is a scalar subquery, not a window."""
    require_numeric(df, column)
    mean = df.agg(F.avg(col(column))).scalar()
    return df.agg(F.avg(F.abs(col(column) - mean)).alias("mad"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """``(value, frequency)`` of the present values, unordered."""
    field_type(df, column)
    present = df.where(col(column).isNotNull())
    return present.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("frequency"))


def frequency_distribution(df: DataFrame, column: str) -> DataFrame:
    """Most frequent first; equal frequencies by value."""
    return frequencies(df, column).orderBy(F.desc("frequency"), F.asc("value"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their frequencies; equal frequencies by value.

    Two scans that shuffle next to nothing where a sketch proves the answer, see
    :mod:`colonnade.operators.heavy`; else the column is grouped.
    """
    if k < 1:
        raise ValueError("at least one value must be asked for")
    proved = frequent(df, column, k)
    return frequency_distribution(df, column).limit(k) if proved is None else proved


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of them when several tie."""
    return top_values(df, column, 1)


def entropy(df: DataFrame, column: str, base: float = 10.0) -> DataFrame:
    """Shannon entropy of a text column's values."""
    require(df, column, LogicalType.STRING)
    counted = frequencies(df, column)
    return counted.agg(agg.entropy_of_counts(F.col("frequency"), base).alias("entropy"))


def categories(df: DataFrame, column: str) -> DataFrame:
    """The distinct present values in ascending order."""
    require(df, column, LogicalType.STRING, LogicalType.BOOLEAN)
    present = df.select(col(column).alias("category")).where("category is not null")
    return present.distinct().orderBy("category")


def has_categories(df: DataFrame, column: str) -> DataFrame:
    """Whether values repeat: more than none and fewer than there are rows."""
    require(df, column, LogicalType.STRING, LogicalType.BOOLEAN)
    return (
        df.groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count("value").alias("distinct_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))
        .select(
            "distinct_count",
            "row_count",
            ((F.col("distinct_count") > 0) & (F.col("distinct_count") < F.col("row_count"))).alias(
                "has_categories"
            ),
        )
    )


def category_menu(df: DataFrame, column: str, most: int = MENU_CATEGORIES) -> tuple[list[str] | None, int]:
    """The categories when there are at most ``most``, else None; and their number.

    An empty list so says that there are none, None that there are too many for a menu;
    :func:`categories` gives any number of them as a frame.
    """
    found = categories(df, column)
    head = found.limit(most + 1).collect()
    if len(head) <= most:
        return [row["category"] for row in head], len(head)
    return None, found.count()


# --- counts of many columns at once ---------------------------------------------


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column, row_count, non_null, distinct_count)`` for each column.

    Exact counts group the distinct values of a few columns at a time, each group
    reading its own columns, so that neither plans nor rows grow with wide tables.
    ``approx`` counts all columns in one pass without a shuffle of values.
    """
    for name in columns:
        if is_nested(field_type(df, name)):
            raise ValueError(f"column {name!r} is nested and has no distinct count")
    width = len(columns) if approx else DISTINCT_GROUP
    count = F.approx_count_distinct if approx else F.count_distinct
    groups = [columns[i : i + width] for i in range(0, len(columns), width)]
    return reduce(DataFrame.unionAll, [_distinct_group(df, group, count) for group in groups])


def _distinct_group(df, columns, count) -> DataFrame:
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[count(col(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows").alias("row_count"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"d{i}").alias("distinct_count"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*cells)))


def null_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, non_null, null_count, null_rate)`` in one scan."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    cells = []
    for i, c in enumerate(columns):
        missing = F.col("rows") - F.col(f"n{i}")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("non_null"),
                missing.alias("null_count"),
                F.try_divide(missing.cast("double"), F.col("rows")).alias("null_rate"),
            )
        )
    return row.select(F.inline(F.array(*cells)))


def date_statistics(df: DataFrame, column: str, **options) -> DataFrame:
    """Earliest, latest and median time of one column, as timestamps without zone."""
    require(df, column, LogicalType.DATE)
    c = col(column).cast("timestamp_ntz")
    ends = df.agg(F.min(c).alias("min"), F.max(c).alias("max"))
    # Both frames have exactly one row.
    middle = date_median(df, column, **options).select("median").scalar()
    return ends.withColumn("median", middle)

