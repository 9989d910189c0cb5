"""Column summaries of whole tables, with as few scans as the answers allow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.times import from_micros, to_micros
from colonnade.operators.percolumn import aggregate_columns
from colonnade.operators.quantiles import quantiles
from colonnade.operators.statistics import distinct_counts, null_statistics
from colonnade.types import LogicalType, col, is_nested, logical_types


def describe(df: DataFrame, kinds: Mapping[str, LogicalType] | None = None) -> DataFrame:
    """One row per column: position, name, types and what the column can be used for."""
    kinds = {**logical_types(df), **(kinds or {})}
    rows = []
    for i, field in enumerate(df.schema):
        kind = kinds[field.name]
        # Nested columns only take part in counts and null tests.
        flat = not is_nested(field.dataType)
        row = {
            "ordinal": i,
            "column": field.name,
            "spark_type": field.dataType.simpleString(),
            "logical_type": kind.value,
            "chart_value": flat and kind.is_numeric,
            "chart_group": flat and kind.is_categorical,
            "chart_outer": flat,
            "filterable": not kind.is_empty,
        }
        rows.append(F.struct(*[F.lit(value).alias(name) for name, value in row.items()]))
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def column_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    kinds: Mapping[str, LogicalType] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Per column: types, null rate, distinct count and their ratio to the rows."""
    kinds = {**logical_types(df), **(kinds or {})}
    nested = {f.name for f in df.schema if is_nested(f.dataType)}
    chosen = list(df.columns if columns is None else columns)
    flat = [name for name in chosen if name not in nested]
    parts = []
    if flat:
        parts.append(distinct_counts(df, flat, approx))
    if len(flat) < len(chosen):
        rest = [name for name in chosen if name in nested]
        row = null_statistics(df, rest)
        parts.append(
            row.select(
                "column",
                (F.col("non_null") + F.col("null_count")).alias("row_count"),
                "non_null",
                F.lit(None).cast("bigint").alias("distinct_count"),
            )
        )
    counted = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    kind = F.create_map(*[F.lit(x) for c in chosen for x in (c, kinds[c].value)])
    native = F.create_map(*[F.lit(x) for c in chosen for x in (c, kinds[c].sql_name)])
    rows = F.col("row_count").cast("double")
    return counted.select(
        "column",
        kind[F.col("column")].alias("logical_type"),
        native[F.col("column")].alias("native_type"),
        F.try_divide(rows - F.col("non_null"), rows).alias("null_rate"),
        "distinct_count",
        F.try_divide(F.col("distinct_count").cast("double"), rows).alias("cardinality_ratio"),
    )


def header_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, **quantile_options
) -> DataFrame:
    """``(column, statistic, value, moment)`` as shown above a column.

    Numbers: min, max, mean, sum. Texts: the same of their length. Times: min, max
    and median, in ``moment``. All but the medians come from one scan.
    """
    kinds = logical_types(df)
    nested = {f.name for f in df.schema if is_nested(f.dataType)}
    chosen = [c for c in (df.columns if columns is None else columns) if c not in nested]
    cells = {}
    for name in chosen:
        if kinds[name].is_numeric:
            cells[name] = col(name).cast("double")
        elif kinds[name] is LogicalType.STRING:
            cells[name] = F.length(col(name)).cast("double")
        elif kinds[name].is_date:
            cells[name] = to_micros(col(name)).cast("double")
    dates = [name for name in cells if kinds[name].is_date]
    texts = [name for name in cells if kinds[name] is LogicalType.STRING]
    made = aggregate_columns(
        df, cells, lambda x: {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "sum": F.sum(x)}
    )
    tall = made.unpivot("column", ["min", "max", "mean", "sum"], "statistic", "value")
    is_date, is_text = F.col("column").isin(dates), F.col("column").isin(texts)
    tall = tall.where(~is_date | F.col("statistic").isin("min", "max"))
    if dates:
        medians = quantiles(df, dates, [0.5], **quantile_options)
        tall = tall.unionAll(medians.select("column", F.lit("median"), "value"))
    named = F.when(is_text, F.concat("statistic", F.lit("_length"))).otherwise(F.col("statistic"))
    return tall.select(
        "column",
        named.alias("statistic"),
        F.when(~is_date, F.col("value")).alias("value"),
        F.when(is_date, from_micros(F.col("value"))).alias("moment"),
    )
