"""Grouped sub-tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.aggregates import summed
from colonnade.operators import filters as flt
from colonnade.types import LogicalType, classify, col, field_type, is_nested

_ANY_ORDERED = ("none", "min", "max", "count", "count_distinct")
_ALLOWED = {
    LogicalType.INTEGER: ("none", "sum", "avg", *_ANY_ORDERED[1:]),
    LogicalType.DOUBLE: ("none", "sum", "avg", *_ANY_ORDERED[1:]),
    LogicalType.DATE: _ANY_ORDERED,
    LogicalType.BOOLEAN: _ANY_ORDERED,
    LogicalType.STRING: _ANY_ORDERED,
    LogicalType.EMPTY: ("none", "count"),
}


def allowed_aggregates(kind: LogicalType) -> tuple[str, ...]:
    """Aggregates a column of this kind offers; the first is the default."""
    return _ALLOWED[kind]


def _aggregate(name: str, c: Column, spark_type: T.DataType, approx: bool) -> Column:
    if name == "count_distinct":
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if name == "sum":
        return summed(c, spark_type)
    return {"avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[name](c)


def subtable(
    df: DataFrame,
    by: str,
    aggregates: Mapping[str, str] | None = None,
    filters: Iterable[flt.Filter] = (),
    kinds: Mapping[str, LogicalType] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Group by one column; each other column is aggregated into ``<col>_<aggregate>``.

    Columns that are absent from ``aggregates`` or mapped to ``none`` are left out,
    so without aggregates the result is the distinct keys. Null keys form a group.
    """
    if is_nested(field_type(df, by)):
        raise ValueError(f"cannot group by nested column {by!r}")
    chosen = []
    for name, how in (aggregates or {}).items():
        kind = (kinds or {}).get(name, classify(field_type(df, name)))
        nested = is_nested(field_type(df, name)) and how not in ("none", "count")
        if name == by or how not in allowed_aggregates(kind) or nested:
            raise ValueError(f"{how!r} is not offered for {kind.value} column {name!r}")
        if how != "none":
            chosen.append(_aggregate(how, col(name), field_type(df, name), approx).alias(f"{name}_{how}"))
    kept = flt.apply(df, filters)
    return kept.groupBy(col(by)).agg(*chosen) if chosen else kept.select(col(by)).distinct()
