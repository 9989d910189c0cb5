"""Sums over all rows before a row, in a total order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.shared import written

_PART = "__part"


def sums_before(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, per entry of ``sums``, the sum of the expression over all earlier rows (zero for the first).

    The rows are range-sorted and written with their partition's number; sums inside a
    partition come from a window over it, the rest from the partitions' totals, one row per
    partition. ``order`` must tell all rows apart.
    """
    valued = df.select("*", *[value.alias(f"__v_{name}") for name, value in sums.items()])
    placed = written(valued.orderBy(*order).withColumn(_PART, F.spark_partition_id()), "prefix")
    inside = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(_PART).agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    before = totals.select(_PART, *[F.coalesce(F.sum(f"__t_{name}").over(earlier), zero).alias(f"__b_{name}") for name in sums])
    local = placed.select("*", *[F.coalesce(F.sum(f"__v_{name}").over(inside), zero).alias(f"__l_{name}") for name in sums])
    # One row per partition of the sort, so never more than the session's shuffle partitions.
    return local.join(F.broadcast(before), _PART).select(
        *df.columns, *[(F.col(f"__l_{name}") + F.col(f"__b_{name}")).alias(name) for name in sums]
    )
