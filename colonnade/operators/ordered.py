"""Row numbers, slices and running sums over a total order, without a one-task window.

Split points of the order (see :mod:`colonnade.operators.ranks`) deal the rows out to
stretches; each is numbered or summed by itself, and what comes before it is added. A hot
sort key is still split because each row's own place or content breaks ties. Nothing is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.ranks import Order, RankIndex, sort_columns, tie_break
from colonnade.types import col

__all__ = ["PLACE", "Order", "file_row_numbers", "file_slice", "number_rows", "row_slice", "running_sums", "sort_columns", "tie_break", "with_place"]


def number_rows(df: DataFrame, order: Order, name: str = "row_number") -> DataFrame:
    """Add the 1-based position of each row in the given order."""
    return RankIndex(df, order).numbered(name)


def row_slice(df: DataFrame, order: Order, start: int, count: int) -> DataFrame:
    """Rows ``start .. start + count`` (0-based) of the order, sorted, at any depth."""
    return RankIndex(df, order).rows(start, count)


def _ends(offsets: DataFrame, keys: list[str], start: int, stop: int):
    """First and last stretch that hold rows ``start .. stop``, as one row.

    ``offsets`` has ``__before`` and ``__size`` per non-empty stretch, which follow
    each other by ``keys``; both ends are null past the last row.
    """
    inside = (F.col("__before") < stop) & (F.col("__before") + F.col("__size") > start)
    stretch = F.struct(*keys, "__before")
    return offsets.where(inside).agg(F.min(stretch).alias("a"), F.max(stretch).alias("z")).first()


def _between(major: Column, minor: Column, low: tuple, high: tuple) -> Column:
    """``low <= (major, minor) < high``, with the bounds on ``major`` open to pushdown."""
    after = (major > F.lit(low[0])) | (minor >= F.lit(low[1]))
    until = (major < F.lit(high[0])) | (minor < F.lit(high[1]))
    return (major >= F.lit(low[0])) & (major <= F.lit(high[0])) & after & until


def running_sums(
    df: DataFrame, by: Sequence[str], order: Order, sums: dict[str, Column]
) -> DataFrame:
    """Add, per series in ``by``, the inclusive running sum of each expression.

    ``by`` keys may be null. A series may span any number of stretches: each is summed by
    itself, and the totals of a series in earlier stretches, one row per series and stretch, are added.
    """
    index = RankIndex(df, [(name, True) for name in by] + list(order))
    stretches = index.dealt()
    valued = index.keyed.select("*", *[value.alias(f"__v_{name}") for name, value in sums.items()])
    inputs = index.with_stretch(valued, _STRETCH, range(len(stretches)))
    keys = [col(name) for name in by]
    within = (
        Window.partitionBy(_STRETCH, *keys)
        .orderBy(*sort_columns(index.keys))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = inputs.select(
        *df.columns,
        _STRETCH,
        *[F.sum(f"__v_{name}").over(within).alias(f"__l_{name}") for name in sums],
    )
    if len(stretches) <= 1:
        return local.select(*[col(name) for name in df.columns], *[F.col(f"__l_{name}").alias(name) for name in sums])
    totals = inputs.groupBy(_STRETCH, *keys).agg(
        *[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums]
    )
    earlier = Window.partitionBy(*keys).orderBy(_STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(_STRETCH).alias("__ostretch"),
        *[col(name).alias(f"__o{i}") for i, name in enumerate(by)],
        *[
            F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}")
            for name in sums
        ],
    )
    match = F.col(_STRETCH) == F.col("__ostretch")
    for i, name in enumerate(by):
        match &= col(name).eqNullSafe(F.col(f"__o{i}"))
    return local.join(offsets, match, "left").select(
        *[col(name) for name in df.columns],
        *[(F.col(f"__l_{name}") + F.col(f"__o_{name}")).alias(name) for name in sums],
    )


_STRETCH = "__stretch"
# Rows of one file that are counted together.
_CHUNK = 1_000_000
_FILE, _INDEX = "__file", "__index"
PLACE = [(_FILE, True), (_INDEX, True)]


# A folder of a table or of a version of it, as far as it does not tell files apart.
_VERSION = r"(-[0-9a-f]{12})?\.(version|parquet)/"


def _file_key(df: DataFrame) -> Column:
    """What files are ordered by: their path, a changed file coming where the one it replaces was."""
    path = F.col("_metadata.file_path")
    changed = any(".version/" in name for name in df.inputFiles())
    return F.regexp_replace(path, _VERSION, "/") if changed else path


def with_place(df: DataFrame) -> DataFrame:
    """Add each row's place, ``PLACE``: its Parquet file and its position in it."""
    return df.withColumns({_FILE: _file_key(df), _INDEX: F.col("_metadata.row_index")})


def file_row_numbers(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Add the 1-based position of each row in file order, without a sort of the table.

    Files follow each other by path. A frame that scans whole files needs no shuffle:
    a row's place in its file counts. Where a filter leaves rows out, those that are left are numbered
    inside stretches of a file and the counts of earlier stretches are added.
    """
    placed = with_place(df)
    sizes = placed.groupBy(_FILE).agg((F.max(_INDEX) + 1).alias("n"), F.count(F.lit(1)).alias("kept"))
    chunk = F.floor(F.col(_INDEX) / F.lit(_CHUNK))
    if not sizes.where("n <> kept").isEmpty():
        placed = placed.withColumn("__chunk", chunk)
        counts = placed.groupBy(_FILE, "__chunk").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.orderBy(_FILE, "__chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select(_FILE, "__chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
        inside = Window.partitionBy(_FILE, "__chunk").orderBy(_INDEX)
        nth = placed.withColumn("__nth", F.row_number().over(inside)).join(before, [_FILE, "__chunk"])
        return nth.select(*[col(c) for c in df.columns], (F.col("__before") + F.col("__nth")).alias(name))
    # One row per file, no more than the file listing Spark itself keeps; the hint
    # spares the table a shuffle by file.
    before = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_FILE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return (
        placed.join(F.broadcast(offsets), _FILE)
        .withColumn(name, F.col("__before") + F.col(_INDEX) + 1)
        .select(*[col(c) for c in df.columns], name)
    )


def file_slice(df: DataFrame, start: int, count: int) -> DataFrame:
    """Rows ``start .. start + count`` (0-based) in file order, of a filtered scan.

    The rows come with their place (see :func:`with_place`). One pass counts the rows
    of each stretch of a file, then only the files and stretches that hold the slice
    are read. Nothing is sorted but those.
    """
    placed = with_place(df)
    chunk = F.floor(F.col(_INDEX) / F.lit(_CHUNK)).alias("__chunk")
    sizes = placed.groupBy(_FILE, chunk).agg(F.count(F.lit(1)).alias("__size"))
    # One row per million rows of the table, less where rows are filtered out.
    before = Window.orderBy(_FILE, "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    ends = _ends(offsets, [_FILE, "__chunk"], start, start + count)
    if ends.a is None:
        return placed.where(F.lit(False))
    low = (ends.a[_FILE], ends.a["__chunk"] * _CHUNK)
    high = (ends.z[_FILE], (ends.z["__chunk"] + 1) * _CHUNK)
    path, index = _file_key(df), F.col("_metadata.row_index")
    near = with_place(df.where(_between(path, index, low, high)))
    return near.orderBy(*sort_columns(PLACE)).offset(start - ends.a["__before"]).limit(count)
