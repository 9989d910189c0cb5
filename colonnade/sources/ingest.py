"""Type inference by vote over all rows, and the typed write."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import casts
from colonnade.operators.percolumn import aggregate_columns
from colonnade.sources.files import base_name
from colonnade.sources.sink import write_table
from colonnade.sources.text import NULL_TEXTS, REFUSED, split_refused, with_refused
from colonnade.table import Table
from colonnade.types import LogicalType, col

DEFAULT_SENSITIVITY = 0.95

# Types in the order they are tried.
_CANDIDATES = (
    LogicalType.BOOLEAN,
    LogicalType.INTEGER,
    LogicalType.DOUBLE,
    LogicalType.DATE,
)


def _votes(bits: Column) -> dict[str, Column]:
    counts = {"non_null": F.count(bits)}
    for kind in _CANDIDATES:
        counts[kind.value.lower()] = F.count_if(bits.bitwiseAND(F.lit(casts.FIT_BITS[kind])) != 0)
    return counts


def _winner(sensitivity: float) -> Column:
    chosen = F.when(F.col("non_null") == 0, LogicalType.STRING.value)
    # A decimal, so that 95 of 100 is enough for 0.95.
    needed = F.col("non_null") * F.lit(Decimal(str(sensitivity)))
    for kind in _CANDIDATES:
        chosen = chosen.when(F.col(kind.value.lower()) >= needed, kind.value)
    return chosen.otherwise(LogicalType.STRING.value)


def vote(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sensitivity: float = DEFAULT_SENSITIVITY,
    lenient_int: bool = False,
) -> DataFrame:
    """One row per text column: how many values fit each type, and the type chosen.

    The first of boolean, integer, double, date that fits at least ``sensitivity``
    of the present values wins; a column with none stays text. One scan.
    """
    names = list(df.columns if columns is None else columns)
    return vote_cells(df, {name: col(name) for name in names}, sensitivity, lenient_int)


def vote_cells(df: DataFrame, cells: Mapping[str, Column], sensitivity: float, lenient_int: bool) -> DataFrame:
    """:func:`vote` on any text expressions of a frame, by their names."""
    counts = aggregate_columns(df, cells, _votes, lambda text: casts.fits(text, lenient_int))
    return counts.fillna(0).withColumn("logical_type", _winner(sensitivity))


def voted_types(votes: DataFrame) -> dict[str, LogicalType]:
    """The vote's outcome on the driver: one row per column."""
    return {row["column"]: LogicalType(row["logical_type"]) for row in votes.collect()}


def cast_table(
    df: DataFrame, kinds: dict[str, LogicalType], lenient_int: bool = False
) -> DataFrame:
    """Cast the text columns to their types; unreadable values become null."""
    return df.select(
        *[
            casts.cast_text(col(name), kinds[name], lenient_int).alias(name)
            if name in kinds
            else col(name)
            for name in df.columns
        ]
    )


def typed(
    df: DataFrame, sensitivity: float = DEFAULT_SENSITIVITY, lenient_int: bool = False
) -> DataFrame:
    """Vote on the text columns of a frame, then cast them."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not text:
        return df
    kinds = voted_types(vote(df, text, sensitivity, lenient_int))
    return cast_table(df, kinds, lenient_int)


def ingest(
    spark: SparkSession,
    path: str,
    out: str,
    alias: str | None = None,
    sep: str | None = None,
    sensitivity: float = DEFAULT_SENSITIVITY,
    lenient_int: bool = False,
    multiline: bool | None = None,
    encoding: str | None = None,
) -> Table:
    """Read delimited text, infer its types, write it as Parquet and open the result.

    Malformed lines are written to a table of their own beside the result, at
    :func:`refused_path`, with a warning that tells their number. The file is read three
    times: for its dialect, for the vote, which also counts the malformed lines, and for the write.
    """
    rows = with_refused(spark, path, sep, multiline, encoding)
    good, refused = split_refused(rows)
    # The cells of refused rows do not vote; their lines count as one more column.
    readable = F.col(REFUSED).isNull()
    ballots = {name: F.when(readable & ~col(name).isin(*NULL_TEXTS), col(name)) for name in good.columns}
    votes = vote_cells(rows, ballots | {REFUSED: F.col(REFUSED)}, sensitivity, lenient_int).collect()
    kinds = {row["column"]: LogicalType(row["logical_type"]) for row in votes}
    write_table(cast_table(good, {name: kinds[name] for name in good.columns}, lenient_int), out)
    lost = next(row["non_null"] for row in votes if row["column"] == REFUSED)
    if lost:
        write_table(refused, refused_path(out))
        warnings.warn(f"{lost} malformed lines of {path} are in {refused_path(out)}", stacklevel=2)
    return Table.open(spark, out, alias or base_name(path))


def refused_path(out: str) -> str:
    """Where the malformed lines of the table written to ``out`` are."""
    return out.rstrip("/").removesuffix(".parquet") + "_refused.parquet"


def refused_count(spark: SparkSession, out: str) -> int:
    """How many lines were refused when the table at ``out`` was written with some."""
    return spark.read.parquet(refused_path(out)).count()
