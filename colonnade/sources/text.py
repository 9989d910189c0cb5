"""Delimited text read as text columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.sources.dialect import DELIMITERS, QUOTE, SINGLE_BYTE, Dialect, plain_path, survey
from colonnade.sources.records import first_record, records
from colonnade.types import check_distinct_names, col, quoted

__all__ = ["DELIMITERS", "NULL_TEXTS", "REFUSED", "blank_to_null", "dialect_of", "header", "read_lenient", "read_set_aside", "read_text_table"]

# The cell texts that mean no value.
NULL_TEXTS = ("", " ")
#: The column of lines that were refused.
REFUSED = "__refused"


def dialect_of(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None, encoding: str | None = None
) -> Dialect:
    """The dialect of a file or folder: what is given, and for the rest what one pass over all lines shows.

    ``multiline`` True or False says of all files whether cells may span lines; ``encoding``
    is that of all files, UTF-8 or ISO-8859-1. A file named ``.tsv`` is split at tabs.
    """
    if encoding is not None and encoding.upper() not in ("UTF-8", SINGLE_BYTE):
        raise ValueError(f"the encoding must be UTF-8 or {SINGLE_BYTE}, not {encoding!r}")
    sep = sep or ("\t" if path.lower().endswith(".tsv") else None)
    found = Dialect(",") if sep and multiline is not None and encoding is not None else survey(spark, path)
    if sep:
        found = replace(found, sep=sep)
    every = lambda yes: _files(spark, path) if yes else ()
    if multiline is not None:
        found = replace(found, broken=every(multiline))
    if encoding is not None:
        found = replace(found, other_bytes=every(encoding.upper() == SINGLE_BYTE))
    return found


def _files(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in the listing that Spark keeps for the scan."""
    return tuple(sorted(plain_path(name) for name in spark.read.text(path).inputFiles()))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Replace the null texts in every column."""
    return df.select(
        *[F.when(~col(name).isin(*NULL_TEXTS), col(name)).alias(name) for name in df.columns]
    )


def header(spark: SparkSession, path: str, found: Dialect) -> list[str]:
    """The names in the header of the first file by name, checked before Spark renames equal ones."""
    first, *_ = _files(spark, path) or (path,)
    names = first_record(spark, first, SINGLE_BYTE if first in found.other_bytes else None, found.sep)
    check_distinct_names([name for name in names if name])
    return [name or f"_c{i}" for i, name in enumerate(names)]


def _read(spark: SparkSession, path: str, found: Dialect, mode: str, names: list[str]) -> DataFrame:
    """All files, split over tasks, every column as text, with ``REFUSED`` in the permissive mode."""
    kept = [*names, REFUSED] if mode == "PERMISSIVE" else names
    schema = T.StructType([T.StructField(name, T.StringType()) for name in kept])
    options = {"sep": found.sep, "quote": QUOTE, "escape": QUOTE, "mode": mode, "columnNameOfCorruptRecord": REFUSED}
    every = set(_files(spark, path)) if found.broken or found.other_bytes else None
    parts = []
    for encoding in (None, SINGLE_BYTE):
        for spans in (False, True):
            if every is None:
                paths = [] if encoding or spans else [path]
            else:
                paths = sorted(name for name in every if (name in found.broken) == spans and (name in found.other_bytes) == bool(encoding))
            if not paths:
                continue
            if spans:
                rows = records(spark, paths, found.sep, encoding)
                fields = ", ".join(f"{quoted(name)} string" for name in kept)
                parts.append(rows.select(F.from_csv("record", fields, options).alias("cells")).select("cells.*"))
            else:
                # A line is malformed or not whichever columns a query reads.
                reader = spark.read.option("header", True).option("columnPruning", False).options(**options)
                parts.append(reader.option("encoding", encoding or "UTF-8").schema(schema).csv(paths))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionAll(part)
    return df


def read_text_table(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    multiline: bool | None = None,
    mode: str = "FAILFAST",
    encoding: str | None = None,
) -> DataFrame:
    """A file or folder with a header line, every column as text.

    Files are split over tasks, also those whose quoted cells span lines. What is not given
    is found out by one pass over all lines, see :func:`dialect_of`.
    """
    found = dialect_of(spark, path, sep, multiline, encoding)
    return blank_to_null(_read(spark, path, found, mode, header(spark, path, found)))


def with_refused(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None, encoding: str | None = None
) -> DataFrame:
    """All rows; of a refused one ``REFUSED`` holds the line and the other columns what was read of it."""
    found = dialect_of(spark, path, sep, multiline, encoding)
    names = header(spark, path, found)
    df = _read(spark, path, found, "PERMISSIVE", names)
    # Spark refuses a scan of that column alone, so a condition names the others too.
    return df.where(F.length(F.concat_ws("", *[col(name) for name in names])) >= 0)


def split_refused(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readable rows and the refused ones of :func:`with_refused`."""
    return blank_to_null(df.where(F.col(REFUSED).isNull()).drop(REFUSED)), df.where(F.col(REFUSED).isNotNull())


def read_set_aside(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None, encoding: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The readable rows, and the refused ones: malformed lines whole in ``REFUSED``, beside what was read of them."""
    return split_refused(with_refused(spark, path, sep, multiline, encoding))


def read_lenient(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None, encoding: str | None = None
) -> DataFrame:
    """As :func:`read_text_table`, but malformed lines are dropped, not refused."""
    return read_set_aside(spark, path, sep, multiline, encoding)[0]
