"""Opening files, folders and bundles as tables."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.sources import versions
from colonnade.types import check_distinct_names


class UnreadableTable(ValueError):
    """A file that cannot be opened as a table."""


def base_name(path: str) -> str:
    name = posixpath.basename(path.rstrip("/"))
    return posixpath.splitext(name)[0] or name


def extension(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, length)`` of the files under the paths, read from the listing only."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(list(paths))
        .select("path", "length")
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder, or a version of one that an edit has made."""
    if extension(path) not in ("parquet", "version"):
        raise UnreadableTable(f"{path} is not a .parquet file")
    try:
        df = versions.open_version(spark, path) if versions.is_version(path) else spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        raise UnreadableTable(f"{path} cannot be read as Parquet: {error}") from error
    check_distinct_names(df.columns)
    return df


def read_folder(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """All files of a folder tree with one schema as a single table, with ``source_file``."""
    reader = spark.read.format(format).option("recursiveFileLookup", True).options(**options)
    df = reader.load(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


_CORRUPT = "__corrupt"


def read_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """JSON objects, scalars as text for the vote.

    Lines are read one by one, whatever the file's extension. Only if some line is no
    JSON value by itself, files are read whole, one value each; a file with more than
    one such value is refused. ``multiline`` settles which of the two and saves the look.
    """
    reader = spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", _CORRUPT)
    if multiline is None:
        lines = reader.json(path)
        if _CORRUPT not in lines.columns:
            return lines
        _check_one_value(spark, path)
    df = reader.option("multiLine", multiline is not False).json(path)
    if _CORRUPT in df.columns:
        raise UnreadableTable(f"{path} holds malformed JSON")
    return df


def _check_one_value(spark: SparkSession, path: str) -> None:
    """Read whole, a file gives its first value only, so there must be no other."""

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for batch in batches:
            found = []
            for name, text in zip(batch["path"], batch["value"], strict=True):
                try:
                    start = len(text) - len(text.lstrip("\ufeff \t\r\n"))
                    _, end = decoder.raw_decode(text, start)
                except ValueError:
                    found.append(name)
                    continue
                if text[end:].strip():
                    found.append(name)
            yield pd.DataFrame({"path": pd.Series(found, dtype=object)})

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    bad = whole.mapInPandas(several, "path string").orderBy("path").first()
    if bad is not None:
        raise UnreadableTable(f"{bad.path} is neither JSON lines nor one JSON value")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One row per ``row_tag`` element, its values as text for the vote."""
    return spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)


def table_paths(spark: SparkSession, folder: str) -> list[str]:
    """The tables under a folder: each file, or the ``.parquet`` folder it is part of.

    Reads the names of the files; each becomes a table handle of its own. For very
    many files of one schema use :func:`read_folder`.
    """
    # The innermost folder named *.parquet above a file, if there is one.
    part_of = F.regexp_extract("path", r"^(.*\.parquet)/[^/]+$", 1)
    whole = F.when(part_of != "", part_of).otherwise(F.col("path")).alias("path")
    found = listing(spark, folder).select(whole).distinct().orderBy("path")
    return [row["path"] for row in found.collect()]
