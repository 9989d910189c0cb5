"""Versions of a stored table that share the files that did not change.

A version is a folder ``<name>-<id>.version`` with a manifest, the list of the table's files in
order, and the files that are its own. Each of those lies in a folder named like the file of the
first version whose place it takes, so the order of rows in files survives any number of edits
(see :func:`colonnade.operators.ordered.with_place`). Files are never changed or deleted.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.sources.dialect import plain_path
from colonnade.sources.sink import new_path

SUFFIX = ".version"
_MANIFEST = "manifest"


def is_version(path: str) -> bool:
    return path.rstrip("/").endswith(SUFFIX)


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of a version, in order."""
    return [row["value"] for row in spark.read.text(posixpath.join(path, _MANIFEST), wholetext=False).coalesce(1).collect()]


def open_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*files(spark, path))


def _slot(file: str) -> str:
    """The name of the first version's file whose place ``file`` has."""
    parent = posixpath.dirname(file)
    return posixpath.basename(parent if is_version(posixpath.dirname(parent)) else file)


def with_cell(df: DataFrame, path: str, file: str, index: int, column: str, value: Column) -> str:
    """Write the version of the table ``df`` at ``path`` with one cell changed, and return its path.

    Only ``file``, which holds the row at place ``index``, is read and written; the new
    manifest names it in the place of the old one.
    """
    spark = df.sparkSession
    folder = new_path(path).removesuffix(".parquet") + SUFFIX
    known = files(spark, path) if is_version(path) else sorted(map(plain_path, df.inputFiles()))
    file = plain_path(file)
    if file not in known:
        raise ValueError(f"{file} is no file of {path}")
    old = spark.read.schema(df.schema).parquet(file)
    hit = F.col("_metadata.row_index") == index
    cells = [F.when(hit, value).otherwise(old[f"`{name}`"]).alias(name) if name == column else old[f"`{name}`"] for name in df.columns]
    home = posixpath.join(folder, _slot(file))
    # One file in, one file out: rows keep their places.
    old.select(*cells).coalesce(1).write.option("compression", "snappy").parquet(home)
    (made,) = map(plain_path, spark.read.schema(df.schema).parquet(home).inputFiles())
    lines = [(made if name == file else name,) for name in known]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(posixpath.join(folder, _MANIFEST))
    return folder
