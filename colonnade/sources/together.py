"""Many delimited files, each a table of its own, by a few jobs for all of them.

One survey finds each file's delimiter and bytes, one job the headers. Files with one dialect and
header are read as one frame with a column that tells the file; one vote, grouped by file and
column, types them all; and files whose columns came out alike are written by one partitioned
write. So the jobs do not grow with the files, only with the kinds of tables among them.
"""

from __future__ import annotations

import csv
import hashlib
import posixpath
import warnings
from collections import defaultdict
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions import casts
from colonnade.sources.dialect import DELIMITERS, QUOTE, SINGLE_BYTE, plain_path, widths
from colonnade.sources.ingest import DEFAULT_SENSITIVITY, _votes, _winner, cast_table
from colonnade.sources.text import NULL_TEXTS, REFUSED
from colonnade.table import Table
from colonnade.types import LogicalType, check_distinct_names, col

_FILE, _TABLE = "__file", "__table"


def _surveys(spark: SparkSession, paths: list[str], sep: str | None) -> dict[str, tuple[str, bool, bool]]:
    """(delimiter, cells may span lines, bytes are no UTF-8) of each file that has lines."""
    per_sep = widths(spark, paths).groupBy("path", "sep").agg(
        F.max(F.struct("lines", "cells")).alias("most"), F.sum("lines").alias("all"), F.max("odd").alias("odd"), F.max("bad").alias("bad")
    )
    share = F.when(F.col("most.cells") > 1, F.col("most.lines") / F.col("all")).otherwise(0.0)
    rank = F.struct(share.alias("share"), F.col("most.cells").alias("cells"), *[(F.col("sep") == d).alias(f"d{i}") for i, d in enumerate(DELIMITERS)], "sep")
    found = per_sep.groupBy("path").agg(F.max(rank).alias("best"), F.max("odd").alias("odd"), F.max("bad").alias("bad"))
    made = {}
    for row in found.collect():
        path = plain_path(row.path)
        own = sep or ("\t" if path.lower().endswith(".tsv") else row.best.sep)
        made[path] = (own, row.odd > 0, row.bad > 0)
    return made


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, bytes]:
    """The first line of each file that is not blank, as bytes."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    # A file's first split is read by one task, in which ids grow along the file.
    numbered = lines.withColumn("id", F.monotonically_increasing_id()).where((F.col("block") == 0) & (F.length(F.trim("value")) > 0))
    first = numbered.groupBy("path").agg(F.min(F.struct("id", F.col("value").cast("binary").alias("line"))).alias("first"))
    return {plain_path(row.path): bytes(row["first"]["line"]) for row in first.collect()}


def load_together(
    spark: SparkSession,
    names: dict[str, str],
    target: str,
    sep: str | None = None,
    sensitivity: float = DEFAULT_SENSITIVITY,
    lenient_int: bool = False,
) -> dict[str, Table]:
    """A table for each file in ``names`` (path to table name, which may hold a folder), stored below ``target``.

    Files left out of the result have to be read one by one: those whose quoted cells may span lines,
    and those without rows. Malformed lines are kept beside the tables, with a warning per file.
    """
    surveys = _surveys(spark, list(names), sep)
    simple = [path for path in names if plain_path(path) in surveys and not surveys[plain_path(path)][1]]
    if not simple:
        return {}
    headers = _headers(spark, simple)
    groups: dict[tuple[str, bool, tuple[str, ...]], list[str]] = defaultdict(list)
    for path in simple:
        own, _, other = surveys[plain_path(path)]
        line = headers[plain_path(path)].decode(SINGLE_BYTE if other else "utf-8").removesuffix("\r").removeprefix("\ufeff")
        columns = next(csv.reader([line], delimiter=own))
        check_distinct_names([name for name in columns if name])
        groups[own, other, tuple(name or f"_c{i}" for i, name in enumerate(columns))].append(path)
    frames = {key: _frame(spark, key, paths) for key, paths in groups.items()}
    votes = _vote(frames, sensitivity, lenient_int)
    return _written(spark, names, groups, frames, votes, target, lenient_int)


def _frame(spark: SparkSession, key: tuple[str, bool, tuple[str, ...]], paths: list[str]) -> DataFrame:
    """The rows of files of one dialect and header, with their file and refused lines."""
    sep, other, columns = key
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*columns, REFUSED]])
    options = {"header": True, "sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REFUSED, "columnPruning": False}
    df = spark.read.options(**options).option("encoding", SINGLE_BYTE if other else "UTF-8").schema(schema).csv(paths)
    read = F.length(F.concat_ws("", *[col(name) for name in columns])) >= 0
    return df.where(read).withColumn(_FILE, F.col("_metadata.file_path"))


def _vote(frames: dict, sensitivity: float, lenient_int: bool) -> dict[str, dict[int, tuple[LogicalType, int]]]:
    """For each file and column (the refused lines last) the type and the number of values: one aggregate over all frames."""
    cells = []
    for (_, _, columns), df in frames.items():
        readable = F.col(REFUSED).isNull()
        texts = [F.when(readable & ~col(name).isin(*NULL_TEXTS), col(name)) for name in columns]
        pairs = [F.struct(F.lit(i).alias("ordinal"), x.alias("x")) for i, x in enumerate([*texts, F.col(REFUSED)])]
        cells.append(df.select(_FILE, F.inline(F.array(*pairs))))
    looked = reduce(DataFrame.unionAll, cells).select(_FILE, "ordinal", casts.fits(F.col("x"), lenient_int).alias("bits"))
    counted = looked.groupBy(_FILE, "ordinal").agg(*[c.alias(name) for name, c in _votes(F.col("bits")).items()])
    found: dict[str, dict[int, tuple[LogicalType, int]]] = defaultdict(dict)
    for row in counted.withColumn("logical_type", _winner(sensitivity)).collect():
        found[plain_path(row[_FILE])][row.ordinal] = (LogicalType(row.logical_type), row.non_null)
    return found


def _written(spark, names, groups, frames, votes, target, lenient_int) -> dict[str, Table]:
    alike: dict[tuple, list[str]] = defaultdict(list)
    for key, paths in groups.items():
        for path in paths:
            found = votes.get(plain_path(path))
            if found:  # a file without rows has no votes
                alike[key, tuple(found[i][0] for i in range(len(key[2])))].append(path)
    tables = {}
    for (key, kinds), paths in alike.items():
        columns = key[2]
        own = {plain_path(path): names[path] + ".parquet" for path in paths}
        digest = hashlib.sha256(repr((key, kinds, sorted(own.items()))).encode()).hexdigest()[:12]
        home = posixpath.join(target.rstrip("/"), f"tables-{digest}")
        # One row per file of the group, as many as the listing that Spark keeps.
        label = F.create_map(*[F.lit(x) for name, table in own.items() for x in (name, table)])
        df = frames[key].withColumn(_TABLE, label[F.regexp_replace(_decoded(F.col(_FILE)), "^file:/+", "file:///")]).where(F.col(_TABLE).isNotNull())
        good = df.where(F.col(REFUSED).isNull()).select(
            *[F.when(~col(name).isin(*NULL_TEXTS), col(name)).alias(name) for name in columns], _TABLE
        )
        typed = cast_table(good, dict(zip(columns, kinds, strict=True)), lenient_int)
        typed.write.option("compression", "snappy").partitionBy(_TABLE).parquet(home)
        lost = {path: votes[plain_path(path)].get(len(columns), (None, 0))[1] for path in paths}
        if any(lost.values()):
            df.where(F.col(REFUSED).isNotNull()).drop(_FILE).write.partitionBy(_TABLE).parquet(home + "-refused")
        schema = typed.drop(_TABLE).schema
        for path in paths:
            at = posixpath.join(home, f"{_TABLE}={quote(own[plain_path(path)], safe=_UNESCAPED)}")
            if lost[path]:
                warnings.warn(f"{lost[path]} malformed lines of {path} are in {home}-refused", stacklevel=3)
            values = [votes[plain_path(path)][i][1] for i in range(len(columns))]
            if not sum(v for _, v in votes[plain_path(path)].values()) - lost[path] and not any(values) and lost[path]:
                continue  # nothing but malformed lines
            empty = {name: LogicalType.EMPTY for name, n in zip(columns, values, strict=True) if not n}
            tables[path] = Table(spark.read.schema(schema).parquet(at), posixpath.basename(names[path]), at, empty)
    return tables


#: Characters that partition folders keep as they are, beside letters and digits.
_UNESCAPED = " !$&()+,-.;<>@_`|~"


def _decoded(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
