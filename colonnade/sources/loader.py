"""Load anything the readers know, by extension, as Parquet-backed tables."""

from __future__ import annotations

import posixpath
from collections import Counter

from pyspark.sql import SparkSession

from colonnade.sources import bundle, files
from colonnade.sources.ingest import ingest, typed
from colonnade.sources.sink import write_table
from colonnade.sources.together import load_together
from colonnade.table import Table

_OTHERS = ("zip", "parquet", "json", "jsonl", "ndjson", "xml")


def distinct_names(paths: list[str]) -> dict[str, str]:
    """A name for each path: its stem, with the extension where others of its folder have that stem."""
    stem = lambda path: (posixpath.dirname(path), files.base_name(path).lower())
    times = Counter(stem(path) for path in paths)
    return {p: files.base_name(p) + (f"_{files.extension(p)}" if times[stem(p)] > 1 else "") for p in paths}


def load(
    spark: SparkSession, path: str, target: str, row_tag: str = "row", name: str | None = None, **options
) -> list[Table]:
    """Open one file as a table, or all tables in a zip archive.

    ``name`` is what the table is called and stored as, in place of the file's stem.

    Parquet opens in place; JSON, XML and any other extension (delimited text) are
    typed and written below ``target``.
    """
    kind = files.extension(path)
    name = name or files.base_name(path)
    if kind == "zip":
        inside = posixpath.join(target.rstrip("/"), name)
        unpacked = bundle.unpack(spark, path, inside)
        names = distinct_names(unpacked)
        return [t for p in unpacked for t in load(spark, p, posixpath.dirname(p), row_tag, names[p], **options)]
    if kind == "parquet":
        return [Table.open(spark, path)]
    out = posixpath.join(target.rstrip("/"), name + ".parquet")
    if kind in ("json", "jsonl", "ndjson"):
        frame = typed(files.read_json(spark, path))
    elif kind == "xml":
        frame = typed(files.read_xml(spark, path, row_tag))
    else:
        return [ingest(spark, path, out, alias=name, **options)]
    write_table(frame, out)
    return [Table.open(spark, out, name)]


def load_folder(spark: SparkSession, folder: str, target: str, **options) -> list[Table]:
    """Every file below a folder as a table of its own.

    Delimited files are read together, by a number of jobs that does not grow with theirs (see
    :mod:`colonnade.sources.together`); others, and those that need it, one by one, stored by their relative place.
    """
    paths = files.table_paths(spark, folder)
    names = distinct_names(paths)
    home = {path: posixpath.normpath(posixpath.join(_place(path, folder), names[path])) for path in paths}
    delimited = [path for path in paths if files.extension(path) not in _OTHERS]
    done: dict[str, Table] = {}
    if len(delimited) > 1 and set(options) <= {"sep", "sensitivity", "lenient_int"}:
        done = load_together(spark, {path: home[path] for path in delimited}, target, **options)
    tables = []
    for path in paths:
        if path in done:
            tables.append(done[path])
        else:
            tables += load(spark, path, posixpath.join(target.rstrip("/"), _place(path, folder)), name=names[path], **options)
    return tables


def _place(path: str, folder: str) -> str:
    """The part of a path between the folder and the file name."""
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    parent = posixpath.dirname(path).removeprefix("file://").removeprefix("file:")
    return posixpath.relpath(parent, root) if parent.startswith(root) else ""
