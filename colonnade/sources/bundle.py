"""Zip bundles: entries are unpacked by Spark tasks, then loaded like files."""

from __future__ import annotations

import posixpath
import re
import shutil
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.sources.files import listing

_CHUNK = 4 << 20


class UnsafeEntry(ValueError):
    """An entry whose name leads outside the target folder."""


def arrow_uri(uri: str) -> str:
    """The address of a file as the tasks' own file systems take it: Hadoop's names of S3 and of local files differ."""
    if uri.startswith("file:"):
        return uri.removeprefix("file://").removeprefix("file:")
    return re.sub("^s3[an]://", "s3://", uri)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def escapes(name: str) -> bool:
    """Whether an entry name leaves the folder it is unpacked into."""
    clean = name.replace("\\", "/")
    normal = posixpath.normpath(clean)
    return clean.startswith("/") or clean[1:2] == ":" or normal.split("/")[0] == ".."


def _list_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive in batch["path"]:
            fs, path = _filesystem(archive)
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as opened:
                names = [(i.filename, i.file_size) for i in opened.infolist() if not i.is_dir()]
            yield pd.DataFrame(
                {
                    "archive": archive,
                    "entry": [name for name, _ in names],
                    "size": pd.Series([size for _, size in names], dtype="int64"),
                    "unsafe": pd.Series([escapes(name) for name, _ in names], dtype="bool"),
                }
            )


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, entry, size, unsafe)`` of the files inside zip archives."""
    archives = listing(spark, path).select("path")
    return archives.repartition(_parts(spark), "path").mapInPandas(
        _list_entries, "archive string, entry string, size bigint, unsafe boolean"
    )


def _home(spark: SparkSession, path: str) -> Column:
    """The folder of an archive's entries: none for a single archive."""
    archives = [row["path"] for row in listing(spark, path).select("path").limit(2).collect()]
    if len(archives) < 2:
        return F.lit("")
    stem = F.regexp_extract("archive", r"([^/]*?)(\.zip)?$", 1)
    # Folders of the archive's path keep equal names apart; the digest stands for them.
    return F.concat(stem, F.lit("-"), F.substring(F.md5("archive"), 1, 8))


def unpack(spark: SparkSession, path: str, target: str) -> list[str]:
    """Unpack all entries below ``target``, entry by entry in parallel.

    Nothing is written when any entry would leave the target. ``target`` is a URI
    every executor can write, with the credentials its tasks have. Of a folder of archives each goes to a folder
    below ``target`` of its own, named like it and a digest of its path. Returns the paths of the unpacked files.
    """
    found = entries(spark, path).withColumn("home", _home(spark, path))
    bad = found.where("unsafe").limit(1).collect()
    if bad:
        raise UnsafeEntry(f"{bad[0]['entry']!r} in {bad[0]['archive']} leads outside the target")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_fs, root = _filesystem(target)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            written = []
            for archive, entry, home in zip(batch["archive"], batch["entry"], batch["home"], strict=True):
                name = posixpath.join(home, posixpath.normpath(entry.replace("\\", "/")))
                goal = posixpath.join(root, name)
                out_fs.create_dir(posixpath.dirname(goal), recursive=True)
                # Attempts of the same task write apart; the last move wins.
                draft = posixpath.join(posixpath.dirname(goal), f"._{attempt}_{posixpath.basename(goal)}")
                in_fs, source = _filesystem(archive)
                with (
                    in_fs.open_input_file(source) as raw,
                    zipfile.ZipFile(raw) as opened,
                    opened.open(entry) as data,
                    out_fs.open_output_stream(draft) as out,
                ):
                    shutil.copyfileobj(data, out, _CHUNK)
                out_fs.move(draft, goal)
                written.append(posixpath.join(target.rstrip("/"), name))
            yield pd.DataFrame({"path": written})

    # Spread by entry, so a bundle that holds most of the data is shared out too.
    spread = found.repartition(_parts(spark), "archive", "entry")
    done = spread.select("archive", "entry", "home").mapInPandas(write, "path string")
    return sorted(row["path"] for row in done.collect())
