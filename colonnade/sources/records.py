"""Records of delimited text whose quoted cells span lines, read by many tasks.

Whether a line begins inside a quoted cell depends on all lines before it. Each split of a
file first finds, for both cases, whether a cell is open at its end. That is one of four functions
(kept, turned, always open, never open), and composing them in order, a running sum of turns since the last
constant one, tells every split how it begins. With that the splits put their lines
together to records on their own. Only the records that cross a split's edge are put
together across tasks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.sources.dialect import QUOTE, SINGLE_BYTE
from colonnade.sources.files import UnreadableTable

_AT = ["file", "block"]
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _closing(line: str, at: int) -> int:
    """The place after the quote that closes a cell from ``at`` on, or -1. Doubled quotes stand for one."""
    while (at := line.find(QUOTE, at)) >= 0:
        if not line.startswith(QUOTE, at + 1):
            return at + 1
        at += 2
    return -1


def open_at_end(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, if one was (``inside``) or was not open before it.

    A quote opens a cell only as its first character; elsewhere it is text.
    """
    at = 0
    while True:
        if inside or line.startswith(QUOTE, at):
            at = _closing(line, at if inside else at + 1)
            if at < 0:
                return True
            inside = False
            at = line.find(sep, at)
        else:
            at = line.find(sep + QUOTE, at)
        if at < 0:
            return False
        at += len(sep)


def lines_of(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """``(value, file, block)``: lines without their line feed, and the split that reads them."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    value = F.decode(F.col("value").cast("binary"), SINGLE_BYTE) if encoding == SINGLE_BYTE else F.col("value")
    return lines.select(value.alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """The stretches of a batch that lie in one split, in order."""
    keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    begin = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[begin]:
            yield keys[begin], begin, k
            begin = k


def block_states(lines: DataFrame, sep: str) -> DataFrame:
    """``(file, block, inside, ends_inside)``: whether each split begins and ends inside a quoted cell. One row per split."""

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[int, int], list[bool]] = {}
        for batch in batches:
            for key, begin, end in _stretches(batch):
                state = ends.setdefault(key, [False, True])
                for line in batch.column(0)[begin:end].to_pylist():
                    if QUOTE in line:
                        after = open_at_end(line, sep, state[0])
                        state[1] = after if state[0] == state[1] else open_at_end(line, sep, state[1])
                        state[0] = after
        rows = [(f, b, *s) for (f, b), s in ends.items()]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "from_out", "from_in"])

    ends = lines.mapInArrow(follow, "file long, block long, from_out boolean, from_in boolean")
    turns = F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ends.withColumn("turns", F.sum(turns).over(upto))
    constant = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("open"), "turns"))
    scanned = summed.select(*_AT, "from_out", "from_in", F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("turned"),
                            F.last(constant, ignorenulls=True).over(before).alias("fixed"))
    since = F.col("turned") - F.coalesce("fixed.turns", F.lit(0)) + F.coalesce("fixed.open", F.lit(0))
    inside = (since % 2 == 1).alias("inside")
    return scanned.select(*_AT, inside, F.when(since % 2 == 1, F.col("from_in")).otherwise(F.col("from_out")).alias("ends_inside"))


def _assembled(lines: DataFrame, sep: str, edges: bool) -> DataFrame:
    """``(record, file, block, kind, first)`` of the records inside splits, or with ``edges`` the parts of those that cross edges.

    ``first`` marks the first record of a file. Blank records are left out.
    """

    def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        waiting: list[str] = []
        inside = started = False

        def flush(key: tuple[int, int] | None, made: list) -> None:
            if key is not None and inside:
                made.append(("\n".join(waiting), *key, _TAIL if started else _HEAD, started and first))

        first = False
        for batch in batches:
            begins = batch.column(3)
            made: list[tuple] = []
            for key, begin, end in _stretches(batch):
                if key != now:
                    flush(now, made)
                    # A record that is open at the start has begun in an earlier split.
                    now, waiting, inside, started, first = key, [], begins[begin].as_py(), False, key[1] == 0
                for line in batch.column(0)[begin:end].to_pylist():
                    if not inside:
                        started = True
                    was = inside
                    if QUOTE in line:
                        inside = open_at_end(line, sep, inside)
                    if inside:
                        waiting.append(line)
                        continue
                    if was:
                        waiting.append(line)
                        line, waiting = "\n".join(waiting), []
                    line = line.removesuffix("\r")
                    if line.strip():
                        made.append((line, *key, _WHOLE if started else _HEAD, started and first))
                        first = first and not started
            yield batch_of(made)
        made = []
        flush(now, made)
        yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        kept = [row for row in made if (row[3] != _WHOLE) == edges]
        columns = list(zip(*kept, strict=True)) if kept else [(), (), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record", *_AT, "kind", "first"])

    return lines.mapInArrow(put_together, "record string, file long, block long, kind int, first boolean")


def records(spark: SparkSession, paths: list[str], sep: str, encoding: str | None = None) -> DataFrame:
    """``(record)``: the text of every record but each file's first, its header.

    Line breaks inside quoted cells stay as they are. A file may end inside a cell, which is then
    closed there. Splits are those Spark makes; the states are keyed by their places, which are broadcast: one
    small row per split, of which the driver holds a list anyway.
    """
    lines = lines_of(spark, paths, encoding)
    states = block_states(lines, sep)
    known = F.broadcast(states.select(*_AT, "inside"))
    missing = F.raise_error(F.lit("the splits of a text file changed between two reads"))
    state = F.when(F.col("inside").isNull(), missing.cast("boolean")).otherwise(F.col("inside"))
    whole = _assembled(lines.join(known, _AT, "left").select("value", *_AT, state.alias("inside")), sep, edges=False)
    # The parts at edges are read again, only in the splits that have some.
    crossing = F.broadcast(states.where("inside or ends_inside").select(*_AT, "inside"))
    parts = _assembled(lines.join(crossing, _AT).select("value", *_AT, "inside"), sep, edges=True)
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("nth", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
    crossed = numbered.groupBy("file", "nth").agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"), F.max("first").alias("first"))
    return whole.where(~F.col("first")).select("record").unionAll(crossed.where(~F.col("first")).select("record"))


def first_record(spark: SparkSession, path: str, encoding: str | None = None, sep: str = ",") -> list[str]:
    """The cells of the first record of a file, whatever line breaks they hold."""
    lines = lines_of(spark, [path], encoding).where("block = 0").select("value").limit(1000).toLocalIterator()
    found = next(csv.reader((row["value"].removesuffix("\r") + "\n" for row in lines), delimiter=sep), None)
    if found is None:
        raise UnreadableTable(f"{path} is empty: there is no header")
    return found
