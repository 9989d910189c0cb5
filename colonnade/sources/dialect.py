"""What delimited text looks like, from one aggregate over all of its lines.

For every delimiter each line's number of cells outside quotes is counted, and lines are
grouped by it. The delimiter whose most frequent number covers the largest share of lines
wins, of equal ones that with more cells. The same pass finds the files with lines that hold an
odd number of quotes (their cells may span lines) and those with bytes that are no UTF-8.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The delimiters looked for, in order of preference.
DELIMITERS = (",", ";", "\t", "|")
QUOTE = '"'
#: How files are read that are no UTF-8: every byte is a character there.
SINGLE_BYTE = "ISO-8859-1"


@dataclass(frozen=True)
class Dialect:
    """``sep`` of all files; ``broken``: those with an odd number of quotes on a line; ``other_bytes``: those that are no UTF-8."""

    sep: str
    broken: tuple[str, ...] = ()
    other_bytes: tuple[str, ...] = ()


def plain_path(uri: str) -> str:
    """A path as readers take it, from the one that scans report."""
    return re.sub("^file:/+", "file:///", unquote(uri))


def _occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def widths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, sep, cells, lines, odd, bad)``: how many lines of each file have so many cells under each delimiter.

    ``odd`` and ``bad`` count lines with an odd number of quotes and with bytes that are no
    UTF-8. Lines are counted in their tasks, so what is shuffled does not grow with them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    bare = F.regexp_replace("value", f"{QUOTE}[^{QUOTE}]*{QUOTE}?", "")
    looked = lines.where(F.length(F.trim("value")) > 0).select(
        "path",
        (_occurrences(F.col("value"), QUOTE) % 2).alias("odd"),
        F.when(F.is_valid_utf8("value"), 0).otherwise(1).alias("bad"),
        bare.alias("bare"),
    )
    each = [F.struct(F.lit(sep).alias("sep"), (_occurrences(F.col("bare"), sep) + 1).alias("cells")) for sep in DELIMITERS]
    counts = looked.select("path", "odd", "bad", F.inline(F.array(*each)))
    return counts.groupBy("path", "sep", "cells").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("odd").alias("odd"), F.sum("bad").alias("bad")
    )


def survey(spark: SparkSession, path: str) -> Dialect:
    """The dialect of a file or folder. To the driver come one row per delimiter and the names of files that need care."""
    counted = widths(spark, path)
    per_width = counted.groupBy("sep", "cells").agg(F.sum("lines").alias("lines"))
    of_sep = per_width.groupBy("sep").agg(
        F.sum("lines").alias("all"), F.max(F.struct("lines", "cells")).alias("most")
    )
    seps = of_sep.select(
        "sep", (F.col("most.lines") / F.col("all")).alias("share"), F.col("most.cells").alias("cells"),
        F.lit(None).cast("string").alias("path"), F.lit(0).alias("odd"), F.lit(0).alias("bad"),
    )
    files = counted.groupBy("path").agg((F.max("odd") > 0).cast("int").alias("odd"), (F.max("bad") > 0).cast("int").alias("bad"))
    none = F.lit(None)
    careful = files.where("odd + bad > 0").select(
        none.cast("string").alias("sep"), none.cast("double").alias("share"), none.cast("int").alias("cells"), "path", "odd", "bad"
    )
    found = seps.unionAll(careful).collect()
    scores = {row.sep: (row.share, row.cells) for row in found if row.sep is not None and row.cells > 1}
    best = max(DELIMITERS, key=lambda sep: (*scores.get(sep, (0.0, 0)), -DELIMITERS.index(sep)))
    of = lambda mark: tuple(sorted(plain_path(row.path) for row in found if row.path is not None and row[mark]))
    return Dialect(best, of("odd"), of("bad"))
