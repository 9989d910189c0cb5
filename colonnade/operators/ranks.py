"""Ranks of rows in a total order, from a small index of split points with exact counts.

The order's keys alone are range-sorted; each stretch of consecutive rows leaves its first key
and its number of rows, at most about ``FANOUT`` small rows in all. Any rank then lies in a known
stretch, which is read by comparing keys with literals, so the bounds reach the scan. A stretch
that is still long is indexed in the same way when a page needs it. Nothing is copied: neither
a sorted table nor the rows before a page are ever written or gathered.

Ties are settled by the row's place in its Parquet file where there is one, else by a hash of the row;
rows that are equal in all of that are counted together and interchangeable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.types import col, field_type, quoted

Order = Sequence[tuple[str, bool]]

#: Rows of a stretch that a page reads whole, and stretches that one pass makes, about.
STRETCH_ROWS = 10_000
FANOUT = 1_000
#: Stretches that an expression tells apart when all rows get their numbers or sums.
DEALT = 256


def sort_columns(order: Order) -> list[Column]:
    """Nulls come last in both directions."""
    return [
        col(name).asc_nulls_last() if ascending else col(name).desc_nulls_last()
        for name, ascending in order
    ]


def tie_break(df: DataFrame) -> list[Column]:
    """A value that tells rows apart and is the same when a lost task runs again.

    The place in the Parquet file where there is one, else a hash of the row. (A
    generated id would differ between attempts and move rows between partitions.)
    """
    place = [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*place).schema
        return place
    except AnalysisException:
        hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        return [F.xxhash64(*[col(name) for name in hashable])]


def _as_text(name: str, kind: T.DataType) -> Column:
    """A key as text from which :func:`_literal` makes the same value again."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name)).cast("string")  # the text of a time with a zone can mean two moments
    if isinstance(kind, T.BinaryType):
        return F.hex(col(name))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        raise ValueError(f"rows cannot be ranked by {name!r}, a {kind.simpleString()}")
    return col(name).cast("string")


def _literal(text: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.lit(text))
    return F.lit(text).cast(kind)


def _rising(x: str, kind: T.DataType, ascending: bool) -> list[str] | None:
    """SQL of values that rise in the order of ``x``, nulls last; None if there are none."""
    if ascending:
        return [f"{x} IS NULL", x]
    if isinstance(kind, T.IntegralType):
        return [f"{x} IS NULL", f"~{x}"]
    if isinstance(kind, T.DecimalType):
        return [f"{x} IS NULL", f"-{x}"]
    if isinstance(kind, T.FractionalType):
        return [f"{x} IS NULL", f"NOT isnan({x})", f"CASE WHEN isnan({x}) THEN 0D ELSE -CAST({x} AS DOUBLE) END"]
    if isinstance(kind, T.BooleanType):
        return [f"{x} IS NULL", f"NOT {x}"]
    if isinstance(kind, T.DateType):
        return [f"{x} IS NULL", f"-unix_date({x})"]
    if isinstance(kind, T.TimestampType):
        return [f"{x} IS NULL", f"~unix_micros({x})"]
    return None


def _literal_sql(text: str | None, kind: T.DataType) -> str:
    if text is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    if isinstance(kind, T.TimestampType):
        return f"timestamp_micros({int(text)}L)"
    if isinstance(kind, T.BinaryType):
        return f"unhex('{text}')"
    return f"CAST(CAST(unhex('{text.encode().hex()}') AS STRING) AS {kind.simpleString()})"


@dataclass
class Stretch:
    """Consecutive rows: the first one's keys as texts, how many rows come before, and how many these are."""

    first: list[str | None]
    before: int
    rows: int
    parts: list[Stretch] | None = None


class RankIndex:
    """The index of a frame in an order; ``stretches`` come from :meth:`to_json` of an earlier one."""

    def __init__(self, df: DataFrame, order: Order, stretches: list[Stretch] | None = None):
        self.df = df
        ties = {f"__tie{i}": tie for i, tie in enumerate(tie_break(df))}
        self.unique = len(ties) > 1  # places in files; hashes may be shared by equal rows
        self.keyed = df.withColumns(ties)
        self.keys = list({name: (name, up) for name, up in reversed([*order, *[(name, True) for name in ties]])}.values())[::-1]
        self.kinds = [field_type(self.keyed, name) for name, _ in self.keys]
        self.stretches = self._measure(self.keyed, 0) if stretches is None else stretches

    # --- building ---

    def _measure(self, rows: DataFrame, before: int) -> list[Stretch]:
        """Split rows, ``before`` of which come earlier, into stretches: one sort of their keys."""
        names = [col(name) for name, _ in self.keys]
        slim = rows.select(*names)
        if self.unique:
            counted, weight, distinct = slim, F.lit(1), slim.count()
        else:
            counted, weight = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")), F.col("__n")
            distinct = counted.count()
        length = max(STRETCH_ROWS, -(-distinct // FANOUT))
        at = F.monotonically_increasing_id()
        texts = F.struct(*[_as_text(name, kind).alias(f"k{i}") for i, ((name, _), kind) in enumerate(zip(self.keys, self.kinds, strict=True))])
        # The high bits of the id are the sorted partition, the low 33 the place in it.
        placed = counted.orderBy(*sort_columns(self.keys)).withColumn("__at", at).select(
            F.shiftright("__at", 33).alias("part"), (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), texts.alias("key"), weight.alias("n")
        )
        chunk = F.floor(F.col("place") / F.lit(length)).alias("chunk")
        # One key per chunk; the list skips the nulls of all other rows.
        first = F.collect_list(F.when(F.col("place") % length == 0, F.col("key")))
        made = placed.groupBy("part", chunk).agg(first.alias("first"), F.sum("n").alias("n")).collect()
        found = []
        for row in sorted(made, key=lambda row: (row["part"], row["chunk"])):
            found.append(Stretch(list(row["first"][0]), before, row["n"]))
            before += row["n"]
        return found

    def to_json(self) -> str:
        """The split points and counts of the first pass."""
        return json.dumps([[s.first, s.before, s.rows] for s in self.stretches])

    @classmethod
    def from_json(cls, df: DataFrame, order: Order, text: str) -> RankIndex:
        return cls(df, order, [Stretch(*entry) for entry in json.loads(text)])

    @property
    def total(self) -> int:
        return self.stretches[-1].before + self.stretches[-1].rows if self.stretches else 0

    # --- reading ---

    def _from(self, first: list[str | None]) -> Column:
        """Whether a row's keys are not before ``first``."""
        found = F.lit(True)
        for (name, ascending), kind, text in reversed(list(zip(self.keys, self.kinds, first, strict=True))):
            key = col(name)
            if text is None:
                found = key.isNull() & found
                continue
            bound = _literal(text, kind)
            later = (key > bound) if ascending else (key < bound)
            found = F.coalesce(later, F.lit(True)) | (key.eqNullSafe(bound) & found)
        return found

    def _near(self, first: list[str | None], upper: bool) -> Column | None:
        """A bound on the leading key alone, in a form that scans can use; rows with that key pass."""
        (name, ascending), text = self.keys[0], first[0]
        key = col(name)
        if upper and text is None:
            return None
        if text is None:
            return key.isNull()
        bound = _literal(text, self.kinds[0])
        if upper:
            return key <= bound if ascending else key >= bound
        return (key >= bound if ascending else key <= bound) | key.isNull()

    def _within(self, low: Stretch | None, high: Stretch | None) -> DataFrame:
        """The rows from the first of ``low`` on that come before the first of ``high``; None is no bound."""
        rows = self.keyed
        if low is not None and low.before > 0:
            rows = rows.where(self._near(low.first, False)).where(self._from(low.first))
        if high is not None:
            near = self._near(high.first, True)
            rows = (rows if near is None else rows.where(near)).where(~self._from(high.first))
        return rows

    def _ends(self, start: int, stop: int) -> tuple[Stretch, Stretch | None]:
        """The finest known stretch that holds row ``start``, and the first one that begins at ``stop`` or later.

        Long stretches at both ends are indexed first.
        """

        def find(stretches: list[Stretch], after: Stretch | None, row: int) -> tuple[Stretch, Stretch | None]:
            k = max(i for i, s in enumerate(stretches) if s.before <= row)
            here, following = stretches[k], stretches[k + 1] if k + 1 < len(stretches) else after
            if here.rows > 2 * STRETCH_ROWS and here.parts is None:
                here.parts = self._measure(self._within(here, following), here.before)
            if here.parts is not None and len(here.parts) > 1:
                return find(here.parts, following, row)
            return here, following

        low, _ = find(self.stretches, None, start)
        last, following = find(self.stretches, None, stop - 1)
        return low, following

    def rows(self, start: int, count: int) -> DataFrame:
        """Rows ``start .. start + count`` (0-based), sorted, from the stretches that hold them."""
        stop = min(start + count, self.total)
        if start >= stop:
            return self.df.where(F.lit(False))
        low, high = self._ends(start, stop)
        found = self._within(low, high).orderBy(*sort_columns(self.keys))
        skipped = start - low.before
        return (found.offset(skipped) if skipped else found).limit(stop - start).select(*[col(name) for name in self.df.columns])

    # --- all rows ---

    def dealt(self) -> list[Stretch]:
        """Neighbouring stretches taken together, at most about ``DEALT``."""
        step = -(-len(self.stretches) // DEALT) or 1
        groups = [self.stretches[k : k + step] for k in range(0, len(self.stretches), step)]
        return [Stretch(g[0].first, g[0].before, sum(s.rows for s in g)) for g in groups]

    def with_stretch(self, rows: DataFrame, name: str, values: Sequence[int]) -> DataFrame:
        """``rows`` with the entry of ``values`` of the dealt stretch that holds each: a search tree of comparisons.

        All keys are put into one struct that rises in the order, so that a node compares
        once; where a falling key has no opposite, keys are compared one by one.
        """
        stretches = self.dealt()
        fields = self._struct(lambda i: quoted(self.keys[i][0]))

        def tree(low: int, high: int) -> str:
            if high - low <= 1:
                return f"{values[low]}L"
            middle = (low + high) // 2
            first = stretches[middle].first
            bound = self._struct(lambda i: _literal_sql(first[i], self.kinds[i]))
            return f"CASE WHEN __key >= {bound} THEN {tree(middle, high)} ELSE {tree(low, middle)} END"

        def slow_tree(low: int, high: int) -> Column:
            if high - low <= 1:
                return F.lit(values[low]).cast("long")
            middle = (low + high) // 2
            return F.when(self._from(stretches[middle].first), slow_tree(middle, high)).otherwise(slow_tree(low, middle))

        if len(stretches) <= 1:
            return rows.withColumn(name, F.lit(values[0] if stretches else 0).cast("long"))
        if fields is None:
            return rows.withColumn(name, slow_tree(0, len(stretches)))
        return rows.withColumn("__key", F.expr(fields)).withColumn(name, F.expr(tree(0, len(stretches)))).drop("__key")

    def _struct(self, sql: Callable[[int], str]) -> str | None:
        made: list[str] = []
        for i, ((_, ascending), kind) in enumerate(zip(self.keys, self.kinds, strict=True)):
            rising = _rising(sql(i), kind, ascending)
            if rising is None:
                return None
            made += rising
        return f"named_struct({', '.join(f"'f{i}', {x}" for i, x in enumerate(made))})"

    def numbered(self, name: str) -> DataFrame:
        """All rows with their 1-based position: a window inside each stretch, after what comes before it."""
        inside = Window.partitionBy("__before").orderBy(*sort_columns(self.keys))
        placed = self.with_stretch(self.keyed, "__before", [s.before for s in self.dealt()]).withColumn("__place", F.row_number().over(inside))
        return placed.select(*[col(c) for c in self.df.columns if c != name], (F.col("__before") + F.col("__place")).alias(name))
