"""A table handle (frame, alias, logical types, filters) and a catalog of them."""

from __future__ import annotations

import hashlib
import json
import math
import posixpath
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators import edit, paging, profile, statistics
from colonnade.operators import filters as flt
from colonnade.operators import merge as merging
from colonnade.operators.ordered import PLACE, file_slice
from colonnade.operators.ranks import Order, RankIndex
from colonnade.operators.subtable import subtable as grouped
from colonnade.sources import versions
from colonnade.sources.files import base_name, listing, read_parquet
from colonnade.sources.sink import new_path, write_table
from colonnade.types import LogicalType, check_distinct_names, classify, logical_types, quoted


def human_size(size: int) -> str:
    """Bytes with one decimal in steps of 1024."""
    if size < 1024:
        return f"{size} B"
    step = min(int(math.log(size, 1024)), 6)
    return f"{size / 1024**step:.1f} {'KMGTPE'[step - 1]}B"


@dataclass(frozen=True)
class Table:
    """An immutable handle; every change returns a new one."""

    df: DataFrame
    alias: str
    path: str | None = None
    kinds: dict[str, LogicalType] = field(default_factory=dict)
    filters: tuple[flt.Filter, ...] = ()

    def __post_init__(self) -> None:
        check_distinct_names(self.df.columns)
        object.__setattr__(self, "kinds", {**logical_types(self.df), **self.kinds})

    @classmethod
    def open(cls, spark: SparkSession, path: str, alias: str | None = None) -> Table:
        """Open a Parquet table and mark its text columns that hold no value."""
        table = cls(read_parquet(spark, path), alias or base_name(path), path)
        return table.mark_empty()

    def mark_empty(self, *columns: str) -> Table:
        """Look again which text columns (all, or the named ones) hold no value."""
        looked = columns or self.columns
        empty = edit.find_empty(edit.select(self.df, looked))
        fresh = {n: k for n, k in logical_types(self.df).items() if n in looked}
        fresh.update({name: LogicalType.EMPTY for name in empty})
        return replace(self, kinds={**self.kinds, **fresh})

    # --- columns ---

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def column(self, column: int | str) -> str:
        """A column's name, from its 0-based index or its name."""
        if isinstance(column, int):
            if not 0 <= column < len(self.columns):
                raise ValueError(f"column index {column} is out of range")
            return self.columns[column]
        if column not in self.columns:
            raise ValueError(f"no column {column!r}; columns are {self.columns}")
        return column

    def kind(self, column: int | str) -> LogicalType:
        return self.kinds[self.column(column)]

    def columns_for(self, role: str) -> list[str]:
        """Columns that fit a role: chart ``value``, ``group``, ``outer`` or ``filter``."""
        tests = {
            "value": lambda kind: kind.is_numeric,
            "group": lambda kind: kind.is_categorical,
            "outer": lambda kind: True,
            "filter": lambda kind: not kind.is_empty,
        }
        return [name for name in self.columns if tests[role](self.kinds[name])]

    def describe(self) -> DataFrame:
        return profile.describe(self.df, self.kinds)

    def summary(self, approx: bool = False) -> DataFrame:
        return profile.column_summary(self.df, kinds=self.kinds, approx=approx)

    # --- filters and pages ---

    def add_filters(self, *filters: flt.Filter, free_text: bool = False) -> Table:
        """Filters that fit their columns' types; see :func:`filters.allowed_operators`.

        Text whose values repeat is picked from its categories, not searched. Whether they do is
        looked up where a condition depends on it; ``free_text`` takes all text for free text.
        """
        for item in filters:
            name = self.column(item.column)
            kind = self.kinds[name]
            flt.check_allowed(item, kind)
            if kind is LogicalType.STRING and not free_text and flt.needs_free_text(item):
                flt.check_allowed(item, kind, statistics.has_categories(self.df, name).first()["has_categories"])
        return replace(self, filters=(*self.filters, *filters))

    def above(self, column: int | str, threshold) -> Table:
        """Keep values above a threshold; for text, values longer than it."""
        name = self.column(column)
        is_text = self.kinds[name] is LogicalType.STRING
        return self.add_filters((flt.longer_than if is_text else flt.above)(name, threshold))

    def below(self, column: int | str, threshold) -> Table:
        """Keep values below a threshold; for text, values shorter than it."""
        name = self.column(column)
        is_text = self.kinds[name] is LogicalType.STRING
        return self.add_filters((flt.shorter_than if is_text else flt.below)(name, threshold))

    def sorted_by(self, column: int | str, ascending: bool = True) -> Table:
        """Sort by one column; this replaces all filters."""
        return replace(self, filters=(flt.sort_by(self.column(column), ascending),))

    def clear_filters(self, column: int | str | None = None) -> Table:
        if column is None:
            return replace(self, filters=())
        return replace(self, filters=tuple(flt.clear_column(self.filters, self.column(column))))

    def save_filters(self) -> str:
        """Keep the filters beside the table, one set per alias."""
        path = posixpath.join(_folder_of(self), f"filters_{self.alias}")
        text = self.df.sparkSession.range(1).select(F.lit(flt.to_json(self.filters)))
        text.coalesce(1).write.mode("overwrite").text(path)
        return path

    def load_filters(self) -> Table:
        """The table with the filters last saved for its alias."""
        path = posixpath.join(_folder_of(self), f"filters_{self.alias}")
        (line,) = self.df.sparkSession.read.text(path).collect()
        return replace(self, filters=tuple(flt.from_json(line["value"])))

    def view(self) -> DataFrame:
        """The rows that pass the filters, unordered."""
        return flt.apply(self.df, self.filters)

    def page(
        self, index: int, size: int = paging.DEFAULT_PAGE_SIZE, key: Sequence[str] = ()
    ) -> DataFrame:
        """A page of the view, by the sort of the filters.

        ``key`` columns settle the order of equal rows; without them their place in
        the file does.
        """
        order = flt.ordering(self.filters)
        if not key and not order:
            return paging.file_page(self.view(), index, size)
        order = [*order, *[(name, True) for name in key]]
        return paging.page(self.view(), order, index, size, self._ranks(order) if index else None)

    def _ranks(self, order: Order) -> RankIndex:
        """The rank index of the view in an order, kept beside the table.

        Files are never changed, so an index holds for its path, filters and order for ever.
        """
        if self.path is None:
            return RankIndex(self.view(), order)
        spark = self.df.sparkSession
        what = json.dumps([self.path, flt.to_json(self.filters), list(order)])
        path = posixpath.join(_folder_of(self), f"ranks_{hashlib.sha256(what.encode()).hexdigest()[:24]}")
        try:
            ((text,),) = spark.read.text(path, wholetext=True).collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            index = RankIndex(self.view(), order)
            spark.range(1).select(F.lit(index.to_json())).coalesce(1).write.mode("overwrite").text(path)
            return index
        return RankIndex.from_json(self.view(), order, text)

    def cell(self, row: int, column: int | str) -> DataFrame:
        """One cell by its 0-based row in the view; empty past the last row."""
        return edit.select(self.page(row, 1), [self.column(column)])

    def row_count(self) -> DataFrame:
        return flt.filtered_count(self.df, self.filters)

    # --- edits: a new file, then a new handle ---

    def rewritten(self, df: DataFrame) -> Table:
        """Write ``df`` beside the current file and return a handle on it."""
        if self.path is None:
            return replace(self, df=df, kinds=logical_types(df))
        path = new_path(self.path)
        write_table(df, path)
        fresh = df.sparkSession.read.schema(df.schema).parquet(path)
        empty = {n: k for n, k in self.kinds.items() if k.is_empty and n in fresh.columns}
        return replace(self, df=fresh, path=path, kinds={**logical_types(fresh), **empty})

    def retype(self, column: int | str, to: LogicalType, lenient_int: bool = False) -> Table:
        name = self.column(column)
        return self.rewritten(edit.retype(self.df, name, to, lenient_int)).mark_empty(name)

    def update_cell(self, row: int, column: int | str, value, key: Sequence[str] = ()) -> Table:
        """Replace one cell by its 0-based row in the filtered and sorted view.

        Of a stored table only the file that holds the row is written anew; the new handle's
        version names it and all other files. A row past the last changes nothing.
        """
        name = self.column(column)
        if self.path is None:
            order = flt.ordering(self.filters)
            return self.rewritten(edit.update_cell(self.df, row, name, value, order, self.filters, key)).mark_empty(name)
        found = self._place(row, [*flt.ordering(self.filters), *[(k, True) for k in key]])
        if found is None:
            return self
        spark_type = self.df.schema[name].dataType
        new = edit.edited_value(value, classify(spark_type)).cast(spark_type)
        path = versions.with_cell(self.df, self.path, *found, name, new)
        return replace(self, df=read_parquet(self.df.sparkSession, path), path=path).mark_empty(name)

    def _place(self, row: int, order: Order) -> tuple[str, int] | None:
        """The file and the place in it of a row of the view."""
        if row < 0:
            return None
        own = {"__path": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")}
        view = flt.apply(self.df.withColumns(own), self.filters)
        if order:
            ranks = RankIndex(view, order, self._ranks(order).stretches)
            found = ranks.rows(row, 1).select("__path", F.col("__at").alias("at")).first()
        else:
            found = file_slice(view, row, 1).select("__path", F.col(PLACE[1][0]).alias("at")).first()
        return None if found is None else (found["__path"], found["at"])

    # --- new tables from tables ---

    def merge(
        self,
        other: Table,
        how: str,
        pairs: merging.Pairs | None = None,
        name: str | None = None,
        folder: str | None = None,
    ) -> Table:
        """Join with (or for ``how="union"`` append) another table, stored as a new one.

        Without ``pairs`` the columns of equal names are joined, whatever their case.
        """
        folder = folder or _folder_of(other)
        if how == "union":
            made = merging.union(self.df, other.df)
        else:
            keys = merging.auto_keys(self.columns, other.columns) if pairs is None else pairs
            made = merging.join(self.df, other.df, how, keys)
        return _stored(made, folder, name or merging.result_name(self.alias, other.alias))

    def subtable(
        self,
        by: int | str,
        aggregates: dict[str, str],
        name: str,
        use_filters: bool = False,
        folder: str | None = None,
    ) -> Table:
        """Group by one column, stored as a new table; the filters apply if asked."""
        folder = folder or _folder_of(self)
        filters = self.filters if use_filters else ()
        made = grouped(self.df, self.column(by), aggregates, filters, self.kinds)
        return _stored(made, folder, name)

    def renamed(self, alias: str) -> Table:
        return replace(self, alias=alias)


def _folder_of(table: Table) -> str:
    if table.path is None:
        raise ValueError(f"table {table.alias!r} is not stored; name a folder for the result")
    return posixpath.dirname(table.path.rstrip("/"))


def _stored(df: DataFrame, folder: str, name: str) -> Table:
    path = posixpath.join(folder, f"{name}.parquet")
    write_table(df, path)
    return Table.open(df.sparkSession, path, name)


class Catalog:
    """The tables that are open, by alias, each also a temporary view."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, Table] = {}

    def add(self, *tables: Table) -> None:
        for table in tables:
            self._tables[table.alias] = table
            table.df.createOrReplaceTempView(quoted(table.alias))

    def remove(self, alias: str) -> None:
        del self._tables[alias]
        self.spark.catalog.dropTempView(alias)

    def __getitem__(self, alias: str) -> Table:
        return self._tables[alias]

    def __iter__(self) -> Iterable[Table]:
        return iter(self._tables.values())

    def __len__(self) -> int:
        return len(self._tables)

    def inventory(self) -> DataFrame:
        """One row per table: path, alias, rows after filters, columns and size."""
        return inventory(self.spark, list(self))


def inventory(spark: SparkSession, tables: Sequence[Table]) -> DataFrame:
    if not tables:
        shape = (
            "path string, alias string, row_count bigint, column_count bigint, "
            "bytes bigint, size string"
        )
        return spark.createDataFrame([], shape)
    sizes = stored_bytes(spark, [table.path for table in tables if table.path and not versions.is_version(table.path)])
    for table in tables:
        if table.path and versions.is_version(table.path):
            own = listing(spark, *table.df.inputFiles())
            sizes[table.path] = own.agg(F.sum("length")).first()[0]
    rows = [
        table.row_count().select(
            F.lit(table.path).cast("string").alias("path"),
            F.lit(table.alias).alias("alias"),
            "row_count",
            F.lit(len(table.columns)).cast("bigint").alias("column_count"),
            F.lit(sizes.get(table.path)).cast("bigint").alias("bytes"),
        )
        for table in tables
    ]
    return with_human_size(reduce(DataFrame.unionAll, rows))


def with_human_size(df: DataFrame) -> DataFrame:
    """Add ``size``, the text of ``bytes`` in steps of 1024."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB", "EB")])
    size = F.col("bytes").cast("double")
    step = F.lit(0)
    for power in range(1, 7):
        step = step + F.when(F.col("bytes") >= F.lit(1024**power), 1).otherwise(0)
    scaled = F.format_string("%.1f %s", size / F.pow(F.lit(1024.0), step), units[step])
    small = F.format_string("%d B", F.col("bytes"))
    return df.withColumn("size", F.when(F.col("bytes") < 1024, small).otherwise(scaled))


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> dict[str, int]:
    """Bytes of the files of each path, from one file listing."""
    if not paths:
        return {}
    sums = []
    for i, path in enumerate(paths):
        place = path.rstrip("/").removeprefix("file://").removeprefix("file:")
        inside = F.col("path").endswith(place) | F.col("path").contains(place + "/")
        sums.append(F.sum(F.when(inside, F.col("length"))).alias(f"b{i}"))
    row = listing(spark, *dict.fromkeys(paths)).agg(*sums).first()
    return {path: row[f"b{i}"] for i, path in enumerate(paths)}
