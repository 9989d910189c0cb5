"""Colonnade: column profiling, table shaping and chart-ready data on Spark.

Every public function takes DataFrames (or a :class:`~colonnade.table.Table`
handle around one) and returns DataFrames, so plans stay lazy and Catalyst sees
the whole query.
"""

from colonnade.table import Catalog, Table
from colonnade.types import LogicalType

__all__ = ["Catalog", "LogicalType", "Table"]
