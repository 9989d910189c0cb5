"""The most frequent values, exactly, without grouping a whole column where a sketch can prove them.

A sketch of bounded size names candidates in one scan. Its error bound says how often any other
value can occur at most. The candidates are then counted exactly, in a scan that reads
only them; those that occur more often than anything else can are the answer. Where the bound does
not decide, as for values that are all rare, the column is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.types import col, field_type

#: Values that the sketch keeps count of, and candidates taken from it.
TRACKED = 10_000
CANDIDATES = 1_000
#: A value that the sketch does not name occurs at most in this share of rows: twice its largest error,
#: which is 3.5 rows in as many as its table has places, and it has more than it tracks values.
_UNNAMED = 7.0 / TRACKED

_SKETCHED = (T.IntegralType, T.StringType, T.DateType, T.BooleanType, T.DoubleType, T.TimestampNTZType)


def _literal(value, kind: T.DataType) -> Column:
    # A bare literal of a time would be one with a zone.
    return F.lit(str(value)).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(value)


def frequent(df: DataFrame, column: str, k: int) -> DataFrame | None:
    """``(value, frequency)`` of the ``k`` most frequent present values, equal ones by value, or None if a sketch cannot prove them."""
    kind = field_type(df, column)
    if not isinstance(kind, _SKETCHED) or k > CANDIDATES:
        return None
    present = df.select(col(column).alias("value")).where("value is not null")
    row = present.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(value, {CANDIDATES}, {TRACKED})").alias("top")).first()
    if not row["top"]:
        return None
    most = row["n"] * _UNNAMED
    if len(row["top"]) == CANDIDATES:  # more may be named, none more often than the last
        most = max(most, row["top"][-1]["count"])
    named = present.where(F.col("value").isin(*[_literal(r["item"], kind) for r in row["top"]]))
    counts = named.groupBy("value").agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), F.asc("value")).collect()
    rest = row["n"] - sum(r["frequency"] for r in counts)
    decided = rest == 0 or (len(counts) >= k and counts[k - 1]["frequency"] > min(most, rest))
    if not decided:
        return None
    schema = T.StructType([T.StructField("value", kind), T.StructField("frequency", T.LongType())])
    return df.sparkSession.createDataFrame(counts[:k], schema)
