"""The closed set of logical column types and how Spark types map onto it."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LogicalType(str, Enum):
    INTEGER = "INTEGER"
    DOUBLE = "DOUBLE"
    BOOLEAN = "BOOLEAN"
    DATE = "DATE"
    STRING = "STRING"
    EMPTY = "EMPTY"

    @property
    def is_numeric(self) -> bool:
        return self in (LogicalType.INTEGER, LogicalType.DOUBLE)

    @property
    def is_categorical(self) -> bool:
        return self in (LogicalType.STRING, LogicalType.BOOLEAN)

    @property
    def is_date(self) -> bool:
        return self is LogicalType.DATE

    @property
    def is_empty(self) -> bool:
        return self is LogicalType.EMPTY

    @property
    def sql_name(self) -> str:
        """The type name a column of this kind is declared with."""
        text = (LogicalType.STRING, LogicalType.EMPTY)
        return "VARCHAR" if self in text else self.value

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPES[self]


_SPARK_TYPES = {
    LogicalType.INTEGER: T.IntegerType(),
    LogicalType.DOUBLE: T.DoubleType(),
    LogicalType.BOOLEAN: T.BooleanType(),
    LogicalType.DATE: T.DateType(),
    LogicalType.STRING: T.StringType(),
    LogicalType.EMPTY: T.StringType(),
}

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def classify(spark_type: T.DataType) -> LogicalType:
    """Logical type of one Spark type; decimals count as numbers."""
    if isinstance(spark_type, T.IntegralType):
        return LogicalType.INTEGER
    if isinstance(spark_type, T.NumericType):
        return LogicalType.DOUBLE
    if isinstance(spark_type, T.BooleanType):
        return LogicalType.BOOLEAN
    if isinstance(spark_type, _DATES):
        return LogicalType.DATE
    return LogicalType.STRING


def is_nested(spark_type: T.DataType) -> bool:
    return isinstance(spark_type, _NESTED)


def logical_types(df: DataFrame) -> dict[str, LogicalType]:
    return {field.name: classify(field.dataType) for field in df.schema}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col(quoted(name))


def field_type(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema:
        if field.name == name:
            return field.dataType
    raise ValueError(f"no column {name!r}; columns are {df.columns}")


def require(df: DataFrame, name: str, *allowed: LogicalType) -> T.DataType:
    """Type of a column, or ``ValueError`` when its logical type does not fit."""
    spark_type = field_type(df, name)
    if classify(spark_type) not in allowed or is_nested(spark_type):
        wanted = ", ".join(kind.value for kind in allowed)
        raise ValueError(f"column {name!r} is {spark_type.simpleString()}, needs {wanted}")
    return spark_type


def require_numeric(df: DataFrame, name: str) -> T.DataType:
    return require(df, name, LogicalType.INTEGER, LogicalType.DOUBLE)


def check_distinct_names(names: list[str]) -> None:
    """Spark resolves names ignoring case, so names must differ beyond case."""
    seen: dict[str, str] = {}
    for name in names:
        other = seen.setdefault(name.lower(), name)
        if other is not name:
            raise ValueError(f"columns {other!r} and {name!r} differ only in case")
