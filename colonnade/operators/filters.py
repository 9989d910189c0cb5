"""Filter specifications and their compilation to one Catalyst predicate.

A specification is plain data (it round-trips through JSON). Values are typed
from the column they meet, and the literal - never the column - is converted, so
comparisons reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import datetime
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.types import LogicalType, classify, col, field_type, is_nested


class Op(str, Enum):
    EQUAL = "EQUAL"
    NOT_EQUAL = "NOT_EQUAL"
    GREATER = "GREATER"
    GREATER_EQUAL = "GREATER_EQUAL"
    LESS = "LESS"
    LESS_EQUAL = "LESS_EQUAL"
    LIKE = "LIKE"
    IS_NULL = "IS_NULL"
    NOT_NULL = "NOT_NULL"


class Func(str, Enum):
    NONE = "NONE"
    LENGTH = "LENGTH"


class Logic(str, Enum):
    AND = "AND"
    OR = "OR"


class Sort(str, Enum):
    NONE = "NONE"
    ASCENDING = "ASCENDING"
    DESCENDING = "DESCENDING"


_ORDERED = (Op.GREATER, Op.GREATER_EQUAL, Op.LESS, Op.LESS_EQUAL)
_NULL_TESTS = (Op.IS_NULL, Op.NOT_NULL)
_COMPARABLE = (Op.EQUAL, Op.NOT_EQUAL, *_ORDERED, *_NULL_TESTS)


@dataclass(frozen=True)
class Condition:
    op: Op
    value: str | None = None
    func: Func = Func.NONE


@dataclass(frozen=True)
class Filter:
    """Conditions on one column, joined by ``logic``, and an optional sort.

    ``logic`` also joins this filter to the next one that has conditions.
    """

    column: str
    conditions: tuple[Condition, ...] = ()
    logic: Logic = Logic.AND
    sort: Sort = Sort.NONE

    def joined_by(self, logic: Logic | str) -> Filter:
        return replace(self, logic=Logic(logic))


def _text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def where(column: str, op: Op | str, value=None, func: Func | str = Func.NONE) -> Filter:
    text = None if value is None else _text(value)
    return Filter(column, (Condition(Op(op), text, Func(func)),))


def equal(column: str, value) -> Filter:
    return where(column, Op.EQUAL, value)


def search(column: str, text: str) -> Filter:
    """Case-sensitive substring; ``%`` and ``_`` in the text are wildcards."""
    return where(column, Op.LIKE, text)


def above(column: str, threshold) -> Filter:
    return where(column, Op.GREATER, threshold)


def below(column: str, threshold) -> Filter:
    return where(column, Op.LESS, threshold)


def longer_than(column: str, length: int) -> Filter:
    return where(column, Op.GREATER, length, Func.LENGTH)


def shorter_than(column: str, length: int) -> Filter:
    return where(column, Op.LESS, length, Func.LENGTH)


def _bound(value):
    """Texts of numbers or times as values that compare in their own order."""
    if not isinstance(value, str):
        return value
    try:
        return Decimal(value)
    except ArithmeticError:
        return datetime.fromisoformat(value)


def _range(column: str, low, high, func: Func) -> Filter:
    low, high = sorted((_bound(low), _bound(high)))
    bounds = (
        Condition(Op.GREATER_EQUAL, _text(low), func),
        Condition(Op.LESS_EQUAL, _text(high), func),
    )
    return Filter(column, bounds)


def between(column: str, low, high) -> Filter:
    """Inclusive range of numbers or of times; bounds may come in either order."""
    return _range(column, low, high, Func.NONE)


def length_between(column: str, low: int, high: int) -> Filter:
    return _range(column, low, high, Func.LENGTH)


def show_empty(column: str) -> Filter:
    return where(column, Op.IS_NULL)


def hide_empty(column: str) -> Filter:
    return where(column, Op.NOT_NULL)


def sort_by(column: str, ascending: bool = True) -> Filter:
    return Filter(column, sort=Sort.ASCENDING if ascending else Sort.DESCENDING)


# --- typing a value from the column it is compared with ------------------------


def _malformed(value, spark_type: T.DataType) -> ValueError:
    return ValueError(f"{value!r} is not a {spark_type.simpleString()} value")


# The least and the largest number of each whole type.
_RANGES = {
    kind: (-(2**bits), 2**bits - 1)
    for kind, bits in ((T.ByteType, 7), (T.ShortType, 15), (T.IntegerType, 31), (T.LongType, 63))
}


def _compare_integer(column: Column, op: Op, value: str, spark_type: T.DataType) -> Column:
    """Compare whole numbers with any number, without casting the column.

    A fractional bound moves to the whole number that gives the same rows; one that the
    column's own type cannot hold keeps all present values or none.
    """
    try:
        number = Decimal(value)
    except ArithmeticError:
        raise _malformed(value, spark_type) from None
    never = F.lit(False)
    always = column.isNotNull()
    least, most = _RANGES[type(spark_type)]

    def beyond(high: bool) -> Column:
        if op in (Op.GREATER, Op.GREATER_EQUAL):
            return never if high else always
        if op in (Op.LESS, Op.LESS_EQUAL):
            return always if high else never
        return never if op is Op.EQUAL else always

    if number.is_nan() or number > most or number < least:
        return beyond(high=number.is_nan() or number > 0)
    whole = number == number.to_integral_value()
    if op in (Op.EQUAL, Op.NOT_EQUAL) and not whole:
        return never if op is Op.EQUAL else always
    bound = math.floor(number) if op in (Op.GREATER, Op.LESS_EQUAL) else math.ceil(number)
    return _apply(column, op, F.lit(bound).cast(spark_type))


def _literal(value: str, spark_type: T.DataType) -> Column:
    try:
        if isinstance(spark_type, T.DecimalType):
            return F.lit(Decimal(value))
        if isinstance(spark_type, T.NumericType):
            return F.lit(float(value)).cast(spark_type)
        if isinstance(spark_type, T.BooleanType):
            return F.lit({"true": True, "false": False}[value.strip().lower()])
        if isinstance(spark_type, T.DateType):
            # A time of day in the literal is dropped, the column stays a date.
            return F.lit(datetime.fromisoformat(value).date())
        if isinstance(spark_type, (T.TimestampType, T.TimestampNTZType)):
            moment = datetime.fromisoformat(value)
            return F.lit(moment.isoformat(sep=" ")).cast(spark_type)
    except (ArithmeticError, KeyError, ValueError):
        raise _malformed(value, spark_type) from None
    return F.lit(value)


def _apply(column: Column, op: Op, literal: Column) -> Column:
    if op is Op.EQUAL:
        return column == literal
    if op is Op.NOT_EQUAL:
        return column != literal
    if op is Op.GREATER:
        return column > literal
    if op is Op.GREATER_EQUAL:
        return column >= literal
    if op is Op.LESS:
        return column < literal
    return column <= literal


def compile_condition(condition: Condition, column: str, spark_type: T.DataType) -> Column:
    op, value = condition.op, condition.value
    target = col(column)
    if op is Op.IS_NULL:
        return target.isNull()
    if op is Op.NOT_NULL:
        return target.isNotNull()
    if value is None:
        raise ValueError(f"{op.value} on {column!r} needs a value")
    if is_nested(spark_type):
        raise ValueError(f"column {column!r} is {spark_type.simpleString()}: only null tests apply")
    is_text = classify(spark_type) is LogicalType.STRING
    if condition.func is Func.LENGTH:
        if not is_text or op is Op.LIKE:
            raise ValueError(f"LENGTH applies to comparisons on text, not to {op.value} on {column!r}")
        return _compare_integer(F.length(target), op, value, T.IntegerType())
    if op is Op.LIKE:
        if not is_text:
            raise ValueError(f"LIKE needs a text column, {column!r} is {spark_type.simpleString()}")
        return target.like("%" + value.replace("\\", "\\\\") + "%")
    if is_text and op in _ORDERED:
        raise ValueError(f"text column {column!r} has no order filter; compare its LENGTH")
    if isinstance(spark_type, T.IntegralType):
        return _compare_integer(target, op, value, spark_type)
    return _apply(target, op, _literal(value, spark_type))


# --- composing ---------------------------------------------------------------


def _any_of_all(terms: Sequence[Column], joins: Sequence[Logic]) -> Column:
    """Join terms left to right with AND binding tighter than OR."""
    groups = [terms[0]]
    for logic, term in zip(joins, terms[1:], strict=True):
        if logic is Logic.AND:
            groups[-1] = groups[-1] & term
        else:
            groups.append(term)
    result = groups[0]
    for group in groups[1:]:
        result = result | group
    return result


def predicate(filters: Iterable[Filter], df: DataFrame, grouped: bool = False) -> Column | None:
    """The filters as one condition, or ``None`` when none restricts rows.

    Conditions chain without parentheses, as if typed one after the other;
    ``grouped`` puts each filter's own conditions in parentheses first.
    """
    terms: list[Column] = []
    joins: list[Logic] = []
    for item in filters:
        if not item.conditions:
            continue
        spark_type = field_type(df, item.column)
        own = [compile_condition(c, item.column, spark_type) for c in item.conditions]
        inner = [item.logic] * (len(own) - 1)
        if grouped:
            own, inner = [_any_of_all(own, inner)], []
        terms += own
        joins += [*inner, item.logic]
    return _any_of_all(terms, joins[:-1]) if terms else None


def apply(df: DataFrame, filters: Iterable[Filter], grouped: bool = False) -> DataFrame:
    condition = predicate(filters, df, grouped)
    return df if condition is None else df.where(condition)


def ordering(filters: Iterable[Filter]) -> list[tuple[str, bool]]:
    """``[(column, ascending)]`` of the last filter that sorts, else empty."""
    sorts = [f for f in filters if f.sort is not Sort.NONE]
    return [(sorts[-1].column, sorts[-1].sort is Sort.ASCENDING)] if sorts else []


def filtered_count(df: DataFrame, filters: Iterable[Filter], grouped: bool = False) -> DataFrame:
    return apply(df, filters, grouped).agg(F.count(F.lit(1)).alias("row_count"))


# --- editing and storing specifications ----------------------------------------


def clear_column(filters: Iterable[Filter], column: str) -> list[Filter]:
    return [f for f in filters if f.column != column]


def to_json(filters: Iterable[Filter]) -> str:
    return json.dumps([asdict(f) for f in filters])


def from_json(text: str) -> list[Filter]:
    return [
        Filter(
            item["column"],
            tuple(
                Condition(Op(c["op"]), c["value"], Func(c["func"])) for c in item["conditions"]
            ),
            Logic(item["logic"]),
            Sort(item["sort"]),
        )
        for item in json.loads(text)
    ]


# --- which operators a column offers ---------------------------------------------


def allowed_operators(kind: LogicalType, has_categories: bool = False) -> tuple[Op, ...]:
    """Operators offered for a column; text with categories is picked, not searched."""
    if kind.is_numeric or kind.is_date:
        return _COMPARABLE
    if kind.is_empty:
        return _NULL_TESTS
    if kind is LogicalType.STRING and not has_categories:
        return (Op.EQUAL, Op.LIKE, Op.NOT_EQUAL, *_NULL_TESTS)
    return (Op.EQUAL, *_NULL_TESTS)


def check_allowed(item: Filter, kind: LogicalType, has_categories: bool = False) -> None:
    allowed = allowed_operators(kind, has_categories)
    for condition in item.conditions:
        measured = condition.func is Func.LENGTH and kind is LogicalType.STRING
        if condition.op not in (_COMPARABLE if measured else allowed):
            raise ValueError(f"{condition.op.value} is not offered for {kind.value} column {item.column!r}")


def needs_free_text(item: Filter) -> bool:
    """Whether a condition is offered for free text, but not for text with categories."""
    free = allowed_operators(LogicalType.STRING)
    picked = allowed_operators(LogicalType.STRING, has_categories=True)
    return any(c.op in free and c.op not in picked and c.func is not Func.LENGTH for c in item.conditions)
