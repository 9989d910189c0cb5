"""Text to typed value. Every cast yields null for a value it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.types import LogicalType

# The texts read as booleans, and the date layouts in trial order.
TRUE_TEXTS = ("true", "t", "yes", "y", "1")
FALSE_TEXTS = ("false", "f", "no", "n", "0")
DATE_LAYOUTS = ("d/M/y", "y-M-d", "M/d/y")

# A failed parse costs an exception, so the patterns let through little that fails.
_DATE_PARTS = {"d": r"(0?[1-9]|[12]\d|3[01])", "M": r"(0?[1-9]|1[0-2])", "y": r"\d{1,4}"}
_INTEGER = r"^\s*[+-]?\d+\s*$"
# Java also reads 1d, 1f and hex floats; this keeps those out.
_DECIMAL = r"(?i)^\s*[+-]?((\d+{point}?\d*|{point}\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"
_ISO_DATE = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"


def to_integer(text: Column, lenient: bool = False) -> Column:
    """32-bit integer. ``lenient`` also rounds decimal texts, halves to even."""
    if lenient:
        return F.rint(to_double(text, comma=False)).try_cast("int")
    whole = text.try_cast("bigint")
    fits = F.when(whole.between(-(2**31), 2**31 - 1), whole.cast("int"))
    return F.when(text.rlike(_INTEGER), fits)


def to_double(text: Column, comma: bool = True) -> Column:
    """Double; ``comma`` reads a decimal comma as a decimal point."""
    if not comma:
        return F.when(text.rlike(_DECIMAL.replace("{point}", r"\.")), text.try_cast("double"))
    pointed = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(text.rlike(_DECIMAL.replace("{point}", "[.,]")), pointed)


def to_boolean(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.isin(*TRUE_TEXTS), F.lit(True)).when(
        lowered.isin(*FALSE_TEXTS), F.lit(False)
    )


def _parsed(text: Column, layout: str) -> Column:
    shape = r"^\s*" + "".join(_DATE_PARTS.get(c, c) for c in layout) + r"\s*$"
    return F.when(text.rlike(shape), F.try_to_date(F.trim(text), layout))


def to_date(text: Column) -> Column:
    """Date by the first layout that fits: day first, year first, month first."""
    day_first, year_first, month_first = (_parsed(text, layout) for layout in DATE_LAYOUTS)
    # No text fits both a slash and a dash layout; looking for the sign is cheap.
    slashed = F.coalesce(day_first, month_first)
    return F.when(text.contains("/"), slashed).when(text.contains("-"), year_first)


def to_timestamp(text: Column) -> Column:
    """Midnight of :func:`to_date`, as ingested date columns are stored."""
    return to_date(text).cast("timestamp_ntz")


def iso_to_date(text: Column) -> Column:
    """Date of an ISO text, a time of day after it is dropped."""
    parts = [F.regexp_extract(text, _ISO_DATE, i) for i in (1, 2, 3)]
    return F.when(text.rlike(_ISO_DATE), F.try_to_date(F.concat_ws("-", *parts), "y-M-d"))


#: What :func:`fits` marks each type with.
FIT_BITS = {LogicalType.BOOLEAN: 1, LogicalType.INTEGER: 2, LogicalType.DOUBLE: 4, LogicalType.DATE: 8}


def fits(text: Column, lenient_int: bool = False) -> Column:
    """The types whose cast of a text is not null, as bits; null for a null text.

    One look at a text's shape settles most: a text without a digit is no date, and no number but by
    name; what has the shape of a number is one, so it is not parsed but for the range of integers.
    """
    bit = lambda kind, test: F.when(test, FIT_BITS[kind]).otherwise(0)
    number = text.rlike(_DECIMAL.replace("{point}", "[.,]"))
    if lenient_int:
        whole = bit(LogicalType.INTEGER, to_integer(text, True).isNotNull())
    else:
        whole = bit(LogicalType.INTEGER, to_integer(text).isNotNull())
    # A date has a slash or a dash, which no number has but as its sign or its exponent's.
    dated = (text.contains("/") | text.contains("-")) & text.rlike("[0-9]")
    named = F.when(F.length(text) <= 5, bit(LogicalType.BOOLEAN, to_boolean(text).isNotNull())).otherwise(0)
    numbers = F.when(number, F.lit(FIT_BITS[LogicalType.DOUBLE]) + whole).otherwise(0)
    dates = F.when(dated, bit(LogicalType.DATE, to_date(text).isNotNull())).otherwise(0)
    return F.when(text.isNotNull(), named + numbers + dates)


def cast_text(text: Column, to: LogicalType, lenient_int: bool = False) -> Column:
    """The ingest cast of a text column to the type the vote chose."""
    if to is LogicalType.INTEGER:
        return to_integer(text, lenient_int)
    if to is LogicalType.DOUBLE:
        return to_double(text)
    if to is LogicalType.BOOLEAN:
        return to_boolean(text)
    if to is LogicalType.DATE:
        return to_timestamp(text)
    return text


def recast(column: Column, have: LogicalType, to: LogicalType, lenient_int: bool = False) -> Column:
    """Change a typed column to another logical type, unreadable values to null."""
    target = to.spark_type
    if to in (LogicalType.STRING, LogicalType.EMPTY):
        return column.cast(target)
    if have in (LogicalType.STRING, LogicalType.EMPTY):
        return {
            LogicalType.INTEGER: lambda: to_integer(column, lenient_int),
            LogicalType.DOUBLE: lambda: to_double(column, comma=False),
            LogicalType.BOOLEAN: lambda: to_boolean(column),
            LogicalType.DATE: lambda: iso_to_date(column),
        }[to]()
    if (have is LogicalType.DATE) != (to is LogicalType.DATE):
        return F.lit(None).cast(target)
    if have is LogicalType.DOUBLE and to is LogicalType.INTEGER:
        return F.rint(column).try_cast(target)
    return column.try_cast(target)
