"""A table with the defects real files have, for trying ingest at any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The defects that are planted.
BAD_NAMES = ("123456", "???", "N/A", "<script>", "   ")
BAD_EMAILS = (
    "notanemail", "@nodomain", "missing@", "double@@domain.com",
    "spaces in@email.com", "nodot@com", "missing.at.sign",
)
BAD_NUMBERS = ("-999", "abc", "NaN", "999999", "--", "1.5.3", "inf", "", "null", "??")
BAD_DATES = (
    "32/13/2023", "00/00/0000", "31/02/2021", "29/02/2023",
    "13/13/2013", "2023-99-99", "not_a_date", "01/01/10000",
    "-1/-1/-1", "2020/31/12",
)

_FIRST = ("Ada", "Bo", "Chen", "Dana", "Emil", "Fatou", "Goran", "Hana", "Ines", "Jon")
_LAST = ("Abel", "Berg", "Costa", "Diallo", "Evans", "Fischer", "Garcia", "Haddad", "Ito", "Jensen")
_SIZES = {"kb": 1024, "mb": 1024**2, "gb": 1024**3}


def _uniform(seed: int, stream: int) -> Column:
    """A number in [0, 1) that depends on the row id only, not on partitioning."""
    bits = F.xxhash64("id", F.lit(seed), F.lit(stream)).bitwiseAND(F.lit((1 << 53) - 1))
    return bits / F.lit(float(1 << 53))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.floor(at * len(values)).cast("int")]


def _whole(low: int, high: int, at: Column) -> Column:
    return F.floor(at * (high - low + 1)).cast("int") + F.lit(low)


def _dirty(good: Column, roll: Column, *bad: tuple[float, Column]) -> Column:
    """4 % empty, 3 % the text NULL, then the given shares of bad values."""
    out = F.when(roll < 0.04, "").when(roll < 0.07, "NULL")
    edge = 0.07
    for share, value in bad:
        edge += share
        out = out.when(roll < edge, value)
    return out.otherwise(good)


def dirty_table(spark: SparkSession, rows: int, seed: int = 0, with_date: bool = True) -> DataFrame:
    """``id, name, email, age, date`` as texts; the same rows for the same seed."""
    u = [_uniform(seed, i) for i in range(12)]
    first, last = _pick(_FIRST, u[0]), _pick(_LAST, u[1])
    handle = F.concat(F.lower(first), F.lit("."), F.lower(last), F.col("id"))
    born = F.date_add(F.lit("1970-01-01").cast("date"), _whole(0, 20000, u[2]))
    columns = [
        F.col("id").cast("string").alias("id"),
        _dirty(F.concat_ws(" ", first, last), u[3], (0.02, _pick(BAD_NAMES, u[4]))).alias("name"),
        _dirty(
            F.concat(handle, F.lit("@example.org")), u[5], (0.05, _pick(BAD_EMAILS, u[6]))
        ).alias("email"),
        _dirty(
            _whole(18, 80, u[7]).cast("string"),
            u[8],
            (0.05, _pick(BAD_NUMBERS, u[9])),
            (0.02, _whole(150, 999, u[9]).cast("string")),
        ).alias("age"),
    ]
    if with_date:
        date = _dirty(born.cast("string"), u[10], (0.05, _pick(BAD_DATES, u[11])))
        columns.append(date.alias("date"))
    return spark.range(1, rows + 1).select(*columns)


def parse_size(text: str) -> tuple[int, bool]:
    """``(number, is_bytes)`` from a row count or a size such as ``10MB``."""
    unit = text[-2:].lower()
    if unit in _SIZES:
        return int(text[:-2]) * _SIZES[unit], True
    return int(text), False


def dirty_table_of_size(spark: SparkSession, size: int, seed: int = 0) -> DataFrame:
    """About ``size`` bytes of CSV lines; this form has no date column."""
    probe = dirty_table(spark, 10_000, seed, with_date=False)
    width = F.length(F.concat_ws(",", *probe.columns)) + 1
    mean = probe.agg(F.avg(width)).first()[0]
    return dirty_table(spark, max(math.ceil(size / mean), 1), seed, with_date=False)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("emptyValue", "").csv(path)
    return path
