"""Dates and times as numbers, by the wall clock, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000


def to_micros(moment: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a date or time."""
    wall = moment.cast("timestamp_ntz")
    seconds = F.unix_date(wall.cast("date")).cast("bigint") * 86_400
    seconds += F.hour(wall) * 3600 + F.minute(wall) * 60
    fraction = F.extract(F.lit("SECOND"), wall) * F.lit(_SECOND)
    return seconds * _SECOND + fraction.cast("bigint")


def from_micros(micros: Column) -> Column:
    """The time without zone that many microseconds after 1970-01-01 00:00."""
    seconds = (micros.cast("decimal(18,0)") / F.lit(_SECOND)).cast("decimal(18,6)")
    zero = F.lit(0)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(zero, zero, zero, seconds)
