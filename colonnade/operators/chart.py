"""Chart series and the layout numbers of their marks.

Series are grouped sums in long form: ``(series, category, value)`` for two levels
and ``(category, value)`` for one. Layout functions take such a frame; one-level
frames count as a single unnamed series.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.aggregates import summed
from colonnade.operators import filters as flt
from colonnade.operators.ordered import running_sums
from colonnade.types import col, require_numeric

# Outer groups a chart may have, and the range of axis steps.
MAX_OUTER_GROUPS = 20
MAX_AXIS_STEPS = 50
DEFAULT_AXIS_STEPS = 5


class TooManyGroups(ValueError):
    """More outer groups than a chart can show."""


def _grouped(
    df: DataFrame,
    keys: dict[str, str],
    value: str,
    filters: Iterable[flt.Filter],
    percentage: bool,
    denominator: str,
) -> DataFrame:
    spark_type = require_numeric(df, value)
    if denominator not in ("all", "filtered"):
        raise ValueError("denominator must be 'all' or 'filtered'")
    kept = flt.apply(df, filters)
    # A group without any value is drawn as zero.
    total = F.coalesce(summed(col(value), spark_type).cast("double"), F.lit(0.0))
    grouped = kept.groupBy(*[col(name).alias(alias) for alias, name in keys.items()]).agg(
        total.alias("value")
    )
    if not percentage:
        return grouped
    if kept is df or denominator == "filtered":
        # The groups hold the whole total, so the table is scanned once.
        base = grouped.agg(F.sum("value")).scalar()
    else:
        base = df.agg(summed(col(value), spark_type).cast("double")).scalar()
    return grouped.withColumn("value", F.try_divide(F.col("value") * 100.0, base))


def series(
    df: DataFrame,
    group: str,
    value: str,
    filters: Iterable[flt.Filter] = (),
    percentage: bool = False,
    denominator: str = "all",
) -> DataFrame:
    """``(category, value)``: the sum per category, or its share of the column total.

    The share is of the unfiltered total unless ``denominator`` is ``"filtered"``.
    """
    return _grouped(df, {"category": group}, value, filters, percentage, denominator)


def group_series(
    df: DataFrame,
    outer: str,
    group: str,
    value: str,
    filters: Iterable[flt.Filter] = (),
    percentage: bool = False,
    denominator: str = "all",
) -> DataFrame:
    """``(series, category, value)``: the sum per outer group and category."""
    keys = {"series": outer, "category": group}
    return _grouped(df, keys, value, filters, percentage, denominator)


def ordered(frame: DataFrame) -> DataFrame:
    """Series then category, nulls last, as marks are drawn."""
    keys = [name for name in ("series", "category") if name in frame.columns]
    return frame.orderBy(*[F.col(name).asc_nulls_last() for name in keys])


def check_outer_groups(frame: DataFrame, most: int = MAX_OUTER_GROUPS) -> None:
    """Raise :class:`TooManyGroups` beyond ``most``; looks at no more than it must."""
    seen = frame.select("series").distinct().limit(most + 1).count()
    if seen > most:
        raise TooManyGroups(f"a chart shows at most {most} outer groups")


def dense(frame: DataFrame, most: int = MAX_OUTER_GROUPS) -> DataFrame:
    """Give every series every category, zero where there was none.

    Adds ``first_series``: categories appear in the order
    ``(first_series, category)``, nulls last. Raises :class:`TooManyGroups` beyond ``most``
    series, since each category's row holds a value for all of them.
    """
    # The groups are read for two things, over one exchange.
    check_outer_groups(frame, most)
    # Wrapped in structs because collect_set skips bare nulls. At most ``most`` entries.
    names = frame.agg(F.collect_set(F.struct(F.col("series").alias("name")))).scalar()
    per_category = frame.groupBy("category").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct(F.col("series").alias("name")), F.col("value")))
        ).alias("values"),
        # min ignores nulls, so a null series comes first only when it is the only one.
        F.min("series").alias("first_series"),
    )
    return per_category.select("*", F.explode(names).alias("s")).select(
        F.col("s.name").alias("series"),
        "category",
        F.coalesce(F.col("values")[F.col("s")], F.lit(0.0)).alias("value"),
        "first_series",
    )


# --- layout ------------------------------------------------------------------------


def _series_key(frame: DataFrame) -> list[str]:
    return ["series"] if "series" in frame.columns else []


def _with_series(frame: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Add aggregates of each series to its rows."""
    made = [value.alias(name) for name, value in aggregates.items()]
    if not _series_key(frame):
        one = frame.agg(F.struct(*made)).scalar()
        wide = frame.withColumn("__agg", one)
        return wide.select(*frame.columns, *[F.col(f"__agg.{n}").alias(n) for n in aggregates])
    totals = frame.groupBy(F.col("series").alias("__series")).agg(*made)
    joined = frame.join(totals, F.col("series").eqNullSafe(F.col("__series")), "left")
    return joined.drop("__series")


def _zero_as_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def _positive_or_one(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(1.0))


def _running(frame: DataFrame, sums: dict[str, Column]) -> DataFrame:
    return running_sums(frame, _series_key(frame), [("category", True)], sums)


def pie_angles(frame: DataFrame) -> DataFrame:
    """Start and end angle of each slice in degrees; slices follow the categories."""
    summed = _with_series(_running(frame, {"__upto": F.col("value")}), {"__total": F.sum("value")})
    total = _zero_as_one(F.col("__total"))
    return summed.select(
        *frame.columns,
        ((F.col("__upto") - F.col("value")) / total * 360.0).alias("start_angle"),
        (F.col("__upto") / total * 360.0).alias("end_angle"),
    )


def bar_stack(frame: DataFrame) -> DataFrame:
    """Height and bottom of each stacked segment as shares of the bar."""
    summed = _with_series(_running(frame, {"__upto": F.col("value")}), {"__total": F.sum("value")})
    total = _zero_as_one(F.col("__total"))
    return summed.select(
        *frame.columns,
        (F.col("value") / total).alias("share"),
        ((F.col("__upto") - F.col("value")) / total).alias("offset"),
    )


def scaled(frame: DataFrame, marks: str = "columns") -> DataFrame:
    """Value relative to the largest of its series.

    A largest value of zero counts as one; for ``marks="points"`` (lines and
    scatter) so does a negative one.
    """
    if marks not in ("columns", "points"):
        raise ValueError("marks must be 'columns' or 'points'")
    guard = _zero_as_one if marks == "columns" else _positive_or_one
    largest = _with_series(frame, {"__max": F.max("value")})
    height = F.col("value") / guard(F.col("__max"))
    return largest.select(*frame.columns, height.alias("height"))


def area_scaled(frame: DataFrame) -> DataFrame:
    """Value relative to the largest of all series."""
    largest = _positive_or_one(frame.agg(F.max("value")).scalar())
    return frame.select("*", (F.col("value") / largest).alias("height"))


def radar(frame: DataFrame) -> DataFrame:
    """Radius, angle and unit-circle position; the first category points up."""
    placed = _with_series(
        _running(frame, {"__nth": F.lit(1)}), {"__max": F.max("value"), "__n": F.count(F.lit(1))}
    )
    radius = F.col("value") / _positive_or_one(F.col("__max"))
    angle = (F.col("__nth") - 1) * (F.lit(360.0) / F.col("__n")) - 90.0
    return placed.select(*frame.columns, radius.alias("radius"), angle.alias("angle")).select(
        "*",
        (F.col("radius") * F.cos(F.radians("angle"))).alias("x"),
        (F.col("radius") * F.sin(F.radians("angle"))).alias("y"),
    )


def _axis_scale(value: Column, scale: str) -> Column:
    if scale == "LINEAR":
        return value
    if scale == "LOG":
        return F.when(value > 0, F.log10(value)).otherwise(F.lit(0.0))
    if scale == "SQRT":
        return F.when(value >= 0, F.sqrt(value)).otherwise(F.lit(0.0))
    raise ValueError("scale must be LINEAR, LOG or SQRT")


def axis_ticks(
    frame: DataFrame, steps: int = DEFAULT_AXIS_STEPS, scale: str = "LINEAR"
) -> DataFrame:
    """``(step, tick, position)`` from zero to the largest value of the frame."""
    if not 1 <= steps <= MAX_AXIS_STEPS:
        raise ValueError(f"an axis has 1 to {MAX_AXIS_STEPS} steps")
    top = frame.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("top"))
    at = top.select("top", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    tick = F.col("top") / F.lit(float(steps)) * F.col("step")
    full = _positive_or_one(_axis_scale(F.col("top"), scale))
    return at.select("step", tick.alias("tick"), (_axis_scale(tick, scale) / full).alias("position"))


def series_statistics(frame: DataFrame) -> DataFrame:
    """Sum, max, min, average and size of each series."""
    n = F.count(F.lit(1))
    return frame.groupBy(*_series_key(frame)).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"),
        F.coalesce(F.max("value"), F.lit(0.0)).alias("max"),
        F.coalesce(F.min("value"), F.lit(0.0)).alias("min"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("average"),
        n.alias("size"),
    )


def group_statistics(frame: DataFrame) -> DataFrame:
    """Sum, max, min, number of series and size of the largest, over all series."""
    per = series_statistics(frame)
    zero = F.lit(0.0)
    return per.agg(
        F.coalesce(F.sum("sum"), zero).alias("sum"),
        F.coalesce(F.max("max"), zero).alias("max"),
        F.coalesce(F.min("min"), zero).alias("min"),
        F.count(F.lit(1)).alias("size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
    )
