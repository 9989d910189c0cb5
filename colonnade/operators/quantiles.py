"""Exact quantiles of columns of any size.

One scan counts every column and sketches it; the sketch's error bound gives, for each wanted
rank, two values that it lies between. A second scan counts what is below both and gathers
the few values between them, for all columns and ranks at once, which settles them exactly.
Only where a table is so large that many values lie between, counts narrow the stretch first and
it is sketched again. Every scan is a map-side aggregate of one row; nothing is sorted, and once
stretches are narrow their bounds reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.times import from_micros, to_micros
from colonnade.types import classify, col, field_type

#: Values between two bounds that are gathered in one task at most.
GATHERED = 100_000
#: Ranks of sketched values are off by one in so many at most.
ACCURACY = 10_000
_MARGIN = 1.5 / ACCURACY


@dataclass
class _Rank:
    """Search for the value at one 0-based rank among a column's sorted values.

    ``inside`` values lie strictly between ``low`` and ``high``, after ``below`` others; ``a`` and ``b``
    are proposed to lie on both sides of the rank.
    """

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | int | None = None
    high: float | int | None = None
    a: float | int | None = None
    b: float | int | None = None
    value: float | int | None = None
    done: bool = False

    def window(self) -> Column:
        """Whether the column lies strictly between the bounds."""
        c = F.col(self.column)
        keep = c.isNotNull()
        if self.low is not None:
            keep &= c > F.lit(self.low)
        if self.high is not None:
            keep &= c < F.lit(self.high)
        return keep

    def probes(self) -> list[Column]:
        at = (self.rank - self.below) / self.inside
        return [F.lit(min(max(at + d, 0.0), 1.0)) for d in (-_MARGIN, _MARGIN)]

    def few(self, gathered: int) -> bool:
        """Whether the proposals leave few values between them: their ranks differ by both margins and errors."""
        return self.inside * 5 <= gathered * ACCURACY

    def settle_between(self, gathered: int) -> tuple | None:
        """The bounds between which values are gathered: the window's own if it is small, else the proposals; None for neither."""
        if self.inside <= gathered:
            return self.low, self.high
        return (self.a, self.b) if self.few(gathered) else None

    def narrow(self, lt_a: int, eq_a: int, lt_b: int, eq_b: int) -> None:
        """``lt`` values of the window lie below a proposal and ``eq`` equal it."""
        a, b, at = self.a, self.b, self.rank - self.below
        if at < lt_a:
            self.high, self.inside = a, lt_a
        elif at < lt_a + eq_a:
            self.value, self.done = a, True
        elif at < lt_b:
            self.low, self.high = a, b
            self.below, self.inside = self.below + lt_a + eq_a, lt_b - lt_a - eq_a
        elif at < lt_b + eq_b:
            self.value, self.done = b, True
        else:
            self.low, self.below, self.inside = b, self.below + lt_b + eq_b, self.inside - lt_b - eq_b


def _propose(df: DataFrame, ranks: list[_Rank]) -> None:
    """One scan that sketches the window of every rank."""
    near = _reaching(df, ranks)
    made = [F.percentile_approx(F.when(r.window(), F.col(r.column)), F.array(*r.probes()), ACCURACY).alias(f"p{i}") for i, r in enumerate(ranks)]
    row = near.agg(*made).first()
    for i, r in enumerate(ranks):
        r.a, r.b = row[f"p{i}"]


def _reaching(df: DataFrame, ranks: list[_Rank]) -> DataFrame:
    """The rows that lie in some window, by a condition that scans can use, once all are narrow."""
    if any(r.low is None and r.high is None for r in ranks):
        return df
    some = ranks[0].window()
    for r in ranks[1:]:
        some |= r.window()
    return df.where(some)


def _settle(df: DataFrame, ranks: list[_Rank], gathered: int) -> None:
    """One scan that counts around the proposals of every rank and gathers the values between close ones."""
    counts: dict[tuple, list[Column]] = {}
    between: dict[tuple, Column] = {}
    small = [r.inside <= gathered for r in ranks]
    for r, whole in zip(ranks, small, strict=True):
        c = F.when(r.window(), F.col(r.column))
        if not whole:
            for bound in (r.a, r.b):
                counts.setdefault((r.column, r.low, r.high, repr(bound)), [F.count_if(c < F.lit(bound)), F.count_if(c == F.lit(bound))])
        if whole or r.few(gathered):
            kept = c if whole else F.when((c > F.lit(r.a)) & (c < F.lit(r.b)), c)
            between.setdefault((r.column, r.low, r.high, *map(repr, r.settle_between(gathered))), F.array_sort(F.collect_list(kept)))
    place = {key: i for i, key in enumerate(counts)}
    lists = {key: i for i, key in enumerate(between)}
    made = [c.alias(f"{kind}{place[key]}") for key, pair in counts.items() for kind, c in zip(("lt", "eq"), pair, strict=True)]
    aggregated = _reaching(df, ranks).agg(*made, *[c.alias(f"g{lists[key]}") for key, c in between.items()])
    # Of the gathered values only the wanted ones leave the aggregate.
    picked = []
    for i, (r, whole) in enumerate(zip(ranks, small, strict=True)):
        if whole or r.few(gathered):
            at = F.lit(r.rank - r.below)
            if not whole:
                k = place[r.column, r.low, r.high, repr(r.a)]
                at = at - F.col(f"lt{k}") - F.col(f"eq{k}")
            values = F.col(f"g{lists[r.column, r.low, r.high, *map(repr, r.settle_between(gathered))]}")
            picked.append(F.when(at >= 0, F.get(values, at.cast("int"))).alias(f"v{i}"))
    row = aggregated.select(*[f"{kind}{i}" for i in place.values() for kind in ("lt", "eq")], *picked).first()
    for i, (r, whole) in enumerate(zip(ranks, small, strict=True)):
        if whole:
            r.value, r.done = row[f"v{i}"], True
            continue
        (lt_a, eq_a), (lt_b, eq_b) = (
            (row[f"lt{place[key]}"], row[f"eq{place[key]}"]) for key in ((r.column, r.low, r.high, repr(bound)) for bound in (r.a, r.b))
        )
        if r.few(gathered) and lt_a + eq_a <= r.rank - r.below < lt_b:
            r.value, r.done = row[f"v{i}"], True
        else:
            r.narrow(lt_a, eq_a, lt_b, eq_b)


def _measurable(df: DataFrame, name: str) -> Column:
    """Numbers as they are, times as microseconds, so that they interpolate."""
    spark_type = field_type(df, name)
    if isinstance(spark_type, T.DecimalType):
        return col(name).cast("double")
    if classify(spark_type).is_numeric:
        return col(name)
    if classify(spark_type).is_date:
        return to_micros(col(name))
    raise ValueError(f"column {name!r} is {spark_type.simpleString()}, it has no quantiles")


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int | None = None,
    gathered: int = GATHERED,
) -> DataFrame:
    """``(column, p, value)`` with linear interpolation between neighbours.

    Times come back as microseconds since 1970. ``accuracy`` asks for
    approximate values at rank error ``1/accuracy`` in a single pass instead.
    """
    for p in probabilities:
        if not 0.0 <= p <= 1.0:
            raise ValueError("a percentile must lie between 0.0 and 1.0")
    inner = {name: f"c{i}" for i, name in enumerate(columns)}
    data = df.select(*[_measurable(df, name).alias(alias) for name, alias in inner.items()])
    if accuracy is not None:
        probes = F.array(*[F.lit(float(p)) for p in probabilities])
        wide = data.agg(
            *[F.percentile_approx(alias, probes, accuracy).alias(alias) for alias in inner.values()]
        )
        return _tall(wide, inner, probabilities)
    return _by_rank(data, inner, probabilities, gathered)


def _by_rank(data: DataFrame, inner: dict[str, str], probabilities: Sequence[float], gathered: int) -> DataFrame:
    # The first scan: how many values there are, and what lies around each probability.
    around = [F.lit(min(max(p + d, 0.0), 1.0)) for p in probabilities for d in (-_MARGIN, _MARGIN)]
    counted = [F.count(alias).alias(f"n_{alias}") for alias in inner.values()]
    sketched = [F.percentile_approx(alias, F.array(*around), ACCURACY).alias(alias) for alias in inner.values()] if around else []
    first = data.agg(*counted, *sketched).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    spots: dict[tuple[str, float], tuple[int, int, float]] = {}
    for alias in inner.values():
        n = first[f"n_{alias}"]
        for k, p in enumerate(probabilities if n else ()):
            at = p * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            spots[alias, p] = (low, high, at - low)
            a, b = first[alias][2 * k], first[alias][2 * k + 1]
            for rank in (low, high):
                ranks.setdefault((alias, rank), _Rank(alias, rank, n, a=a, b=b))
    while left := [r for r in ranks.values() if not r.done]:
        _settle(data, left, gathered)
        again = [r for r in left if not r.done and r.inside > gathered]
        if again:
            _propose(data, again)
    arrays = []
    for alias in inner.values():
        values = []
        for p in probabilities:
            if (alias, p) not in spots:
                values.append(F.lit(None).cast("double"))
                continue
            low, high, part = spots[alias, p]
            a, b = (float(ranks[alias, rank].value) for rank in (low, high))
            values.append(F.lit(a if low == high else a + part * (b - a)))
        arrays.append(F.array(*values).alias(alias))
    return _tall(data.sparkSession.range(1).select(*arrays), inner, probabilities)


def _tall(wide: DataFrame, inner: dict[str, str], probabilities: Sequence[float]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(float(p)).alias("p"),
            F.col(alias)[i].cast("double").alias("value"),
        )
        for name, alias in inner.items()
        for i, p in enumerate(probabilities)
    ]
    return wide.select(F.inline(F.array(*cells)))


def _by_p(quantile_frame: DataFrame, picks: dict[str, float]) -> DataFrame:
    """One row per column with the named quantiles side by side."""
    return quantile_frame.groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in picks.items()]
    )


def median(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    return _by_p(quantiles(df, columns, [0.5], **options), {"median": 0.5})


def interquartile_range(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    found = _by_p(quantiles(df, columns, [0.25, 0.75], **options), {"q1": 0.25, "q3": 0.75})
    return found.withColumn("iqr", F.col("q3") - F.col("q1"))


def intercentile_ratio(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """``(p90 - p10) / |p50|``, null when the median is zero."""
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    found = _by_p(quantiles(df, columns, list(wanted.values()), **options), wanted)
    spread = F.try_divide(F.col("p90") - F.col("p10"), F.abs("p50"))
    return found.withColumn("ratio", spread)


def date_median(df: DataFrame, column: str, **options) -> DataFrame:
    """The median time, interpolated, as a timestamp without zone."""
    found = median(df, [column], **options)
    return found.select("column", from_micros(F.col("median")).alias("median"))
