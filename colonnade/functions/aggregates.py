"""Column statistics as aggregate expressions.

Each takes a column and returns one aggregate, so any number of them share a
scan: ``df.agg(mean(c), sample_skewness(c), ...)``. Nulls never count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summed(c: Column, spark_type: T.DataType) -> Column:
    """The sum; of whole numbers as a 38-digit decimal, which no table overflows."""
    if isinstance(spark_type, T.IntegralType):
        return F.sum(c.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.sum(c)


def _as_double(c: Column) -> Column:
    return c.cast("double")


def null_count(c: Column) -> Column:
    return F.count_if(c.isNull())


def null_rate(c: Column) -> Column:
    return F.try_divide(null_count(c).cast("double"), F.count(F.lit(1)))


def value_range(c: Column) -> Column:
    return F.max(c) - F.min(c)


def standard_deviation(c: Column) -> Column:
    """Of the sample; as the root of the variance it shares that aggregate's buffer."""
    return F.sqrt(F.var_samp(c))


def coefficient_of_variation(c: Column) -> Column:
    return F.try_divide(standard_deviation(c), F.avg(c))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values or with no spread."""
    n = F.count(c).cast("double")
    corrected = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(c)
    return F.when(n >= 3, corrected)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or with no spread."""
    n = F.count(c).cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, scale * ((n + 1) * F.kurtosis(c) + 6))


def geometric_mean(c: Column) -> Column:
    """Over the values above zero."""
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def harmonic_mean(c: Column) -> Column:
    """Over the values other than zero; null when the reciprocals cancel out."""
    x = F.when(c != 0, _as_double(c))
    return F.try_divide(F.count(x).cast("double"), F.sum(F.lit(1.0) / x))


def root_mean_square(c: Column) -> Column:
    return F.sqrt(F.avg(_as_double(c) * _as_double(c)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null without spread."""
    both = x.isNotNull() & y.isNotNull()
    a = F.when(both, _as_double(x))
    b = F.when(both, _as_double(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def text_length(c: Column) -> dict[str, Column]:
    n = F.length(c)
    return {
        "sum_length": F.sum(n),
        "mean_length": F.avg(n),
        "min_length": F.min(n),
        "max_length": F.max(n),
    }


def entropy_of_counts(n: Column, base: float = 10.0) -> Column:
    """Shannon entropy from one row per distinct value with its frequency ``n``.

    ``-sum(p * log p)`` with ``p = n / N`` equals ``log N - sum(n * log n) / N``,
    which needs no second pass for ``N``.
    """
    n = n.cast("double")
    total = F.sum(n)
    return (F.ln(total) - F.sum(n * F.ln(n)) / total) / F.ln(F.lit(float(base)))


NUMERIC = {
    "count": F.count,
    "null_count": null_count,
    "null_rate": null_rate,
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "range": value_range,
    "stddev": standard_deviation,
    "variance": F.var_samp,
    "coef_variation": coefficient_of_variation,
    "skewness": sample_skewness,
    "kurtosis": sample_kurtosis,
    "geometric_mean": geometric_mean,
    "harmonic_mean": harmonic_mean,
    "root_mean_square": root_mean_square,
}
