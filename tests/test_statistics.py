import datetime
import math
import random
import statistics as pystat

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.functions import aggregates as agg
from colonnade.operators import heavy, profile, quantiles, statistics
from colonnade.types import LogicalType
from tests.conftest import values


def numbers(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


def stat(df, *names):
    tall = statistics.numeric_statistics(df, ["x"], names).collect()
    found = {row.statistic: row.value for row in tall}
    return found[names[0]] if len(names) == 1 else [found[n] for n in names]


def test_moments_against_python(spark):
    xs = [1.0, 2.0, 4.0, 8.0, 9.5, None]
    df = numbers(spark, xs)
    present = [x for x in xs if x is not None]
    mean, dev = pystat.mean(present), pystat.stdev(present)
    got = stat(df, "mean", "stddev", "variance", "coef_variation", "range", "null_count", "null_rate", "count")
    assert got == pytest.approx([mean, dev, dev**2, dev / mean, 8.5, 1, 1 / 6, 5])
    n, m2 = len(present), sum((x - mean) ** 2 for x in present) / len(present)
    g1 = sum((x - mean) ** 3 for x in present) / n / m2**1.5
    g2 = sum((x - mean) ** 4 for x in present) / n / m2**2 - 3
    skew = math.sqrt(n * (n - 1)) / (n - 2) * g1
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    assert stat(df, "skewness", "kurtosis") == pytest.approx([skew, kurt])


@pytest.mark.parametrize("xs", [[], [1.0], [1.0, 2.0], [1.0, 2.0, 4.0], [3.0] * 5])
def test_short_and_flat_columns(spark, xs):
    skew, kurt, dev = stat(numbers(spark, xs), "skewness", "kurtosis", "stddev")
    flat = len(set(xs)) < 2
    assert (skew is None) == (flat or len(xs) < 3)
    assert (kurt is None) == (flat or len(xs) < 4)
    assert (dev is None) == (len(xs) < 2)


def test_means_mask_their_values(spark):
    df = numbers(spark, [-2.0, 0.0, 1.0, 4.0])
    geometric, harmonic, rms = stat(df, "geometric_mean", "harmonic_mean", "root_mean_square")
    assert geometric == pytest.approx(2.0)
    assert harmonic == pytest.approx(3 / (-0.5 + 1 + 0.25))
    assert rms == pytest.approx(math.sqrt(21 / 4))
    assert stat(numbers(spark, [-1.0, 1.0]), "harmonic_mean") is None
    assert stat(numbers(spark, [-1.0, 1.0]), "coef_variation") is None
    assert stat(numbers(spark, [-1.0, 0.0]), "geometric_mean") is None


def test_integers_do_not_overflow(spark):
    df = spark.createDataFrame([(2_000_000_000,), (2_000_000_000,)], "x int")
    assert stat(df, "sum", "root_mean_square", "harmonic_mean") == pytest.approx([4e9, 2e9, 2e9])


def test_correlation(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (4.0, 5.0), (None, 9.0), (7.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = df.agg(agg.correlation(F.col("x"), F.col("y"))).first()[0]
    assert r == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 5])[0, 1])
    assert df.agg(agg.correlation(F.col("x"), F.lit(1.0))).first()[0] is None


def test_type_checks(main):
    for call in (
        lambda: statistics.numeric_statistics(main, ["txt"]),
        lambda: statistics.entropy(main, "id"),
        lambda: statistics.categories(main, "id"),
        lambda: statistics.date_statistics(main, "txt"),
        lambda: quantiles.median(main, ["txt"]),
        lambda: quantiles.quantiles(main, ["val"], [1.5]),
        lambda: statistics.mean_absolute_deviation(main, "d"),
    ):
        with pytest.raises(ValueError):
            call()


def test_mean_absolute_deviation(spark):
    assert values(statistics.mean_absolute_deviation(numbers(spark, [1.0, 2.0, 6.0, None]), "x")) == [2.0]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "t string")
    assert tuple(statistics.mode(df, "t").first()) == ("a", 2)
    assert [tuple(r) for r in statistics.frequency_distribution(df, "t").collect()] == [
        ("a", 2), ("b", 2), ("c", 1)
    ]


def test_entropy(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "t string")
    bits = statistics.entropy(df, "t", base=2).first()[0]
    assert bits == pytest.approx(1.5)
    assert statistics.entropy(df, "t").first()[0] == pytest.approx(1.5 * math.log10(2))
    assert statistics.entropy(df.where("false"), "t").first()[0] is None


def test_categories(spark, main):
    assert values(statistics.categories(main, "txt")) == ["O'Brien", "alpha", "beta", "delta", "gamma"]
    assert statistics.has_categories(main, "txt").first().has_categories is False
    assert statistics.has_categories(main, "flag").first().has_categories is True
    assert statistics.has_categories(main.where("false"), "txt").first().has_categories is False
    many = spark.range(60).selectExpr("cast(id % 30 as string) as t")
    assert statistics.category_menu(many, "t") == (None, 30)
    assert statistics.category_menu(many.where("false"), "t") == ([], 0)
    assert statistics.category_menu(many, "t", most=30)[1] == 30
    assert statistics.category_menu(main, "flag") == ([False, True], 2)


def test_lengths_count_code_points(spark):
    df = spark.createDataFrame([("é👍",), ("abcd",), (None,)], "t string")
    got = df.agg(*[v.alias(k) for k, v in agg.text_length(F.col("t")).items()]).first()
    assert tuple(got) == (6, 3.0, 2, 4)


def test_null_and_distinct_counts(spark, main):
    nulls = {r.column: tuple(r)[1:] for r in statistics.null_statistics(main, main.columns).collect()}
    assert nulls["val"] == (4, 1, 0.2)
    assert nulls["empty_col"] == (0, 5, 1.0)
    assert statistics.null_statistics(main.where("false"), ["val"]).first().null_rate is None
    for approx in (False, True):
        got = {r.column: tuple(r)[1:] for r in statistics.distinct_counts(main, main.columns, approx).collect()}
        assert got["flag"] == (5, 4, 2)
        assert got["empty_col"] == (5, 0, 0)
        assert got["d"] == (5, 5, 5)
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert statistics.distinct_counts(zeros, ["x"]).first().distinct_count == 2


def test_summary_and_description(spark, main):
    kinds = {"empty_col": LogicalType.EMPTY}
    got = {r.column: r for r in profile.column_summary(main, kinds=kinds).collect()}
    assert got["txt"].cardinality_ratio == 1.0
    assert (got["empty_col"].logical_type, got["empty_col"].native_type) == ("EMPTY", "VARCHAR")
    assert got["val"].null_rate == pytest.approx(0.2)
    described = {r.column: r for r in profile.describe(main, kinds).collect()}
    assert described["val"].chart_value and not described["txt"].chart_value
    assert described["flag"].chart_group and described["d"].chart_outer
    assert not described["empty_col"].filterable
    nested = spark.createDataFrame([([1, 2], "a"), (None, "b")], "xs array<int>, t string")
    summary = {r.column: r for r in profile.column_summary(nested).collect()}
    assert summary["xs"].distinct_count is None and summary["xs"].null_rate == 0.5
    assert summary["t"].distinct_count == 2


def test_header_statistics(main):
    got = {(r.column, r.statistic): r.value or r.moment for r in profile.header_statistics(main).collect()}
    assert got["val", "sum"] == 65.5
    assert got["txt", "max_length"] == 7
    assert got["d", "median"] == datetime.datetime(2024, 1, 3)
    assert got["empty_col", "sum_length"] is None


def test_date_statistics(spark):
    days = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = statistics.date_statistics(df, "d").first()
    assert got.median == datetime.datetime(2024, 1, 1, 12)
    assert got.max == datetime.datetime(2024, 1, 2)


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("shape", ["uniform", "hot", "two", "constant", "integers", "tiny", "empty"])
@pytest.mark.parametrize("gathered", [0, 5, 100])
def test_quantiles_by_rank_are_exact(spark, shape, gathered):
    rng = random.Random(3)
    xs = {
        "uniform": [rng.uniform(-5, 5) for _ in range(4000)],
        "hot": [0.25 if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(4000)],
        "two": [rng.choice([1.0, 2.0]) for _ in range(3000)],
        "constant": [7.0] * 500,
        "integers": [float(rng.randrange(40)) for _ in range(3000)],
        "tiny": [3.0, 1.0, 2.0],
        "empty": [],
    }[shape]
    df = numbers(spark, [*xs, None]).repartition(4)
    got = {r.p: r.value for r in quantiles.quantiles(df, ["x"], PROBABILITIES, gathered=gathered).collect()}
    for p in PROBABILITIES:
        if not xs:
            assert got[p] is None
        else:
            assert got[p] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12, abs=1e-12)


def test_quantiles_of_several_columns(spark):
    df = spark.range(1000).selectExpr("id as a", "cast(id * 2 as int) as b", "timestamp_micros(id * 1000) as c")
    for options in ({}, {"gathered": 50}):
        got = {r.column: r.median for r in quantiles.median(df, ["a", "b", "c"], **options).collect()}
        assert got == {"a": 499.5, "b": 999.0, "c": 499500.0}
    near = quantiles.median(df, ["a"], accuracy=100).first().median
    assert abs(near - 499.5) < 20


def test_intercentile_ratio_of_zero_median(spark):
    assert quantiles.intercentile_ratio(numbers(spark, [-1.0, 0.0, 1.0]), ["x"]).first().ratio is None


def test_times_survive_zone_changes_and_fractions(spark):
    from colonnade.functions.times import from_micros, to_micros

    texts = ["2018-11-04 00:00:00", "1969-12-31 23:59:59.999999", "2024-03-10 02:30:00.000001", "0001-01-01 00:00:00"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
        back = df.select("t", to_micros(F.col("t")).alias("n"), from_micros(to_micros(F.col("t"))).alias("back"))
        rows = back.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    epoch = datetime.datetime(1970, 1, 1)
    assert all(r.t == r.back for r in rows)
    assert [r.n for r in rows] == [(r.t - epoch) // datetime.timedelta(microseconds=1) for r in rows]


@pytest.mark.parametrize("kind", ["string", "bigint", "double", "date", "timestamp_ntz", "boolean", "decimal(9,2)"])
def test_top_values_equal_grouping(spark, kind):
    rows = spark.range(4000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.least(F.col("id") % 97, F.col("id") % 13)).alias("n"))
    made = {
        "string": F.format_string("v'%d", "n"), "double": F.when(F.col("n") == 3, F.lit(float("nan"))).otherwise(F.col("n") / 4),
        "date": F.date_add(F.lit("2024-02-27").cast("date"), F.col("n").cast("int")), "boolean": F.col("n") > 4,
        "timestamp_ntz": (F.lit("2024-03-31 01:30:00").cast("timestamp") + F.make_interval(hours="n")).cast("timestamp_ntz"),
    }
    df = rows.select(made.get(kind, F.col("n").cast(kind)).alias("v"))
    want = statistics.frequency_distribution(df, "v").limit(5).collect()
    got = statistics.top_values(df, "v", 5)
    assert str(got.collect()) == str(want) and got.schema["value"].dataType == df.schema["v"].dataType
    assert (heavy.frequent(df, "v", 5) is None) == (kind == "decimal(9,2)")
    assert str(statistics.mode(df, "v").collect()) == str(want[:1])


def test_a_sketch_decides_only_what_its_bound_proves(spark):
    near_unique = spark.range(60_000).select(F.when(F.col("id") < 5, F.lit(7)).otherwise(F.col("id")).alias("v"))
    assert heavy.frequent(near_unique, "v", 1) is None
    assert [tuple(r) for r in statistics.top_values(near_unique, "v", 1).collect()] == [(7, 6)]
    skewed = near_unique.withColumn("v", F.when(F.col("v") % 10 == 0, F.lit(-1)).otherwise(F.col("v")))
    assert [tuple(r) for r in heavy.frequent(skewed, "v", 1).collect()] == [(-1, 5999)]
    assert heavy.frequent(skewed, "v", 2) is None
    assert statistics.top_values(skewed.where("false"), "v", 3).collect() == []
