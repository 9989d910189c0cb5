import math

import pytest

from colonnade.operators import chart
from colonnade.operators import filters as flt


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("n", "a", 1.0), ("n", "a", 2.0), ("n", "b", 3.0), ("s", "b", 4.0),
        ("s", "c", None), (None, "a", 10.0), ("s", None, 5.0),
    ]
    return spark.createDataFrame(rows, "o string, g string, v double")


def cells(df, *names):
    return {tuple(r[n] for n in names[:-1]): r[names[-1]] for r in df.collect()}


def test_series_sums_and_empty_groups(sales):
    got = cells(chart.series(sales, "g", "v"), "category", "value")
    assert got == {("a",): 13.0, ("b",): 7.0, ("c",): 0.0, (None,): 5.0}


def test_percentages_of_all_or_filtered_rows(sales):
    only = [flt.equal("o", "n")]
    share = cells(chart.series(sales, "g", "v", only, percentage=True), "category", "value")
    assert share == {("a",): 12.0, ("b",): 12.0}
    inside = chart.series(sales, "g", "v", only, percentage=True, denominator="filtered")
    assert cells(inside, "category", "value") == {("a",): 50.0, ("b",): 50.0}
    none = chart.series(sales.where("v is null"), "g", "v", percentage=True)
    assert cells(none, "category", "value") == {("c",): None}
    with pytest.raises(ValueError):
        chart.series(sales, "g", "o")


def test_dense_fills_every_series(sales):
    frame = chart.dense(chart.group_series(sales, "o", "g", "v"))
    got = cells(frame, "series", "category", "value")
    assert len(got) == 3 * 4
    assert got["n", "c"] == 0.0 and got[None, "a"] == 10.0 and got[None, "b"] == 0.0
    first = cells(frame, "category", "first_series")
    assert first["a",] == "n" and first["c",] == "s" and first[None,] == "s"


def test_outer_groups_are_limited(spark):
    rows = [(f"o{i:02}", "g", 1.0) for i in range(21)]
    df = spark.createDataFrame(rows, "o string, g string, v double")
    with pytest.raises(chart.TooManyGroups):
        chart.dense(chart.group_series(df, "o", "g", "v"))
    assert chart.dense(chart.group_series(df.where("o < 'o20'"), "o", "g", "v")).count() == 20


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("x", "a", 1.0), ("x", "b", 3.0), ("y", "a", -2.0), ("y", "b", -4.0), ("z", "a", 0.0)]
    return spark.createDataFrame(rows, "series string, category string, value double")


def test_pie_and_bar(frame):
    ends = cells(chart.pie_angles(frame), "series", "category", "end_angle")
    starts = cells(chart.pie_angles(frame), "series", "category", "start_angle")
    assert (starts["x", "a"], ends["x", "a"], ends["x", "b"]) == (0.0, 90.0, 360.0)
    assert (starts["z", "a"], ends["z", "a"]) == (0.0, 0.0)
    stack = {(r.series, r.category): (r.share, r.offset) for r in chart.bar_stack(frame).collect()}
    assert stack["x", "b"] == (0.75, 0.25)
    assert stack["y", "b"] == pytest.approx((2 / 3, 1 / 3))


def test_scaled_marks(frame):
    columns = cells(chart.scaled(frame), "series", "category", "height")
    assert columns["x", "a"] == pytest.approx(1 / 3)
    assert columns["y", "b"] == 2.0
    assert columns["z", "a"] == 0.0
    points = cells(chart.scaled(frame, marks="points"), "series", "category", "height")
    assert points["y", "b"] == -4.0
    area = cells(chart.area_scaled(frame), "series", "category", "height")
    assert area["y", "b"] == pytest.approx(-4 / 3)


def test_radar_starts_at_the_top(frame):
    got = {(r.series, r.category): r for r in chart.radar(frame).collect()}
    assert got["x", "a"].angle == -90.0 and got["x", "b"].angle == 90.0
    assert got["x", "b"].y == pytest.approx(1.0)
    assert got["x", "a"].y == pytest.approx(-1 / 3)


def test_single_series_layout(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, 4.0)], "category string, value double")
    ends = cells(chart.pie_angles(df), "category", "end_angle")
    assert ends == {("a",): 135.0, ("b",): 180.0, (None,): 360.0}
    assert cells(chart.scaled(df), "category", "height")["a",] == 0.75
    assert chart.series_statistics(df).first().size == 3


@pytest.mark.parametrize(
    ("scale", "at"), [("LINEAR", lambda v: v), ("LOG", lambda v: math.log10(v) if v > 0 else 0), ("SQRT", math.sqrt)]
)
def test_axis_ticks(spark, scale, at):
    df = spark.createDataFrame([("a", 100.0), ("b", 7.0)], "category string, value double")
    ticks = chart.axis_ticks(df, 4, scale).orderBy("step").collect()
    assert [t.tick for t in ticks] == [0.0, 25.0, 50.0, 75.0, 100.0]
    assert [t.position for t in ticks] == pytest.approx([at(t.tick) / at(100.0) for t in ticks])


def test_axis_limits_and_empty_frames(spark):
    empty = spark.createDataFrame([], "category string, value double")
    assert [r.position for r in chart.axis_ticks(empty, 2).collect()] == [0.0, 0.0, 0.0]
    for steps in (0, 51):
        with pytest.raises(ValueError):
            chart.axis_ticks(empty, steps)
    stats = chart.group_statistics(empty).first()
    assert (stats["sum"], stats["max"], stats["size"], stats["max_size"]) == (0.0, 0.0, 1, 0)


def test_series_and_group_statistics(frame):
    got = {r.series: r for r in chart.series_statistics(frame).collect()}
    assert (got["x"]["sum"], got["x"]["max"], got["x"]["average"], got["x"]["size"]) == (4.0, 3.0, 2.0, 2)
    total = chart.group_statistics(frame).first()
    assert (total["sum"], total["min"], total["size"], total["max_size"]) == (-2.0, -4.0, 3, 2)
