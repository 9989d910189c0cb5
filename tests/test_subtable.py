import pytest

from colonnade.operators import filters as flt
from colonnade.operators.subtable import allowed_aggregates, subtable
from colonnade.types import LogicalType


def by_key(df):
    return {row[0]: tuple(row)[1:] for row in df.collect()}


def test_each_aggregate(main):
    got = subtable(
        main,
        "flag",
        {"val": "sum", "id": "avg", "txt": "min", "d": "max", "empty_col": "count"},
    )
    assert got.columns == ["flag", "val_sum", "id_avg", "txt_min", "d_max", "empty_col_count"]
    rows = by_key(got)
    assert set(rows) == {True, False, None}
    assert rows[True][:3] == (15.5, 2.5, "alpha")
    assert rows[None][0] is None and rows[None][4] == 0


def test_distinct_counts_exact_and_approximate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None)], "g string, v int")
    assert by_key(subtable(df, "g", {"v": "count_distinct"})) == {"a": (2,), "b": (0,)}
    assert by_key(subtable(df, "g", {"v": "count_distinct"}, approx=True)) == {"a": (2,), "b": (0,)}


def test_default_is_the_distinct_keys(main):
    assert subtable(main, "flag").count() == 3
    assert subtable(main, "flag", {"val": "none"}).columns == ["flag"]
    assert subtable(main, "flag", filters=[flt.hide_empty("val")]).count() == 2


def test_filters_apply_before_grouping(main):
    got = subtable(main, "flag", {"id": "count"}, [flt.above("val", 15)])
    assert by_key(got) == {False: (2,)}


def test_offered_aggregates(main):
    assert allowed_aggregates(LogicalType.EMPTY) == ("none", "count")
    assert "sum" not in allowed_aggregates(LogicalType.DATE)
    for wrong in ({"txt": "sum"}, {"d": "avg"}, {"flag": "count"}, {"nope": "count"}):
        with pytest.raises(ValueError):
            subtable(main, "flag", wrong)
    with pytest.raises(ValueError):
        subtable(main, "flag", {"empty_col": "min"}, kinds={"empty_col": LogicalType.EMPTY})
