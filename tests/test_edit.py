import datetime

import pytest
from pyspark.sql import functions as F

from colonnade.operators import edit
from colonnade.operators import filters as flt
from colonnade.types import LogicalType
from tests.conftest import values


def test_rename_hide_select(main):
    assert edit.rename(main, "txt", "title").columns[2] == "title"
    assert edit.hide(main, "txt", "flag").columns == ["id", "val", "empty_col", "d"]
    with pytest.raises(ValueError):
        edit.rename(main, "txt", "ID")
    with pytest.raises(ValueError):
        edit.rename(main, "nope", "x")


def test_empty_columns(main):
    assert edit.find_empty(main) == ["empty_col"]
    assert edit.drop_empty(main).columns == ["id", "val", "txt", "flag", "d"]
    assert edit.empty_columns(main.select("id")).count() == 0


def test_values_beyond_the_first_rows_are_found(spark):
    df = spark.range(5000).selectExpr(
        "case when id = 4321 then 'here' end as late", "cast(null as string) as never", "'x' as always"
    )
    assert edit.find_empty(df) == ["never"]
    assert edit.find_empty(df.where("false")) == ["late", "never", "always"]


def test_retype_text(spark):
    texts = ["1.5", "1e3", " 7 ", "1,5", "99999999999", "NaN", "abc", "1.0", "1d", "0x1F"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    as_int = values(edit.retype(df, "t", LogicalType.INTEGER))
    assert as_int == [None, None, 7] + [None] * 7
    lenient = values(edit.retype(df, "t", LogicalType.INTEGER, lenient_int=True))
    assert lenient == [2, 1000, 7, None, None, None, None, 1, None, None]
    doubles = values(edit.retype(df, "t", LogicalType.DOUBLE))
    assert doubles[:5] == [1.5, 1000.0, 7.0, None, 99999999999.0]
    assert doubles[5] != doubles[5] and doubles[6:] == [None, 1.0, None, None]


def test_retype_between_types(spark, main):
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-1.5,), (3e9,)], "x double")
    assert values(edit.retype(halves, "x", LogicalType.INTEGER)) == [0, 2, 2, -2, None]
    assert values(edit.retype(main, "d", LogicalType.INTEGER), "d") == [None] * 5
    assert values(edit.retype(main, "id", LogicalType.DATE), "d")[0] == datetime.date(2024, 1, 1)
    assert values(edit.retype(main, "id", LogicalType.DATE), "id") == [None] * 5
    assert values(edit.retype(main, "flag", LogicalType.INTEGER), "flag") == [1, 0, None, 1, 0]
    assert values(edit.retype(main, "id", LogicalType.STRING), "id") == ["1", "2", "3", "4", "5"]


def test_retype_text_to_date_and_boolean(spark):
    texts = ["2024-01-02", "2024/1/2", "2024-01-02 10:11:12", "2024", "2024-02-30", "02/01/2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = datetime.date(2024, 1, 2)
    assert values(edit.retype(df, "t", LogicalType.DATE)) == [day, day, day, None, None, None]
    words = spark.createDataFrame([(t,) for t in ["T", "yes", "0", "off", " true ", "N"]], "t string")
    assert values(edit.retype(words, "t", LogicalType.BOOLEAN)) == [True, True, False, None, None, False]


def test_null_display(main):
    shown = edit.null_display(main, ["val", "empty_col"])
    assert values(shown, "val") == ["10.5", "20.0", "(null)", "5.0", "30.0"]
    assert values(shown, "empty_col") == ["(null)"] * 5
    assert values(shown, "flag")[2] is None


@pytest.mark.parametrize(
    ("value", "kind", "expected"),
    [
        ("(null)", LogicalType.STRING, None),
        ("", LogicalType.STRING, ""),
        ("  ", LogicalType.INTEGER, None),
        ("12", LogicalType.INTEGER, 12),
        ("x", LogicalType.INTEGER, None),
        ("1,5", LogicalType.DOUBLE, 1.5),
        ("yes", LogicalType.BOOLEAN, True),
        (True, LogicalType.BOOLEAN, True),
        ("2024-05-06", LogicalType.DATE, datetime.date(2024, 5, 6)),
        (datetime.date(2024, 5, 6), LogicalType.DATE, datetime.date(2024, 5, 6)),
        (None, LogicalType.DOUBLE, None),
        ("it's", LogicalType.EMPTY, "it's"),
    ],
)
def test_edited_values(spark, value, kind, expected):
    assert values(spark.range(1).select(edit.edited_value(value, kind))) == [expected]


def test_update_in_filtered_sorted_view(main):
    edited = edit.update_cell(
        main, 1, "txt", "NEW", [("val", False)], [flt.hide_empty("val")], key=["id"]
    )
    assert {r.id: r.txt for r in edited.collect()} == {
        1: "alpha", 2: "NEW", 3: "O'Brien", 4: "delta", 5: "gamma"
    }
    assert edited.schema == main.schema
    past = edit.update_cell(main, 9, "txt", "NEW", key=["id"])
    assert "NEW" not in values(past, "txt")


def test_update_by_place_changes_one_of_equal_rows(spark, tmp_path):
    path = str(tmp_path / "same.parquet")
    spark.range(6).select(F.lit("x").alias("t"), F.lit(1).alias("n")).coalesce(1).write.parquet(path)
    edited = edit.update_cell(spark.read.parquet(path), 3, "n", "7")
    assert values(edited, "n") == [1, 1, 1, 7, 1, 1]


def test_deep_rows_are_found_by_place(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(500).repartition(3, "id").write.parquet(path)
    df = spark.read.parquet(path)
    deep = edit.update_cell(df, 120, "id", "-1", filters=[flt.above("id", 99)])
    in_order = values(df.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index"))
    target = [i for i in in_order if i > 99][120]
    assert sorted(values(deep)) == sorted(-1 if i == target else i for i in in_order)
    assert values(deep).count(-1) == 1
