import random

import pytest
from pyspark.sql import functions as F

from colonnade.operators import ordered, paging, ranks
from tests.conftest import values


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, 5.0), (2, None), (3, 1.0), (4, None), (5, 9.0)]
    return spark.createDataFrame(rows, "k int, x double")


@pytest.fixture(scope="module")
def large(spark):
    rows = spark.range(10_050).withColumns({"val": F.col("id") * 1.0, "txt": F.concat(F.lit("row"), "id")})
    return rows.repartition(7)


def test_nulls_last_both_ways(gaps):
    key = ("k", True)
    assert values(paging.sort(gaps, [("x", True), key])) == [3, 1, 5, 2, 4]
    assert values(paging.sort(gaps, [("x", False), key])) == [5, 1, 3, 2, 4]


def test_limit_and_offset(gaps):
    order = [("k", True)]
    assert values(paging.rows(gaps, order, 2, 1)) == [2, 3]
    assert values(paging.rows(gaps, order, 2)) == [1, 2]
    assert values(paging.rows(gaps, order, offset=3)) == [4, 5]
    assert values(paging.rows(gaps, order)) == [1, 2, 3, 4, 5]
    assert values(paging.top(gaps, [("x", False), ("k", True)], 2)) == [5, 1]


def test_last_page_is_short(large):
    last = paging.page(large, [("id", True)], 1, 10_000)
    assert values(last) == list(range(10_000, 10_050))
    assert paging.page(large, [("id", True)], 2, 10_000).count() == 0
    counted = paging.page_count(large, 10_000).first()
    assert (counted.row_count, counted.page_count) == (10_050, 2)
    with pytest.raises(ValueError):
        paging.page(large, [("id", True)], 0, 0)


def test_deep_pages_go_by_position(large, monkeypatch):
    monkeypatch.setattr(ranks, "STRETCH_ROWS", 100)
    monkeypatch.setattr(ranks, "FANOUT", 8)
    assert values(paging.page(large, [("id", False)], 3, 1000)) == list(range(7049, 6049, -1))
    assert paging.page(large, [("id", False)], 11, 1000).count() == 0
    assert values(paging.page(large, [("id", True)], 10, 1000)) == list(range(10_000, 10_050))


def test_cell(gaps):
    order = [("k", True)]
    assert values(paging.cell(gaps, order, 4, "x")) == [9.0]
    assert values(paging.cell(gaps, order, 5, "x")) == []
    assert values(paging.cell(gaps, order, -1, "x")) == []


def test_row_numbers_with_one_hot_key_and_equal_rows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(20)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    numbered = ordered.number_rows(df, [("g", True), ("v", False)]).orderBy("row_number").collect()
    assert [r.row_number for r in numbered] == list(range(1, 3001))
    assert [(r.g, r.v) for r in numbered] == sorted(rows, key=lambda r: (r[0], -r[1]))


def test_running_sums_over_many_partitions_and_null_series(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), i, float(rng.randrange(9))) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, i int, v double").repartition(5)
    sums = {"total": F.col("v"), "nth": F.lit(1)}
    got = {r.i: (r.total, r.nth) for r in ordered.running_sums(df, ["s"], [("i", True)], sums).collect()}
    seen = {}
    for s, i, v in sorted(rows, key=lambda r: r[1]):
        total, nth = seen.get(s, (0.0, 0))
        seen[s] = (total + v, nth + 1)
        assert got[i] == seen[s]
    assert len(got) == 2000


def test_file_order_numbers_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).repartition(4, "id").write.parquet(path)
    df = spark.read.parquet(path)
    got = ordered.file_row_numbers(df).orderBy("row_number")
    assert values(got, "row_number") == list(range(1, 1001))
    place = df.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index")
    assert values(got, "id") == values(place, "id")


@pytest.mark.parametrize("chunk", [7, 100, 1_000_000])
def test_file_pages_of_filtered_scans(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "_CHUNK", chunk)
    path = str(tmp_path / "t.parquet")
    spark.range(1000).repartition(4, "id").write.parquet(path)
    df = spark.read.parquet(path)
    in_order = values(df.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index"))
    kept = [i for i in in_order if i % 3 == 0 and i > 200]
    view = df.where("id % 3 = 0 and id > 200")
    for index in (0, 3, 5, 9):
        assert values(paging.file_page(view, index, 50)) == kept[index * 50 : index * 50 + 50]
    assert values(paging.file_page(df, 19, 50)) == in_order[950:]
    by_digit = paging.file_page(df.selectExpr("id", "id % 10 as d"), 1, 100, [("d", True)])
    assert values(by_digit) == [i for i in in_order if i % 10 == 1]


def test_numbers_of_a_filtered_scan_count_the_rows_left(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).repartition(4, "id").write.parquet(path)
    df = spark.read.parquet(path)
    got = ordered.file_row_numbers(df.where("id % 7 = 3")).orderBy("row_number")
    in_order = values(df.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index"))
    assert values(got, "row_number") == list(range(1, 144))
    assert values(got, "id") == [i for i in in_order if i % 7 == 3]
