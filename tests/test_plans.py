"""The physical plans: what reaches the scan, and what must not appear."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from colonnade.operators import chart, merge, paging, ranks, statistics
from colonnade.operators import filters as flt
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
QUERIES = entry_module.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def pushed(df) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df)))


def test_filters_reach_the_scan(spark, lineitem):
    assert "GreaterThanOrEqual(l_quantity,10.0)" in pushed(flt.apply(lineitem, [flt.between("l_quantity", 10, 40)]))
    assert "GreaterThanOrEqual(l_linenumber,5)" in pushed(
        flt.apply(lineitem, [flt.where("l_linenumber", "GREATER_EQUAL", "4.5")])
    )
    day = flt.equal("l_shipdate", "1997-03-05 00:00:00")
    assert "EqualTo(l_shipdate,1997-03-05T00:00)" in pushed(flt.apply(lineitem, [day]))
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    assert "StringContains(p_name,red)" in pushed(flt.apply(part, [flt.search("p_name", "red")]))


def test_scans_read_only_what_is_used(lineitem):
    schema = re.findall(r"ReadSchema: struct<(.*?)>", plan(chart.series(lineitem, "l_returnflag", "l_tax")))
    assert schema == ["l_tax:double,l_returnflag:string"]
    counted = plan(statistics.distinct_counts(lineitem, ["l_tax"]))
    assert re.findall(r"ReadSchema: struct<(.*?)>", counted) == ["l_tax:double"]


def test_pages_use_a_bounded_top_k(lineitem):
    for index in (0, 3):
        page = plan(paging.page(lineitem, [("l_tax", True), ("l_orderkey", True)], index, 1000))
        assert "TakeOrderedAndProject" in page and "Exchange" not in page


def test_deep_pages_read_a_stretch_by_pushed_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "STRETCH_ROWS", 50)
    path = str(tmp_path / "sorted.parquet")
    spark.range(20_000).selectExpr("id", "repeat('x', 20) as pad").repartitionByRange(4, "id").write.parquet(path)
    page = paging.page(spark.read.parquet(path), [("id", True)], 120, 100)
    text = plan(page)
    bounds = re.findall(r"(GreaterThanOrEqual|LessThanOrEqual)\(id,(\d+)\)", pushed(page))
    assert {kind for kind, _ in bounds} == {"GreaterThanOrEqual", "LessThanOrEqual"}
    # No more than the page and a stretch at both sides lies between the bounds.
    low, high = (min(int(v) for k, v in bounds if k == kind) for kind in ("GreaterThanOrEqual", "LessThanOrEqual"))
    assert 11_800 <= low <= 12_000 and 12_100 <= high <= 12_300
    limit = re.search(r"TakeOrderedAndProject\(limit=(\d+)", text)
    assert limit and int(limit[1]) <= 300
    assert [r.id for r in page.collect()] == list(range(12_000, 12_100))


@pytest.mark.parametrize(
    "name", ["sort_asc", "row_numbers", "page_rows_deep", "pages_joined", "chart_dense", "chart_pie_angles", "chart_bar_stack", "chart_radar"]
)
def test_ordered_queries_write_nothing(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("a table was written")

    monkeypatch.setattr(DataFrameWriter, "parquet", refused)
    QUERIES[name](spark, FOLDER).collect()


def test_inner_join_shuffles_each_side_once(spark, lineitem):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
        joined = plan(merge.join(orders, lineitem, "inner", [("o_orderkey", "l_orderkey")]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_tables_or_gathers_them(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # A window without keys is only used over one row per partition or per file, or
    # over the rows of one page.
    if name == "page_row_numbers":
        assert text.index("Window") < text.index("TakeOrderedAndProject")
        return
    for window in re.findall(r"Window \[(.*?)\], \[(.*?)\]", text):
        if "ORDER BY" in window[0] and not window[1].strip():
            # Rows of a single stretch are numbered without a key: there is no second one.
            assert "__part" in window[0] or "__file" in window[0] or "__tie" in window[0]
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_frequent_values_combine_before_the_shuffle(lineitem):
    text = plan(statistics.frequencies(lineitem.withColumn("f", F.col("l_returnflag")), "f"))
    assert text.count("HashAggregate") == 2


def test_quantiles_take_two_scans_whatever_the_columns(spark, monkeypatch):
    from colonnade.operators import quantiles

    lineitem = spark.read.parquet(f"{DATA}/sf0.01/lineitem.parquet")
    scans = []
    monkeypatch.setattr(DataFrame, "first", lambda df, first=DataFrame.first: scans.append(plan(df)) or first(df))
    columns = ["l_tax", "l_quantity", "l_extendedprice", "l_shipdate", "l_orderkey"]
    found = quantiles.quantiles(lineitem, columns, [0.1, 0.5, 0.9], gathered=50_000)
    assert len(scans) == 2
    exact = {(r.column, r.p): r.value for r in quantiles.quantiles(lineitem, columns, [0.1, 0.5, 0.9]).collect()}
    assert {(r.column, r.p): r.value for r in found.collect()} == exact
    # Where the first bounds leave much between them, the next scan is of the narrow stretch only.
    del scans[:]
    again = quantiles.quantiles(lineitem, ["l_extendedprice"], [0.5], gathered=1)
    assert again.first().value == exact["l_extendedprice", 0.5]
    assert any("GreaterThan(l_extendedprice" in text and "LessThan(l_extendedprice" in text for text in scans[2:])
