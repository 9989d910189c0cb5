import random

import pytest

from colonnade.operators import merge
from tests.conftest import values


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0), (None, "n", 4.0)],
        "k int, k2 string, x double",
    )
    right = spark.createDataFrame([(2, 20.0), (3, 30.0), (None, 40.0)], "K int, x double")
    return left, right


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def test_join_types_keep_the_left_key(sides):
    left, right = sides
    pairs = [("k", "K")]
    both = [(2, "b", 2.0, 20.0), (2, "c", 3.0, 20.0)]
    left_only = [(1, "a", 1.0, None), (None, "n", 4.0, None)]
    right_only = [(None, None, None, 30.0), (None, None, None, 40.0)]
    key = lambda r: tuple((v is None, v) for v in r)
    assert rows(merge.join(left, right, "inner", pairs)) == both
    assert rows(merge.join(left, right, "left", pairs)) == sorted(both + left_only, key=key)
    assert rows(merge.join(left, right, "right", pairs)) == sorted(both + right_only, key=key)
    everything = sorted(both + left_only + right_only, key=key)
    assert rows(merge.join(left, right, "full", pairs)) == everything


def test_output_names(sides):
    left, right = sides
    joined = merge.join(left, right, "inner", [("k", "K")])
    assert joined.columns == ["k", "k2", "x", "right_table_x"]
    assert merge.output_columns(["a", "right_table_a"], ["a"], []) == [("a", "right_table_right_table_a")]


def test_auto_keys_ignore_case():
    assert merge.auto_keys(["Id", "name", "x"], ["NAME", "id", "y"]) == [("Id", "id"), ("name", "NAME")]
    assert merge.auto_keys(["a"], ["b"]) == []
    assert merge.result_name("l", "r") == "l_r"


def test_refusals(spark, sides):
    left, right = sides
    with pytest.raises(ValueError):
        merge.join(left, right, "inner", [])
    with pytest.raises(ValueError):
        merge.join(left, right, "cross", [("k", "K")])
    with pytest.raises(ValueError):
        merge.join(left, right, "inner", [("k2", "K")])
    with pytest.raises(ValueError):
        merge.union(left, right)


@pytest.mark.parametrize("how", merge.JOIN_TYPES)
@pytest.mark.parametrize("key_type", ["int", "double", "string"])
def test_hot_keys_change_nothing(spark, how, key_type):
    rng = random.Random(11)

    def side(n, offset):
        keys = [7 if rng.random() < 0.4 else rng.choice([None, *range(offset, offset + 30)]) for _ in range(n)]
        return spark.createDataFrame(list(enumerate(keys)), "i int, k int").selectExpr(
            "i", f"cast(k as {key_type}) as k"
        )

    left, right = side(60, 0).repartition(3), side(80, 20).repartition(3)
    plain = rows(merge.join(left, right, how, [("k", "k")], hot_rows=None))
    split = rows(merge.join(left, right, how, [("k", "k")], hot_rows=3))
    renamed = right.selectExpr("i as j", "k as rk")
    native = left.join(renamed, left.k == renamed.rk, how).select("i", "k", "j")
    assert plain == split == rows(native)
    assert len(plain) > 100


def test_hot_key_on_one_side_only(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(9, i) for i in range(50)] + [(2, 0)], "k int, v int")
    got = merge.join(left, right, "full", [("k", "k")], hot_rows=10)
    assert got.count() == 52
    assert rows(got.where("k is not null")) == [(1, None), (2, 0)]


def test_keys_of_different_number_types(spark):
    left = spark.createDataFrame([(1,), (2,), (0,)], "k bigint")
    right = spark.createDataFrame([(1.0, "a"), (2.5, "b"), (-0.0, "z")], "k double, t string")
    for hot in (None, 1):
        got = merge.join(left, right, "left", [("k", "k")], hot_rows=hot)
        assert rows(got) == [(0, "z"), (1, "a"), (2, None)]


def test_hot_key_detection(spark):
    df = spark.range(10_000).selectExpr("case when id % 3 = 0 then 1L else id end as k")
    assert merge.hot_keys(df, hot_rows=1000) == {1}
    assert merge.hot_keys(df, hot_rows=5000) == set()
    assert merge.hot_keys(df.where("false"), hot_rows=1) == set()


def test_union_by_position(spark):
    left = spark.createDataFrame([(1, "x")], "a int, b string")
    right = spark.createDataFrame([("y", 2)], "c string, d int")
    got = merge.union(left, right)
    assert got.columns == ["a", "b"]
    assert rows(got) == [("1", "x"), ("y", "2")]
    wide = merge.union(left, spark.createDataFrame([(2**40, "z")], "q bigint, r string"))
    assert values(wide) == [1, 2**40]
    assert merge.union(left, left).count() == 2


def test_hot_key_of_the_unsplittable_side_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left = spark.range(2000).selectExpr("id as k", "id * 2 as w").repartition(4)
        right = spark.range(200_000).selectExpr(
            "case when id % 3 = 0 then 7 else id % 2003 end as k", "hash(id) as v"
        ).repartition(4)

        def final_plan(hot_rows):
            df = merge.join(left, right, "left", [("k", "k")], hot_rows).selectExpr("sum(w)", "sum(v)")
            (total,) = df.collect()
            plan = df._jdf.queryExecution().executedPlan()
            return total, plan.toString().split("Initial Plan")[0]

        plain, plain_plan = final_plan(None)
        split, split_plan = final_plan(10_000)
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert plain == split
    assert "skew=true" not in plain_plan
    assert "skew=true" in split_plan


@pytest.mark.parametrize("types", [("int", "int"), ("int", "bigint"), ("double", "double"), ("string", "string"), ("int", "double")])
def test_keys_that_make_many_rows_are_dealt_to_tasks(spark, monkeypatch, types):
    from pyspark.sql import functions as F

    monkeypatch.setattr(merge, "SPREAD_ROWS", 100)
    rng = random.Random(5)
    key = lambda: rng.choice([None, 1, 1, 1, 2, 2, *range(3, 40)])
    left, right = (
        spark.createDataFrame([(i // 2, key()) for i in range(n)], "i int, k int").selectExpr("i", f"cast(k as {t}) as k").repartition(3)
        for n, t in zip((900, 300), types, strict=True)
    )
    joined = merge.join(left, right, "inner", [("k", "k")])
    assert joined.columns == ["i", "k", "right_table_i"]
    renamed = right.selectExpr("i as j", "k as rk")
    native = left.join(renamed, left.k == renamed.rk).select("i", "k", "j")
    assert rows(joined) == rows(native)
    if types != ("int", "double"):
        dealt = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) > 8 and max(r["count"] for r in dealt) < joined.count() / 4


def test_a_join_of_few_rows_a_key_keeps_its_plan(spark):
    left, right = (spark.range(50).selectExpr("id as k", f"id as {name}") for name in "ab")
    plan = merge.join(left, right, "inner", [("k", "k")])._jdf.queryExecution().toString()
    assert "Union" not in plan and "explode" not in plan.lower()
