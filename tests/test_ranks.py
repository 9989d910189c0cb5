"""The rank index against sorts of whole lists."""

import datetime
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colonnade.operators import paging, ranks
from colonnade.operators.ranks import RankIndex

DAY = datetime.datetime(2024, 3, 10, 1, 30)
KINDS = {
    "i int": lambda rng: rng.randrange(40),
    "s string": lambda rng: rng.choice(["", "a", "b c", "É", "z\n", "it's", "\\"]),
    "x double": lambda rng: rng.choice([0.1, -1e300, 1e-9, math.nan, math.inf, 2.5]),
    "d date": lambda rng: DAY.date() + datetime.timedelta(rng.randrange(9)),
    "t timestamp_ntz": lambda rng: DAY + datetime.timedelta(microseconds=rng.randrange(5)),
    "z timestamp": lambda rng: DAY + datetime.timedelta(hours=rng.randrange(5)),
    "m decimal(20,4)": lambda rng: (Decimal(rng.randrange(9)) / 16).quantize(Decimal("0.0001")),
    "o boolean": lambda rng: rng.random() < 0.5,
    "y binary": lambda rng: bytes([rng.randrange(3), 255]),
    "f float": lambda rng: rng.choice([0.125, 2.0**100, -0.25]),
}


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(ranks, "STRETCH_ROWS", 10)
    monkeypatch.setattr(ranks, "FANOUT", 12)
    monkeypatch.setattr(ranks, "DEALT", 4)


def key_of(value, up):
    """Orders as the frame does: nulls last, NaN greatest."""
    if value is None:
        return (1, 0)
    if isinstance(value, float):
        value = (math.isnan(value), 0 if math.isnan(value) else value)
    if isinstance(value, str):
        value = value.encode()
    return (0, value if up else Backwards(value))


class Backwards:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return other.value == self.value


@pytest.mark.parametrize(("field", "stored"), [(f, True) for f in sorted(KINDS)] + [("s string", False), ("x double", False)])
def test_every_page_of_any_type(spark, tmp_path, tiny, field, stored):
    rng = random.Random(field)
    rows = [(None if rng.random() < 0.1 else KINDS[field](rng), rng.randrange(3)) for _ in range(110)]
    df = spark.createDataFrame(rows, f"{field}, g int")
    if stored:
        path = str(tmp_path / "t.parquet")
        df.repartition(3).write.parquet(path)
        df = spark.read.parquet(path)
    name, up = field.split()[0], rng.random() < 0.5
    order = [(name, up), ("g", not up)]
    index = RankIndex(df, order)
    assert index.total == 110
    want = sorted(rows, key=lambda r: (key_of(r[0], up), key_of(r[1], not up)))
    got = [tuple(r) for at in (0, 47, 94) for r in index.rows(at, 47).collect()]
    assert list(map(str, got)) == list(map(str, want))
    again = RankIndex.from_json(df, order, index.to_json())
    assert str(again.rows(63, 4).collect()) == str(index.rows(63, 4).collect())
    numbered = sorted(index.numbered("n").collect(), key=lambda r: r.n)
    assert [r.n for r in numbered] == list(range(1, 111)) and [str((r[0], r[1])) for r in numbered] == list(map(str, want))


def test_many_equal_rows_without_a_file(spark, tiny):
    df = spark.createDataFrame([(5,)] * 200 + [(6,)] * 3 + [(4,)] * 40, "v int").repartition(4)
    index = RankIndex(df, [("v", True)])
    assert [r.v for r in index.rows(30, 100).collect()] == [4] * 10 + [5] * 90
    assert [r.v for r in index.rows(235, 20).collect()] == [5] * 5 + [6] * 3
    assert index.rows(243, 5).collect() == [] and RankIndex(df.where("v > 9"), [("v", True)]).rows(0, 5).collect() == []


def test_long_stretches_are_indexed_when_needed(spark, tmp_path, tiny):
    path = str(tmp_path / "t.parquet")
    spark.range(2000).withColumn("v", F.lit(1)).repartition(3).write.parquet(path)
    index = RankIndex(spark.read.parquet(path), [("v", True), ("id", False)])
    assert all(s.parts is None for s in index.stretches)
    assert [r.id for r in index.rows(1500, 30).collect()] == list(range(499, 469, -1))
    assert sum(s.parts is not None for s in index.stretches) in (1, 2)


def test_nested_values_cannot_be_ranked(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(ValueError, match="ranked"):
        RankIndex(df, [("a", True)])


def test_table_pages_use_the_saved_index(spark, tmp_path, tiny):
    from colonnade.operators import filters as flt
    from colonnade.table import Table

    path = str(tmp_path / "t.parquet")
    spark.range(500).repartition(2).write.parquet(path)
    table = Table.open(spark, path).add_filters(flt.above("id", 99), flt.sort_by("id", False))
    assert [r.id for r in table.page(3, 50).collect()] == list(range(349, 299, -1))
    kept = [p.name for p in tmp_path.iterdir() if p.name.startswith("ranks_")]
    assert len(kept) == 1
    assert [r.id for r in table.page(7, 50).collect()] == list(range(149, 99, -1))
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("ranks_")] == kept
    other = table.clear_filters().add_filters(flt.sort_by("id"))
    assert [r.id for r in other.page(1, 10).collect()] == list(range(10, 20))
    assert paging.page(table.view(), [("id", True)], 2, 10).first().id == 120
