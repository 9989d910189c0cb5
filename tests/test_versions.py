"""Edits that rewrite one file of many."""

import pytest

from colonnade.operators import filters as flt
from colonnade.sources import versions
from colonnade.sources.dialect import plain_path
from colonnade.table import Catalog, Table
from colonnade.types import LogicalType
from tests.conftest import values


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(400).selectExpr("id", "cast(null as string) as note", "id % 7 as digit").repartitionByRange(8, "id").write.parquet(path)
    return Table.open(spark, path)


def parts(table):
    return set(map(plain_path, table.df.inputFiles()))


def test_an_edit_writes_one_file_of_many(spark, stored):
    assert len(parts(stored)) == 8
    edited = stored.update_cell(123, "note", "changed")
    assert len(parts(edited)) == 8 and len(parts(edited) - parts(stored)) == 1
    assert values(edited.df.where("note = 'changed'"), "id") == [123]
    assert stored.df.where("note is not null").count() == 0
    assert edited.kind("note") is LogicalType.STRING and stored.kind("note") is LogicalType.EMPTY
    # Rows stay in order through edits of this and other files, and of the new file again.
    twice = edited.update_cell(125, "note", "again").update_cell(300, "note", "third")
    assert len(parts(twice) & parts(stored)) == 6
    got = [(r.id, r.note) for i in range(4) for r in twice.page(i, 100).collect()]
    marks = {123: "changed", 125: "again", 300: "third"}
    assert got == [(i, marks.get(i)) for i in range(400)]
    assert values(edited.df.where("note is not null"), "id") == [123]


def test_edits_of_sorted_and_filtered_views(spark, stored):
    view = stored.add_filters(flt.equal("digit", 3), flt.sort_by("id", False))
    edited = view.update_cell(0, "digit", "100")
    assert values(edited.clear_filters().df.where("digit = 100"), "id") == [395]
    last = view.update_cell(56, "digit", "100")
    assert values(last.clear_filters().df.where("digit = 100"), "id") == [3]
    assert view.update_cell(57, "digit", "1") is view and view.update_cell(-1, "digit", "1") is view


def test_versions_are_tables_like_others(spark, stored):
    edited = stored.update_cell(5, "note", "x")
    opened = Table.open(spark, edited.path)
    assert values(opened.df.where("note = 'x'"), "id") == [5] and opened.df.count() == 400
    assert set(versions.files(spark, edited.path)) == parts(edited)
    retyped = edited.retype("digit", LogicalType.STRING)
    assert retyped.path.endswith(".parquet") and values(retyped.df.where("note = 'x'"), "digit") == ["5"]
    catalog = Catalog(spark)
    catalog.add(stored, edited.renamed("edited"))
    sizes = {r.alias: (r.bytes, r.row_count) for r in catalog.inventory().collect()}
    assert sizes["edited"][0] > 0.8 * sizes["many"][0] and sizes["edited"][1] == 400


def test_a_table_of_one_file(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(50).coalesce(1).write.parquet(path)
    (file,) = spark.read.parquet(path).inputFiles()
    table = Table.open(spark, file).update_cell(7, "id", "-1")
    assert values(table.df)[7] == -1 and table.df.count() == 50
