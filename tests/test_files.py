import zipfile

import pytest
from pyspark.sql import functions as F

from colonnade.operators import filters as flt
from colonnade.sources import bundle, files, loader, sink
from colonnade.table import Catalog, Table, human_size, with_human_size
from colonnade.types import LogicalType
from tests.conftest import values


@pytest.fixture
def stored(spark, main, tmp_path):
    path = str(tmp_path / "main.parquet")
    main.coalesce(1).write.parquet(path)
    return Table.open(spark, path)


def test_invalid_files_are_refused(spark, tmp_path):
    for name, content in (("a.txt", "x"), ("empty.parquet", ""), ("fake.parquet", "plain text")):
        path = tmp_path / name
        path.write_text(content)
        with pytest.raises(files.UnreadableTable):
            Table.open(spark, str(path))
    with pytest.raises(files.UnreadableTable):
        Table.open(spark, str(tmp_path / "missing.parquet"))


def test_open_marks_empty_columns(stored):
    assert stored.alias == "main"
    assert stored.kind("empty_col") is LogicalType.EMPTY
    assert stored.columns_for("value") == ["id", "val"]
    assert stored.columns_for("group") == ["txt", "flag"]
    assert "empty_col" not in stored.columns_for("filter")
    assert stored.column(1) == "val"
    with pytest.raises(ValueError):
        stored.column(6)


def test_filters_live_on_the_handle(stored):
    table = stored.add_filters(flt.hide_empty("val"), flt.sort_by("val", False))
    assert values(table.row_count()) == [4]
    assert values(table.page(0, 2, ["id"]), "id") == [5, 2]
    assert values(table.page(1, 2), "id") == [1, 4]
    assert values(stored.page(1, 3), "id") == [4, 5]
    assert values(stored.row_count()) == [5]
    assert table.clear_filters("val").filters == ()
    assert values(table.cell(1, "txt")) == ["beta"]
    assert values(stored.cell(4, 0)) == [5] and values(stored.cell(5, 0)) == []
    assert values(stored.above("txt", 5).view(), "id") == [3]
    assert values(stored.below(1, 10).view(), "id") == [4]
    table.clear_filters().save_filters()
    table.save_filters()
    assert stored.load_filters().filters == table.filters
    assert table.sorted_by("txt").filters == (flt.sort_by("txt"),)
    with pytest.raises(ValueError):
        stored.add_filters(flt.equal("nope", 1))


def test_edits_write_a_new_file(spark, stored):
    typed = stored.retype("val", LogicalType.INTEGER)
    assert typed.path != stored.path
    assert sorted(values(typed.df, "id")) == [1, 2, 3, 4, 5]
    assert typed.kind("val") is LogicalType.INTEGER
    assert typed.kind("empty_col") is LogicalType.EMPTY
    assert stored.kind("val") is LogicalType.DOUBLE
    cell = typed.add_filters(flt.sort_by("id")).update_cell(0, "empty_col", "now filled")
    assert cell.kind("empty_col") is LogicalType.STRING
    assert values(cell.df.orderBy("id"), "empty_col") == ["now filled", None, None, None, None]
    with pytest.raises(Exception, match="(?i)exist"):
        sink.write_table(cell.df, cell.path)


def test_merged_and_grouped_tables_are_stored(spark, stored, tmp_path):
    other = Table(spark.createDataFrame([(1, "x"), (9, "y")], "ID int, note string"), "notes")
    joined = stored.merge(other, "left", folder=str(tmp_path))
    assert joined.alias == "main_notes" and joined.df.count() == 5
    assert joined.columns == [*stored.columns, "note"]
    assert joined.kind("empty_col") is LogicalType.EMPTY
    assert stored.merge(stored, "union", name="twice").df.count() == 10
    with pytest.raises(ValueError):
        stored.merge(other, "inner")
    by_flag = stored.add_filters(flt.above("val", 10)).subtable("flag", {"val": "sum"}, "by_flag", use_filters=True)
    assert {tuple(r) for r in by_flag.df.collect()} == {(True, 10.5), (False, 50.0)}
    with pytest.raises(ValueError):
        stored.subtable("flag", {"empty_col": "max"}, "bad")


def test_version_paths_do_not_grow(stored):
    once = sink.new_path(stored.path)
    twice = sink.new_path(once)
    assert len(once) == len(twice) and once != twice


def test_catalog_inventory(spark, stored):
    catalog = Catalog(spark)
    assert catalog.inventory().count() == 0
    catalog.add(stored, stored.renamed("other view").add_filters(flt.show_empty("val")))
    got = {r.alias: r for r in catalog.inventory().collect()}
    assert got["main"].row_count == 5 and got["other view"].row_count == 1
    assert got["main"].column_count == 6
    assert got["main"].bytes > 500 and got["main"]["size"] == human_size(got["main"].bytes)
    assert spark.table("`other view`").count() == 5
    catalog.remove("main")
    assert len(catalog) == 1


@pytest.mark.parametrize("size", [0, 1023, 1024, 1536, 1024**2 - 1, 1024**2, 5 * 1024**3, 3 * 1024**6])
def test_human_sizes_agree(spark, size):
    df = with_human_size(spark.createDataFrame([(size,)], "bytes bigint"))
    assert values(df, "size") == [human_size(size)]


def test_human_size_texts():
    assert [human_size(n) for n in (512, 1536, 1024**2)] == ["512 B", "1.5 KB", "1.0 MB"]


def test_json_and_xml_tables(spark, tmp_path):
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"id": 5, "x": "1,5"}\n{"id": 6, "x": null}\n')
    array = tmp_path / "a.json"
    array.write_text('[{"id": 5, "ok": true},\n {"id": 7, "ok": false}]')
    xml = tmp_path / "x.xml"
    xml.write_text("<rows><row><id>5</id><day>1/2/2023</day></row><row><id>6</id></row></rows>")
    out = str(tmp_path / "out")
    (first,) = loader.load(spark, str(lines), out)
    assert {c: first.kind(c).value for c in first.columns} == {"id": "INTEGER", "x": "DOUBLE"}
    (second,) = loader.load(spark, str(array), out)
    assert {c: second.kind(c).value for c in second.columns} == {"id": "INTEGER", "ok": "BOOLEAN"}
    (third,) = loader.load(spark, str(xml), out)
    assert {c: third.kind(c).value for c in third.columns} == {"id": "INTEGER", "day": "DATE"}
    assert third.df.count() == 2


def test_folders(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "a.csv").write_text("id,x\n1,2.5\n2,3.5\n")
    (root / "deep" / "b.tsv").write_text("id\tx\n3\t4.5\n")
    spark.range(4).repartition(2).write.parquet(str(root / "deep" / "c.parquet"))
    assert [files.base_name(p) for p in files.table_paths(spark, str(root))] == ["a", "b", "c"]
    tables = loader.load_folder(spark, str(root), str(tmp_path / "out"))
    assert {t.alias: t.df.count() for t in tables} == {"a": 2, "b": 1, "c": 4}


def test_folder_as_one_table(spark, tmp_path):
    for i in range(3):
        spark.range(i + 1).coalesce(1).write.parquet(str(tmp_path / "t" / f"{i}.parquet"))
    df = files.read_folder(spark, str(tmp_path / "t"))
    assert df.count() == 6
    assert df.select("source_file").distinct().count() == 3


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in entries.items():
            out.writestr(name, content)
    return str(path)


def test_zip_bundles(spark, tmp_path):
    path = make_zip(
        tmp_path / "b.zip",
        {"a.csv": "id,x\n1,2.5\n", "sub/a.csv": "id;y\n1;x\n2;z\n", "sub/": "", "t.tsv": "k\tv\n7\t8\n"},
    )
    listed = bundle.entries(spark, path)
    assert sorted(values(listed, "entry")) == ["a.csv", "sub/a.csv", "t.tsv"]
    tables = loader.load(spark, path, str(tmp_path / "out"))
    assert sorted((t.alias, t.df.count(), tuple(t.columns)) for t in tables) == [
        ("a", 1, ("id", "x")), ("a", 2, ("id", "y")), ("t", 1, ("k", "v"))
    ]


@pytest.mark.parametrize("name", ["../evil.csv", "/etc/evil.csv", "a/../../evil.csv", "..\\evil.csv", "C:\\evil.csv"])
def test_entries_that_leave_the_target(spark, tmp_path, name):
    path = make_zip(tmp_path / "b.zip", {"fine.csv": "a\n1\n", name: "a\n1\n"})
    with pytest.raises(bundle.UnsafeEntry):
        bundle.unpack(spark, path, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert not bundle.escapes("a/../fine.csv") and not bundle.escapes("..fine.csv")


@pytest.mark.parametrize(
    "content",
    ['{"a":1,"b":"x"}\n{"a":2,"b":"y"}\n{"a":3,"b":"z"}\n', '[{"a":1,"b":"x"},\n {"a":2,"b":"y"}]', '{"a":1,\n "b":"x"}', '[{"a":1,"b":"x"}]'],
)
def test_json_files_read_as_duckdb_reads_them(spark, tmp_path, content):
    import duckdb

    from colonnade.sources import files

    path = tmp_path / "j.json"
    path.write_text(content)
    got = sorted((r.a, r.b) for r in files.read_json(spark, str(path)).collect())
    want = duckdb.sql(f"SELECT a::VARCHAR, b FROM read_json('{path}')").fetchall()
    assert got == sorted(want)


def test_json_files_with_several_values_are_refused(spark, tmp_path):
    from colonnade.sources import files

    path = tmp_path / "j.json"
    path.write_text('{"a":\n1}\n{"a":\n2}\n')
    with pytest.raises(files.UnreadableTable):
        files.read_json(spark, str(path))


def test_equal_stems_of_a_folder_are_kept_apart(spark, tmp_path):
    from colonnade.sources.loader import load_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n5\n")
    (tmp_path / "in" / "a.tsv").write_text("y\tz\n7\t8\n")
    tables = load_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {t.alias: t.columns for t in tables} == {"a_csv": ["x"], "a_tsv": ["y", "z"]}


def test_archives_of_a_folder_keep_equal_entries_apart(spark, tmp_path):
    for n, name in enumerate(("a/x.zip", "b/x.zip", "b/y.zip")):
        (tmp_path / "zips" / name).parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(tmp_path / "zips" / name, "w") as made:
            made.writestr("in/data.csv", f"a,b\n{n},x\n")
    out = str(tmp_path / "out")
    paths = bundle.unpack(spark, str(tmp_path / "zips"), out)
    assert len(set(paths)) == 3
    assert sorted(open(path.removeprefix("file:"), encoding="utf-8").read().split("\n")[1] for path in paths) == ["0,x", "1,x", "2,x"]


@pytest.mark.parametrize(("uri", "want"), [
    ("s3a://bucket/k.zip", "s3://bucket/k.zip"), ("s3n://bucket/k", "s3://bucket/k"), ("s3://b/k", "s3://b/k"),
    ("file:///tmp/x.zip", "/tmp/x.zip"), ("file:/tmp/x.zip", "/tmp/x.zip"), ("hdfs://n/x", "hdfs://n/x"),
])
def test_addresses_as_tasks_take_them(uri, want):
    assert bundle.arrow_uri(uri) == want


def test_many_files_load_by_a_few_jobs(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep er").mkdir(parents=True)
    for n in range(40):
        (folder / f"t{n:02}.csv").write_text("id,x\n" + "".join(f"{k},{n}.5\n" for k in range(n % 5 + 2)))
        (folder / "deep er" / f"u{n:02}.txt").write_text(f"day;name;none\n1/2/2023;a{n};\n")
    (folder / "deep er" / "old+name%.csv").write_bytes("é;y\nÅ;1\n".encode("latin-1"))
    (folder / "broken.csv").write_text('id,x\n1,"a\nb"\n')
    (folder / "bare.csv").write_text("id,x\n")
    (folder / "bad.csv").write_text("id,x\n1,2\n3\n4,5,6\n7,8\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folder", "folder")
    with pytest.warns(UserWarning, match="2 malformed lines"):
        tables = loader.load_folder(spark, str(folder), str(tmp_path / "out"))
    jobs = len(tracker.getJobIdsForGroup("folder"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tables) == 84 and jobs < 60
    made = {t.alias: t for t in tables}
    assert made["t07"].kind("x") is LogicalType.DOUBLE and sorted(values(made["t07"].df, "x")) == [7.5] * 4
    assert made["u03"].columns == ["day", "name", "none"] and made["u03"].kind("none") is LogicalType.EMPTY
    assert values(made["u03"].df, "name") == ["a3"] and made["u03"].kind("day") is LogicalType.DATE
    assert [tuple(r) for r in made["old+name%"].df.collect()] == [("Å", True)] and made["old+name%"].columns == ["é", "y"]
    assert values(made["broken"].df, "x") == ["a\nb"] and made["bare"].df.count() == 0
    assert sorted(values(made["bad"].df)) == [1, 7]
    again = Table.open(spark, made["t07"].path)
    assert again.df.count() == 4 and again.columns == ["id", "x"]
    edited = made["t07"].update_cell(1, "x", "9")
    assert values(edited.df, "x").count(9.0) == 1
