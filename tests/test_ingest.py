import datetime

import pytest
from pyspark.sql import functions as F

from colonnade.functions import casts
from colonnade.sources import datagen, ingest, text
from colonnade.types import LogicalType
from tests.conftest import values


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_date_layouts_in_order(spark):
    cases = {
        "31/02/2021": None, "1/2/2023": (2023, 2, 1), "13/13/2013": None, "2023-9-5": (2023, 9, 5),
        "12/31/2023": (2023, 12, 31), "05/06/2023": (2023, 6, 5), "01/01/10000": None,
        " 1/2/2023 ": (2023, 2, 1), "29/02/2023": None, "2020/31/12": None, "00/00/0000": None,
        "2023-09-05 10:00": None, "not_a_date": None, "-1/-1/-1": None, "32/13/2023": None,
        "2023-99-99": None, "1/2/0023": (23, 2, 1),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.d for r in df.select("t", casts.to_timestamp(F.col("t")).alias("d")).collect()}
    assert got == {t: d and datetime.datetime(*d) for t, d in cases.items()}


def test_quotes_and_blank_cells(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b,c\n"x, y","say ""hi""",1\n, ,2\n"",z,3\n')
    df = text.read_text_table(spark, path)
    assert [tuple(r) for r in df.collect()] == [("x, y", 'say "hi"', "1"), (None, None, "2"), (None, "z", "3")]


@pytest.mark.parametrize(("sep", "name"), [(";", "a.csv"), ("\t", "a.txt"), ("|", "a.txt"), ("\t", "a.tsv"), (",", "a.dat")])
def test_delimiters_are_found(spark, tmp_path, sep, name):
    lines = [sep.join(row) for row in (["id", "price", "note"], ["1", '"1,5"', "a b"], ["2", '"2,5"', "c"])]
    path = write(tmp_path / name, "\n".join(lines) + "\n")
    df = text.read_text_table(spark, path)
    assert df.columns == ["id", "price", "note"]
    assert values(df, "price") == ["1,5", "2,5"]


def test_names_that_differ_in_case_only(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,x\n1,2\n")
    assert text.read_text_table(spark, path).columns == ["id", "x"]
    from colonnade.types import check_distinct_names

    with pytest.raises(ValueError):
        check_distinct_names(["id", "ID"])


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n"two\nlines",1\n')
    assert values(text.read_text_table(spark, path, multiline=True)) == ["two\nlines"]


def test_ingest_types_and_reopens(spark, tmp_path):
    path = write(
        tmp_path / "small.csv",
        "id,val,flag,day,name,none\n1,10.0,yes,1/2/2023,a,\n2,20.0,no,2023-03-04, ,\n7,\"3,5\",no,,c,\n",
    )
    table = ingest.ingest(spark, path, str(tmp_path / "small.parquet"))
    assert table.alias == "small"
    assert [table.kind(c).value for c in table.columns] == [
        "INTEGER", "DOUBLE", "BOOLEAN", "DATE", "STRING", "EMPTY"
    ]
    assert [tuple(r) for r in table.df.orderBy("id").collect()] == [
        (1, 10.0, True, datetime.datetime(2023, 2, 1), "a", None),
        (2, 20.0, False, datetime.datetime(2023, 3, 4), None, None),
        (7, 3.5, False, None, "c", None),
    ]


def test_zero_and_one_are_boolean_and_decimals_are_not_integers(spark):
    df = spark.createDataFrame([("0", "1.5"), ("1", "2.0")], "b string, d string")
    assert ingest.voted_types(ingest.vote(df)) == {"b": LogicalType.BOOLEAN, "d": LogicalType.DOUBLE}
    lenient = ingest.voted_types(ingest.vote(df, lenient_int=True))
    assert lenient["d"] is LogicalType.INTEGER


def test_number_texts(spark):
    texts = ["1.5", "1e3", " 7 ", "1,5", "99999999999", "abc", "1.0", ".5", "5.", "+7", "1d", "--", "1.5.3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(casts.to_double(F.col("t")))) == [
        1.5, 1000.0, 7.0, 1.5, 99999999999.0, None, 1.0, 0.5, 5.0, 7.0, None, None, None
    ]
    assert values(df.select(casts.to_integer(F.col("t"))))[2:5] == [7, None, None]


def test_sensitivity_and_empty_columns(spark):
    rows = [(str(i) if i > 5 else "x", None) for i in range(60)]
    df = spark.createDataFrame(rows, "n string, e string")
    assert ingest.voted_types(ingest.vote(df))["n"] is LogicalType.STRING
    assert ingest.voted_types(ingest.vote(df, sensitivity=0.9))["n"] is LogicalType.INTEGER
    assert ingest.voted_types(ingest.vote(df))["e"] is LogicalType.STRING


def test_tables_without_rows_and_wide_tables(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    votes = ingest.vote(df.where("false"))
    assert values(votes.orderBy("ordinal"), "logical_type") == ["STRING", "STRING"]
    wide = df.select(*[F.col("ab"[i % 2]).alias(f"c{i}") for i in range(300)])
    kinds = ingest.voted_types(ingest.vote(wide))
    assert len(kinds) == 300
    assert {kinds["c0"], kinds["c298"]} == {LogicalType.BOOLEAN}
    assert {kinds["c1"], kinds["c299"]} == {LogicalType.STRING}


def test_malformed_lines_fall_back_to_the_lenient_reader(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "a,b\n1,x\n2\n3,z,extra\n4,w\n")
    table = ingest.ingest(spark, path, str(tmp_path / "bad.parquet"))
    assert sorted(values(table.df, "a")) == [1, 4]
    assert table.kind("a") is LogicalType.INTEGER
    lenient = text.read_lenient(spark, path)
    assert lenient.count() == lenient.select("a").count() == 2


def test_generated_tables(spark, tmp_path):
    df = datagen.dirty_table(spark, 20_000, seed=1)
    assert df.columns == ["id", "name", "email", "age", "date"]
    again = datagen.dirty_table(spark, 20_000, seed=1).repartition(3)
    assert df.exceptAll(again).count() == 0
    assert df.exceptAll(datagen.dirty_table(spark, 20_000, seed=2)).count() > 15_000
    share = df.agg(
        F.avg((F.col("name") == "").cast("int")).alias("empty"),
        F.avg((F.col("age") == "NULL").cast("int")).alias("null"),
        F.avg(F.col("email").isin(*datagen.BAD_EMAILS).cast("int")).alias("bad"),
    ).first()
    assert (share.empty, share.null, share.bad) == pytest.approx((0.04, 0.03, 0.05), abs=0.01)
    path = datagen.write_csv(df, str(tmp_path / "dirty.csv"))
    read = text.read_text_table(spark, path, sep=",")
    strict = ingest.voted_types(ingest.vote(read))
    assert strict["id"] is LogicalType.INTEGER
    assert strict["age"] is strict["date"] is LogicalType.STRING
    loose = ingest.voted_types(ingest.vote(read, sensitivity=0.9))
    assert loose["age"] is LogicalType.INTEGER and loose["date"] is LogicalType.DATE


def test_generated_sizes(spark):
    assert datagen.parse_size("10KB") == (10_240, True)
    assert datagen.parse_size("2gb") == (2 * 1024**3, True)
    assert datagen.parse_size("500") == (500, False)
    df = datagen.dirty_table_of_size(spark, 200_000)
    assert df.columns == ["id", "name", "email", "age"]
    size = df.agg(F.sum(F.length(F.concat_ws(",", *df.columns)) + 1)).first()[0]
    assert abs(size - 200_000) < 10_000


QUOTED = {
    "first": 'a,b,c\n"x\ny",1,2\nplain,3,4\n',
    "middle": 'a,b,c\n1,"hello\nworld",3\n2,plain,4\n3,"a,b",5\n',
    "last": 'a,b,c\n1,2,"end\nof"\n3,4,"q""uote"\n',
    "halves": 'a,b\n1,"x\ny,2"\n3,4\n',
    "none": 'a,b\n1,"x,y"\n3,"say ""hi"""\n',
}


@pytest.mark.parametrize("name", sorted(QUOTED))
def test_quoted_line_breaks_read_as_duckdb_reads_them(spark, tmp_path, name):
    import duckdb

    path = write(tmp_path / f"{name}.csv", QUOTED[name])
    got = sorted(tuple(r) for r in text.read_text_table(spark, path, sep=",").collect())
    want = duckdb.sql(f"SELECT * FROM read_csv('{path}', all_varchar=true, header=true, delim=',')").fetchall()
    assert got == sorted(want)
    assert (text.dialect_of(spark, path).broken == ()) == (name == "none")


def test_only_files_with_broken_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", 'a,b\n1,"x\ny"\n')
    write(tmp_path / "d" / "b.csv", "a,b\n2,z\n")
    got = text.read_text_table(spark, str(tmp_path / "d"), sep=",")
    assert sorted(tuple(r) for r in got.collect()) == [("1", "x\ny"), ("2", "z")]


def test_refused_lines_are_kept_and_counted(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "a,b\n1,x\n2\n3,z,extra\n4,w\n")
    out = str(tmp_path / "kept.parquet")
    with pytest.warns(UserWarning, match="2 malformed lines"):
        table = ingest.ingest(spark, path, out)
    assert sorted(values(table.df, "a")) == [1, 4]
    assert ingest.refused_count(spark, out) == 2
    refused = spark.read.parquet(ingest.refused_path(out))
    assert sorted(values(refused, text.REFUSED)) == ["2", "3,z,extra"]


def test_empty_files_and_clashing_headers_are_refused(spark, tmp_path):
    from colonnade.sources.files import UnreadableTable

    with pytest.raises(UnreadableTable):
        text.read_text_table(spark, write(tmp_path / "empty.csv", ""), sep=",")
    with pytest.raises(ValueError, match="differ only in case"):
        text.read_text_table(spark, write(tmp_path / "clash.csv", "a,A,b\n1,2,3\n"), sep=",")


@pytest.mark.parametrize("lenient", [False, True])
def test_fits_marks_what_the_casts_read(spark, lenient):
    texts = ["", " ", "1", "0", "t", "YES", "no", " 7 ", "+7", "-12", "1.5", "1,5", "1e5", "-1e-5", "nan", "-inf", "Infinity", ".5", "5.", ".", "99999999999",
             "2147483647", "2147483648", "1/2/2023", "31/02/2021", "2023-9-5", "12/31/2023", " 1/2/2023 ", "1-2", "--", "1d", "0x1F", "1_000", "a/1", None, "true ", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    marked = casts.fits(t, lenient).alias("bits")
    read = [casts.cast_text(t, kind, lenient).isNotNull().alias(kind.value) for kind in casts.FIT_BITS]
    for row in df.select(t, marked, *read).collect():
        if row.t is None:
            assert row.bits is None
            continue
        assert {kind for kind, bit in casts.FIT_BITS.items() if row.bits & bit} == {kind for kind in casts.FIT_BITS if row[kind.value]}, row
