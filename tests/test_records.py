"""Files whose quoted cells span lines, read by many tasks, and the survey of a file's dialect."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.sources import dialect, ingest, records, text
from colonnade.sources.files import UnreadableTable
from colonnade.types import LogicalType
from tests.conftest import values


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "300b")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def cell(rng):
    word = lambda: rng.choice(["a", "bc", "d e", "1,5", 'say ""hi""', "x\ny", "\n", '""', "long " * 9, "z\n\nz", "é"])
    made = "".join(word() for _ in range(rng.randrange(1, 5)))
    plain = not any(sign in made for sign in ',"\n')
    return made if plain and rng.random() < 0.7 else f'"{made}"'


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def by_duckdb(path):
    return sorted(map(str, duckdb.sql(
        f"SELECT * FROM read_csv('{path}', all_varchar=true, header=true, delim=',', quote='\"', escape='\"', nullstr=['', ' '], auto_detect=false, "
        "columns={'a': 'VARCHAR', 'b': 'VARCHAR', 'c': 'VARCHAR'})"
    ).fetchall()))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(3))
def test_one_file_is_read_by_many_tasks_and_equals_duckdb(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    lines = [",".join(cell(rng) for _ in range(3)) for _ in range(400)]
    path = write(tmp_path / "cells.csv", end.join(["a,b,c", *lines]) + end)
    df = text.read_text_table(spark, path, sep=",")
    assert rows_of(df) == by_duckdb(path)
    read = records.lines_of(spark, [path])
    assert read.rdd.getNumPartitions() > 10
    states = records.block_states(read, ",")
    blocks = {row.block: row.inside for row in states.collect()}
    assert len(blocks) > 10 and any(blocks.values()) and not blocks[0]


def test_cells_wider_than_splits_and_a_header_with_a_line_break(spark, tmp_path, small_splits):
    rows = [("x\n" * 700, "1", "p"), ("q", '"' * 500 + "\n", "r"), ("s", "t", "u\n" * 400)]
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    path = write(tmp_path / "wide.csv", '"a\nbreak",b,c\n' + "".join(",".join(map(quote, row)) + "\n" for row in rows))
    df = text.read_text_table(spark, path)
    assert df.columns == ["a\nbreak", "b", "c"]
    assert sorted(map(tuple, df.collect())) == sorted(rows)


def test_quotes_inside_plain_cells_are_text(spark, tmp_path, small_splits):
    lines = [f'{i},12" disk,{"x" * (i % 50)}' for i in range(100)]
    path = write(tmp_path / "disks.csv", "a,b,c\n" + "\n".join(lines) + '\n7,"two\nlines",z\n')
    df = text.read_text_table(spark, path)
    assert df.count() == 101 and df.where("b = '12\" disk'").count() == 100


def test_malformed_records_of_split_files_are_set_aside(spark, tmp_path, small_splits):
    body = "".join(f'{i},"x\n{i}"\n' + ("1,2,3\n" if i % 10 == 0 else "") for i in range(100))
    path, out = write(tmp_path / "some.csv", "a,b\n" + body), str(tmp_path / "some.parquet")
    with pytest.warns(UserWarning, match="10 malformed lines"):
        table = ingest.ingest(spark, path, out)
    assert table.df.count() == 100 and table.kind("a") is LogicalType.INTEGER
    assert set(values(spark.read.parquet(ingest.refused_path(out)), text.REFUSED)) == {"1,2,3"}


def walk(line, sep, inside):
    """Character by character."""
    start = not inside
    k = 0
    while k < len(line):
        if inside:
            if line[k] == '"':
                if line[k + 1 : k + 2] == '"':
                    k += 1
                else:
                    inside = False
            start = False
        elif line[k] == '"' and start:
            inside, start = True, False
        else:
            start = line[k] == sep
        k += 1
    return inside


@settings(max_examples=500, deadline=None)
@given(st.text('ab",', max_size=14), st.booleans())
def test_open_cells(line, inside):
    assert records.open_at_end(line, ",", inside) == walk(line, ",", inside)


def test_the_dialect_does_not_depend_on_the_first_lines(spark, tmp_path):
    notes = "".join(f"# note {i}, and {i}, then {i}\n" for i in range(30))
    path = write(tmp_path / "late.txt", "k;price;day\n" + notes + "".join(f"{i};1,{i};2024-01-02\n" for i in range(2000)))
    assert dialect.survey(spark, path).sep == ";"
    quoted = write(tmp_path / "quoted.txt", "a|b\n" + "".join(f'"x,y,z;{i}"|2\n' for i in range(50)))
    assert dialect.survey(spark, quoted) == dialect.Dialect("|")


def test_bytes_that_are_no_utf8(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "old.csv", "name,n\nRenée,1\nÅsa,2\n", "latin-1")
    write(folder / "new.csv", "name,n\nZoë,3\n")
    write(folder / "both.csv", 'name,n\n"Jürgen\nK",4\n', "latin-1")
    found = text.dialect_of(spark, str(folder))
    assert [p.rsplit("/", 1)[1] for p in found.other_bytes] == ["both.csv", "old.csv"]
    df = text.read_text_table(spark, str(folder))
    assert rows_of(df) == sorted(map(str, [("Renée", "1"), ("Åsa", "2"), ("Zoë", "3"), ("Jürgen\nK", "4")]))
    one = text.read_text_table(spark, str(folder / "old.csv"), encoding="ISO-8859-1")
    assert values(one.orderBy("n")) == ["Renée", "Åsa"]
    with pytest.raises(ValueError, match="encoding"):
        text.read_text_table(spark, str(folder), encoding="KOI8-R")


def test_empty_files_have_no_header(spark, tmp_path):
    with pytest.raises(UnreadableTable):
        text.read_text_table(spark, write(tmp_path / "none.csv", ""))
