"""The registered queries with SQL against DuckDB, and the contracts of the others."""

import os

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from colonnade.llm import queries
from tests.compare import connect, difference

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert difference(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name]) is None


def test_every_operator_is_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages_of_the_pipeline():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
