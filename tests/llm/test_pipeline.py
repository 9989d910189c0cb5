"""The pipeline stage by stage against plain versions of each stage's rule."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import decontam, pii, toxicity
from colonnade.llm.shared import table
from tests.llm.frames import AWKWARD, documents
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first and after every stage."""
    docs = [table(spark, FOLDER, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.written(stage(spark, docs[-1], FOLDER), f"test-{name}"))
    return docs


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_columns(steps):
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == before.columns


def test_toxic_documents_go_and_no_others(spark, steps):
    model = toxicity.fit(steps[0], table(spark, FOLDER, "labels"))
    texts = rows(steps[0])
    scores = dict(zip(texts, model.reader().scores([r["text"] for r in texts.values()]), strict=True))
    assert rows(steps[1]) == {i: r for i, r in texts.items() if scores[i] < toxicity.CUT}


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    component = brute({i: r["text"] for i, r in before.items()})
    assert rows(steps[2]) == {i: r for i, r in before.items() if component[i][1] == i}


def test_leaks_go(spark, steps):
    before = rows(steps[2])
    items = [(r.item_id, decontam.plain(r.text)) for r in table(spark, FOLDER, "benchmark").collect()]
    passages = [p for _, t in items for p in decontam.passages(t)]
    kept = rows(steps[3])
    assert all(before[i] == r for i, r in kept.items())
    for i, r in before.items():
        text = decontam.plain(r["text"])
        if any(p in text for p in passages):
            assert i not in kept
        elif i not in kept:
            assert any(decontam.myers(p, text)[0] <= len(p) // 10 for p in passages)


def test_personal_data_is_replaced(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert pii.propose(r["text"])[0] == [] and r["n_chars"] == len(r["text"])
        if not pii.propose(before[i]["text"])[0]:
            assert r["lang"] == before[i]["lang"] and len(r["text"]) <= len(before[i]["text"])


def test_every_document_is_packed_and_run_gives_the_same(spark, steps):
    packed = steps[5]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(rows(steps[4]))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, FOLDER).select(*kept).collect()) == sorted(packed.select(*kept).collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_awkward_rows_pass_every_stage(spark):
    docs = documents(spark, AWKWARD)
    kept = [len(AWKWARD), 8, 8, 8]
    for (name, stage), count in zip(corpus_pipeline.STAGES[:4], kept, strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.count() == count, name
    # Of the four rows with equal sets the first stays; the wordless ones all stay.
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_no_documents(spark):
    docs = documents(spark, AWKWARD).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.count() == 0, name
