import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import queries, toxicity
from tests.llm.frames import AWKWARD, clashing, documents

BAD = ["grumbolt", "snivelard", "wretchlin"]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    words = [a + b for a in ("lo", "ma", "ti", "ran", "sel", "vor", "pen") for b in ("den", "ta", "rim", "so", "gal", "ner")] + ["the", "of", "and"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    return docs, known, toxicity.fit(docs, known)


def best_by_listing(token, letters):
    """The most likely reading among all paths of the lattice."""
    paths = [("", 0.0)]
    for options in toxicity.lattice(token):
        paths = [(done + text, cost + more) for done, cost in paths for text, more in options]

    def value(path):
        text, cost = path
        codes = [0, 0, *map(toxicity._code, text)]
        total = cost + sum(letters[a][b][c] + (toxicity._PER_LETTER if c else 0) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
        return total + letters[codes[-2]][codes[-1]][0]

    return " ".join(max(paths, key=value)[0].split())


def test_viterbi_equals_listing_all_paths(trained):
    letters = trained[2].letters
    for token in ("gr0mb1t", "sn!vel@rd", "r4nnn", "t.i.d.e.n", "m*t4", "vvvor5o", "a1b2"):
        assert toxicity.decode(token, letters) == best_by_listing(token, letters)


@pytest.mark.parametrize("text", ["gr*mb0lt", "grrrumbolt", "g r u m b o l t", "g.r.u.m.b.o.l.t", "$nivelard", "wr3tchl1n!!", "WRETCHLIN"])
def test_disguises_are_seen_through(trained, text):
    model = trained[2]
    assert any(word in toxicity.restore(text, model.letters) for word in BAD)
    assert model.reader().scores([f"the of loden {text} and marim"])[0] >= toxicity.CUT


def test_clean_and_plain_texts(trained):
    scores = trained[2].reader().scores(["the loden of marim and tita 2.0 in 1999", "", "1234 5678", "!!! *** ???"])
    assert (scores < 0.5).all()
    assert toxicity.restore("the loden, of 12.5!", trained[2].letters) == "the loden, of 12.5!"


def test_held_out_rows(trained):
    docs, known, model = trained
    held = toxicity.score(docs, model).where(~toxicity.training_fold(F.col("doc_id"))).join(known, "doc_id").toPandas()
    assert (held["predicted"] == held["toxic"]).mean() > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, trained):
    docs, known, model = trained
    turned = known.withColumn("toxic", F.when(toxicity.training_fold(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    other = toxicity.fit(docs, turned)
    assert other.odds == model.odds and np.array_equal(other.weights, model.weights)


def test_awkward_rows(spark, trained):
    docs = documents(spark, AWKWARD)
    rows = toxicity.score(clashing(docs), trained[2]).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    empty = docs.limit(0)
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(docs, model).collect())


def test_the_query_is_accurate_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in queries.op6_toxicity(spark, folder).where("held_out").collect() if r.doc_id in labels]
    assert sum(p > t for t, p in rows) <= 1
    assert sum(t and p for t, p in rows) >= 0.5 * sum(t for t, _ in rows)
