"""The mix by time-varying weights against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colonnade.llm import curriculum, queries
from tests.llm.frames import AWKWARD, DOCUMENTS, clashing, documents


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def key(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    return hashlib.md5(f"{'null' if doc_id is None else doc_id}:{inner}".encode()).hexdigest()


def shares(sizes, weights, total, most):
    """Targets by filling again and again until no source is above its bound."""
    full, target = set(), dict.fromkeys(sizes, 0.0)
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        weight = sum(w for s, w in weights.items() if s not in full)
        for s in sizes:
            target[s] = most * sizes[s] if s in full else (weights[s] * rest / weight if weight else 0.0)
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def integral(knots, until):
    """By many thin slices."""
    n, found = 20_000, 0.0
    for i in range(n):
        t = (i + 0.5) / n * until
        for (a, wa), (z, wz) in zip(knots, knots[1:]):
            if a <= t <= z:
                found += (wa + (wz - wa) * (t - a) / (z - a)) * until / n
                break
    return found


ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "en", ["a", "b", None, "b", "b"][i % 5], 0) for i in range(300)]
KNOTS = {"a": [(0.0, 1.0), (0.3, 4.0), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 3.0)], None: [(0.0, 0.2), (0.5, 0.2), (1.0, 0.9)]}


@pytest.fixture(scope="module")
def assigned(spark):
    docs = spark.createDataFrame(ROWS, DOCUMENTS)
    schedules = spark.createDataFrame(list(KNOTS.items()), "source string, knots array<struct<at:double,weight:double>>")
    return curriculum.assign(curriculum.sized(docs), schedules)


def test_targets_copies_and_positions(assigned):
    sizes, streams = defaultdict(int), defaultdict(list)
    for doc_id, text, _, source, _ in ROWS:
        sizes[source] += n_words(text)
        streams[source].append((key(doc_id, text), doc_id, n_words(text)))
    weights = {s: integral(k, 1.0) for s, k in KNOTS.items()}
    want = shares(dict(sizes), weights, sum(sizes.values()), 3)
    rows = {r.doc_id: r for r in assigned.collect()}
    assert len(rows) == len(ROWS)
    for source, stream in streams.items():
        taken = 0
        left = [want[source]]
        for epoch in range(3):
            at = epoch * sizes[source]
            for _, doc_id, size in sorted(stream):
                row = rows[doc_id]
                assert row.size == size and row.source_size == sizes[source]
                assert row.target == pytest.approx(want[source], rel=1e-6)
                words = max(0, min(size, int(left[0] + 1e-6) - at))
                copy = [c for c in row.copies if c.epoch == epoch]
                assert [c.words for c in copy] == ([words] if words else [])
                if words and doc_id % 25 == 0:
                    # What the schedule asks for until then is what lies before the copy.
                    due = integral(KNOTS[source], copy[0].position) / weights[source] * want[source]
                    assert due == pytest.approx(at, abs=0.01 * want[source])
                taken += words
                at += size
        assert abs(taken - want[source]) <= 1


def test_training_order_is_sorted_and_holds_every_copy(assigned):
    ordered = curriculum.training_order(assigned).collect()
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    assert sum(r.words for r in ordered) == sum(c.words for r in assigned.collect() for c in r.copies)
    assert all(0 <= r.position <= 1 for r in ordered)
    # The rising source comes late, the falling one early.
    place = {s: [n for n, r in enumerate(ordered) if r.source == s] for s in ("a", "b")}
    assert sum(place["a"]) / len(place["a"]) < sum(place["b"]) / len(place["b"])


def test_buckets_change_nothing(assigned, monkeypatch, spark):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 7)
    docs = spark.createDataFrame(ROWS, DOCUMENTS).repartition(5)
    schedules = spark.createDataFrame(list(KNOTS.items()), "source string, knots array<struct<at:double,weight:double>>")
    again = curriculum.assign(curriculum.sized(docs), schedules)
    assert sorted(map(str, again.collect())) == sorted(map(str, assigned.collect()))


@pytest.mark.parametrize("total, sizes, weights, most", [
    (100, {"a": 10, "b": 10, "c": 80}, {"a": 5.0, "b": 1.0, "c": 1.0}, 3), (10, {"a": 10, "b": 90}, {"a": 1.0, "b": 1.0}, 3),
    (1000, {"a": 10, "b": 90}, {"a": 1.0, "b": 1.0}, 3), (100, {"a": 100, "b": 0}, {"a": 0.0, "b": 1.0}, 3), (50, {"a": 10, "b": 40}, {"a": 0.0, "b": 2.0}, 2),
])
def test_bounded_shares(spark, total, sizes, weights, most):
    rows = [(s, sizes[s], weights[s]) for s in sizes]
    got = {r["__of"]: r.target for r in curriculum.targets(spark.createDataFrame(rows, "__of string, source_size long, weight double"), total, most).collect()}
    able = min(total, sum(most * sizes[s] for s in sizes if weights[s]))
    positive = {s: sizes[s] for s in sizes if weights[s]}
    want = shares(positive, {s: weights[s] for s in positive}, able, most)
    assert got == {s: pytest.approx(want.get(s, 0.0)) for s in sizes}


def test_awkward_rows_and_clashing_names(spark, tmp_path):
    docs = clashing(documents(spark, AWKWARD)).withColumns({name: F.lit("mine") for name in ("size", "copies", "target", "weight", "bucket", "position", "words", "epoch")})
    assigned = curriculum.assign(curriculum.sized(docs), curriculum.ranked_schedules(docs, (1, 2, 3)))
    rows = assigned.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in AWKWARD)
    for r in rows:
        assert r["size"] == n_words(r.text) and sum(c.words for c in r.copies) <= 3 * r["size"] and (r.copies or not r["size"] or r.target < r.source_size)
    assert curriculum.training_order(assigned).count() == sum(len(r.copies) for r in rows)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    assert queries.op11_curriculum(spark, path).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = queries.op11_curriculum(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ExistingRDD" not in plan
