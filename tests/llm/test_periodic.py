"""Periodic runs against plain searches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import periodic, queries
from tests.llm.frames import AWKWARD, DOCUMENTS, clashing, documents


def slow_runs(words, least):
    """Every period in turn, smallest first."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        begin = 0
        for t in range(n - q + 1):
            if t == n - q or words[t] != words[t + q]:
                if t - begin >= q and t - begin + q >= least:
                    found.setdefault((begin, t - begin + q), q)
                begin = t + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def by_start(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def fast(codes, least):
    return list(zip(*(a.tolist() for a in periodic.runs(np.array(codes, dtype=np.int64), least)), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 12))
def test_runs_of_random_sequences(codes, least):
    assert fast(codes, least) == by_start(slow_runs(codes, least))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=9), st.integers(1, 5)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    codes = [c for block, times in blocks for c in block * times]
    assert fast(codes, 2) == by_start(slow_runs(codes, 2))


def test_all_short_binary_sequences():
    for n in range(1, 15):
        for bits in range(1 << n):
            codes = [bits >> i & 1 for i in range(n)]
            assert fast(codes, 2) == by_start(slow_runs(codes, 2))


def test_fibonacci_and_long_sequences():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert fast(b[:600], 12) == by_start(slow_runs(b[:600], 12))
    assert fast([7] * 5000, 12) == [(0, 5000, 1)]
    rng = random.Random(3)
    block = [rng.randrange(50) for _ in range(700)]
    codes = [rng.randrange(50) for _ in range(300)] + block * 3 + block[:100] + [99]
    assert (300, 2200, 700) in fast(codes, 12) and fast(codes, 12) == by_start(slow_runs(codes, 12))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = by_start(slow_runs(words, 12))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def write(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") * (1 + (rng.random() < 0.2)) for _ in range(rng.randrange(120)))) for i in range(250)]
    # The slow search takes the square of the words.
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD) if len(t or "") < 60_000] + [(None, "a b " * 9), (1000, "x\x1cy " * 7 + "  z")]
    folder = write(spark, tmp_path, rows)
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic(spark, folder).collect()]
    assert sum(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    assert sorted(map(str, got)) == sorted(str(expected(i, t)) for i, t in rows)


def test_operator_on_awkward_rows(spark):
    rows = {(r.doc_id, r.collapsed) for r in periodic.find(clashing(documents(spark, AWKWARD))).collect()}
    assert (8, "long words") in rows and (1, "") in rows and (2, "") in rows and (3, "") in rows and (4, "one") in rows
    assert (None, "one two three four five six seven") in rows
    assert periodic.find(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_groups_change_nothing(spark, monkeypatch):
    texts = ["a b c " * n for n in range(30)] + [None, ""]
    whole = periodic._search(texts, 12)
    parts = [periodic._search(texts[a:b], 12) for a, b in [(0, 1), (1, 20), (20, 32)]]
    assert whole[3] == [t for p in parts for t in p[3]] and whole[1] == [n for p in parts for n in p[1]]
    monkeypatch.setattr(periodic, "GROUP_CHARS", 100)
    assert [k for a, b in periodic._groups(texts) for k in range(a, b)] == list(range(32))


def test_a_megabyte_of_one_word():
    (n,), (found,), (start, length, period), (text,) = periodic._search(["ab " * 350_000], 12)
    assert (n, found, start[0], length[0], period[0], text) == (350_000, 1, 0, 350_000, 1, "ab")
