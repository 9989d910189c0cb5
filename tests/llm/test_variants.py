"""Spelling variants against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import queries, variants
from tests.llm.frames import AWKWARD, DOCUMENTS, clashing, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_group(counts, ratio=10):
    form, rows = {}, []
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return rows


def slow_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def result(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def some_words(rng, n, letters="abÿ"):
    made = Counter()
    for _ in range(n):
        made["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))] += rng.choice([1, 1, 2, 30, 400, 5000])
    return made


@pytest.mark.parametrize("pass_blocks", [1_000, 7])
def test_groups_equal_all_pairs(spark, monkeypatch, pass_blocks):
    monkeypatch.setattr(variants, "PASS_BLOCKS", pass_blocks)
    counts = some_words(random.Random(pass_blocks), 150)
    if pass_blocks == 7:
        assert variants.Layout(Counter(map(len, counts))).total > 14
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert result(variants.group(vocab)) == sorted(map(str, slow_group(counts)))


def test_long_chains_of_forms(spark):
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    counts = {w: 2 * 10**k for k, w in enumerate(words)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r.word: r for r in variants.group(vocab).collect()}
    assert {r.root for r in rows.values()} == {"abbbbbb"} and rows["aaaaaaa"].form == "aaaaaab"
    with pytest.raises(ValueError):
        variants.group(vocab, ratio=1)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    stems = ["Ordinary", "ordinarÿ", "letters", "letterz", "Éclairage", "éclairage", "straße", "strassen", "multiply×by", "in-between", "sevenal"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", ",", " x"]) for _ in range(40))) for i in range(120)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)] + [(None, "Ordinary words " * 40), (1000, "words ordinary " * 3)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = slow_counts(rows)
    assert len(counts) > 40
    assert result(queries.op13_variants(spark, str(tmp_path))) == sorted(map(str, slow_group(counts)))


def test_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_variants(spark, str(tmp_path)).collect() == []
    docs = clashing(documents(spark, [(1, "Repeated repeated"), (2, None), (2, "")]))
    assert [tuple(r) for r in variants.vocabulary(variants.words(docs)).collect()] == [("repeated", 2)]


@settings(max_examples=100, deadline=None)
@given(st.text("abcé\U0001f600", min_size=2, max_size=8))
def test_hashes_of_edits_are_those_of_the_edited_words(word):
    import pandas as pd

    alphabet = np.array(sorted(map(ord, "abcé\U0001f600")), dtype=np.uint64)

    def whole(w):
        ((_, _, codes),) = variants.by_length(pd.DataFrame({"word": [w]}))
        return int(variants._sums(codes)[0, -1])

    ((length, _, codes),) = variants.by_length(pd.DataFrame({"word": [word]}))
    seen = set()
    for wide, rows, at, new, hashes in variants._edits(codes, alphabet):
        for k in range(len(rows)):
            edited = word[:at] + ("" if new is None else chr(new[k])) + word[at + 1 :]
            assert len(edited) == wide and near(word, edited)
            assert int(hashes[k]) == whole(edited) and edited not in seen
            seen.add(edited)
    lower = {word[:i] + chr(c) + word[i + 1 :] for i in range(len(word)) for c in alphabet.tolist() if c > ord(word[i])}
    assert seen == lower | {word[:i] + word[i + 1 :] for i in range(len(word))}
