import random
import re
from collections import Counter, defaultdict

import pytest

from colonnade.llm import jaccard
from colonnade.llm.components import components
from colonnade.llm.shingles import shingle_sets
from tests.llm.frames import AWKWARD, clashing, documents


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """(size, component) of every id: all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j, shared in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}


def test_shingle_sets_equal_brute_force(monkeypatch):
    from colonnade.llm import shingles as module

    texts = [t or "" for _, t in AWKWARD] + ["a b c d", "A b\x0bc D e", "a b c d e f", "\n a\tb re "]
    for block in (2_000_000, 37):
        monkeypatch.setattr(module, "_BLOCK", block)
        found, bounds = shingle_sets(texts)
        sets = [set(found[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
        for x, s in zip(texts, sets, strict=True):
            for y, t in zip(texts, sets, strict=True):
                assert len(s & t) == len(shingles(x) & shingles(y))


def test_equals_brute_force_on_noisy_groups(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(40)]
    texts = {}
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 90]))]
        if group % 3 == 0:
            base += common
        for _ in range(rng.randint(1, 25)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[len(texts)] = " ".join(own[: rng.randint(max(1, len(own) - 8), len(own))])
    assert result(documents(spark, list(texts.items()))) == brute(texts)


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_equals_brute_force_on_the_tables(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    assert result(docs) == brute({r.doc_id: r.text for r in docs.collect()})


def test_threshold_is_met_exactly(spark):
    base = [f"a{i}" for i in range(32)]  # 28 shingles; three fourths of the union is met at 24 of 32
    near, far = [*base[:28], *[f"b{i}" for i in range(4)]], [*base[:27], *[f"c{i}" for i in range(5)]]
    got = result(documents(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]))
    assert got == {1: (28, 1), 2: (28, 1), 3: (28, 3)}


def test_awkward_rows(spark):
    rows = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(clashing(documents(spark, AWKWARD))).collect())
    assert rows == sorted(
        [
            ("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 3, 5), ("6", 3, 5), ("6", 3, 5), ("None", 3, 5),
            ("7", 1, 7), ("8", 2, 8), ("9", len(shingles(AWKWARD[-1][1])), 9),
        ]
    )
    assert jaccard.near_duplicates(documents(spark, AWKWARD).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (301, 300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
