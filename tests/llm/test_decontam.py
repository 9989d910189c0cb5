import random

from colonnade.llm import decontam
from tests.llm.frames import AWKWARD, clashing, documents

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly watch from the old stone bridge at dawn."


def edits(pattern, text):
    """The fewest edits between pattern and any stretch of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        after = [i]
        for j, d in enumerate(text, 1):
            after.append(min(row[j] + 1, after[j - 1] + 1, row[j - 1] + (c != d)))
        row = after
    return min(row)


def test_myers_and_matcher_equal_brute_force():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    for _ in range(150):
        pattern = decontam.plain(" ".join(word() for _ in range(20)))
        noisy = list(pattern)
        for _ in range(rng.randint(0, 2 + len(pattern) // 8)):
            at = rng.randrange(len(noisy))
            noisy[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", " "])
        text = decontam.plain(" ".join([word(), word(), "".join(noisy), word()]))
        want = edits(pattern, text)
        assert decontam.myers(pattern, text)[0] == want
        found = decontam.Matcher([(1, pattern)], passage_chars=10_000, min_chars=0).matches(text)
        assert (1 in found) == (want <= len(pattern) // 10)
        if found:
            assert found[1][0] == want


def test_windows_equal_brute_force():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    hits = 0
    for k in range(120):
        item = decontam.plain(" ".join(word() for _ in range(rng.randint(30, 70))))
        noisy = list(item[rng.randrange(20) : len(item) - rng.randrange(20)])
        # Edits here and there, or all in one half.
        spread = len(noisy) if k % 2 else len(noisy) // 2
        for _ in range(rng.randint(0, len(noisy) // 4)):
            at = rng.randrange(min(spread, len(noisy)))
            noisy[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", " "])
        text = decontam.plain(" ".join([word(), word(), "".join(noisy), word()]))
        counted = [(edits(p, f" {text} "), len(p) // 10) for p in decontam.passages(item)]
        least = min((e for e, budget in counted if e <= budget), default=None)
        found = decontam.Matcher([(1, item)]).matches(text)
        assert (found[1][0] if found else None) == least
        hits += bool(found)
    assert 20 < hits < 115


def test_the_registered_query_equals_brute_force_with_edits(spark, tmp_path):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([6, 9, 12, 30, 45, 60, 80])]
    docs = []
    for doc_id in range(60):
        quote = list(rng.choice(items)[1])
        begin = rng.randrange(1 + len(quote) // 3)
        quote = quote[begin:]
        for _ in range(rng.choice([0, 0, 1, 3, 9, 20])):
            at = rng.randrange(len(quote))
            quote[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "Y", "-"])
        docs.append((doc_id, f"{word()} {''.join(quote)}. {word()}" if rng.random() < 0.9 else None))
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for item_id, item in items:
        item = decontam.plain(item)
        for doc_id, text in docs:
            text = decontam.plain(text or "")
            if len(item) < decontam.MIN_CHARS:
                if len(item) >= decontam.MIN_EXACT_CHARS and f" {item} " in f" {text} ":
                    want.add((doc_id, item_id, 0))
                continue
            near = [e for p in decontam.passages(item) if (e := edits(p, f" {text} ")) <= len(p) // 10]
            if near:
                want.add((doc_id, item_id, min(near)))
    from colonnade.llm import queries

    assert {(r.doc_id, r.item_id, r.edits) for r in queries.op1_decontaminate(spark, str(tmp_path)).collect()} == want
    assert len({i for _, i, _ in want}) >= 5 and any(e > 0 for *_, e in want)


def test_finds_copies_edits_and_quotes(spark):
    noisy = ITEM.replace("quick", "quikc").replace("lazy", "laszy").upper()
    rows = [(10, f"Before. {ITEM} After."), (11, f"x {noisy} y"), (12, "nothing of the kind here"), (13, ITEM[:50])]
    docs = documents(spark, rows + AWKWARD)
    bench = spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "short"), (None, ITEM), (4, ITEM)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontam.find(clashing(docs), clashing(bench)).collect()}
    assert set(found) == {(10, 0), (10, 4), (11, 0), (11, 4)}
    assert found[10, 0] == 0 and 0 < found[11, 0] <= 6
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {10, 11}


def test_quotes_across_the_cuts_are_found():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    for size in (150, 170, 199, 200, 260, 299, 450):
        item = decontam.plain(" ".join(word() for _ in range(size))[:size])
        matcher = decontam.Matcher([(1, item)])
        for quote in [item[a : a + 110] for a in range(len(item) - 109)]:
            assert 1 in matcher.matches(decontam.plain(f"{word()} {quote} {word()}")), (size, quote)


def test_many_passes_give_the_same(spark):
    docs = documents(spark, [(1, ITEM), (2, ITEM[::-1])])
    bench = spark.createDataFrame([(0, ITEM), (1, ITEM[::-1]), (2, "q" * 60)], "item_id long, text string")
    one = sorted(decontam.find(docs, bench).collect())
    assert sorted(decontam.find(docs, bench, items_per_pass=1).collect()) == one and len(one) == 2


def test_empty_tables(spark):
    docs, bench = documents(spark, [(1, ITEM)]), spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert decontam.find(docs.limit(0), bench).count() == 0
    assert decontam.find(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == 1


def test_the_registered_query_equals_exact_search(spark):
    from colonnade.llm import queries

    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, folder).where("edits = 0").collect()}
    docs = {r.doc_id: decontam.plain(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: decontam.plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    assert all(len(t) >= decontam.MIN_CHARS for t in items.values())
    passages = {(i, p) for i, t in items.items() for p in decontam.passages(t)}
    assert got == {(d, i) for d, t in docs.items() for i, p in passages if p in f" {t} "}
