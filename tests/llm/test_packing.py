import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from colonnade.llm import packing, queries
from tests.llm.frames import AWKWARD, clashing, documents


@pytest.fixture(scope="module")
def model():
    with open(queries.model_file(), encoding="utf-8") as file:
        return file.read()


def test_words_put_together_are_the_tokenizers_ids(model):
    from tokenizers import Tokenizer

    whole, parts = Tokenizer.from_str(model), packing.Encoder(model)
    texts = [t or "" for _, t in AWKWARD] + [
        "  a  b ", " \n x\n\ny  ", "a\tb c", "it's  5 's don't, x!", "a \n b", "é è\n\n\nß 12, 34.", "wow... so?! \"yes\"", "x.\nY z", "<|endoftext|> a",
    ]
    for _ in range(2):
        for text, got in zip(texts, parts.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_by_rank_are_the_tokenizers(model):
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_str(model), random.Random(4)
    assert packing.by_rank(model) is not None
    encoder = packing.Encoder(model, cached_words=40)
    letters = "aeinrst'.,-!?0127ABÄéßřǅ%$_#/\\~|" + "ж漢😀<"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(4000)] + ["<|endoftext|>", "don't", "we'll'd"]
    for before in ("", " "):
        texts = [before + w for w in words]
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder._encode(texts)]
        assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    # So are whole texts; small generations of words give the same, too.
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \r\n", "\u00a0", "\u2003", "\x85"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(30)) for _ in range(200)]
    plain = [w for w in words if packing._SAFE.fullmatch(w)]
    texts += ["".join(rng.choice(plain) + rng.choice(gaps[:9]) for _ in range(30)) for _ in range(200)]
    texts += ["".join(map(chr, range(0xA0, 0x2B0))), " ".join(map(chr, range(0x2010, 0x205F))), "α΢Ω жЯ €5 ™", "<|endoftext|> x", "a <|endoftext|>"]
    assert 150 < sum(encoder._ranked(t) is not None for t in texts) < len(texts)
    got = [np.frombuffer(b, "<u4").tolist() for at in range(0, len(texts), 10) for b in encoder.encode(texts[at : at + 10])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def check(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packs_every_id_once(spark, model):
    from tokenizers import Tokenizer

    docs = documents(spark, AWKWARD)
    rows = packing.pack_documents(clashing(docs), queries.model_file()).collect()
    sequences = check(rows, 1024)
    assert sequences <= -(-sum(r.length for r in rows) // 1024) + 1
    whole = Tokenizer.from_str(model)
    want = []
    for doc_id, text in AWKWARD:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(str(doc_id), k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_local_search_empties_bins():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.choice([20, 100])
        sizes = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 80))]
        # One piece a bin: everything is left to the search.
        bins = packing.local_search([[i] for i in range(len(sizes))], sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) <= 1.15 * -(-sum(sizes) // capacity) + 2
    sizes = [6, 4, 5, 3, 2]  # 10 = 6 + 4 = 5 + 3 + 2; the search has to exchange 5 for 4
    assert len(packing.local_search([[0, 4], [1, 2], [3]], sizes, 10)) == 2


def test_shards_and_rounds(spark):
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(3000)], "uid long, length long")
    rows = packing.pack(pieces, 100, shard_pieces=300).collect()
    assert len(rows) == 3000
    whole = packing.best_fit([r.length for r in rows], 100)
    assert check(rows, 100) <= 1.01 * len(whole)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, [(1, "a")]).limit(0), queries.model_file()).count() == 0
