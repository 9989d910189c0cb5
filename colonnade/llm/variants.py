"""Spelling variants: words one edit apart, led to the far more frequent ones.

The vocabulary is a table of distinct words and counts. Its words are put into blocked Bloom
filters, a stretch of blocks per word length, each block one 64-bit number, and broadcast. Every
word is probed against them with its edits: all deletions of one code point and all
replacements of one by a greater code point of the alphabet; insertions and the other replacements are the
same pairs seen from the other word. Hashes of edits come from the word's prefix sums, so no
edited word is built unless its filter says it may exist. Only those travel to an exact join with the vocabulary,
which drops what the filters let pass by mistake.

Filters that would together be larger than ``PASS_BLOCKS`` are broadcast one stretch after
another, and in each pass only the edits whose block lies in it are probed. So what is
broadcast is bounded, and the probes of all passes are those of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.shared import written
from colonnade.llm.shingles import mixed, powers

#: Code points of a word at least, and its occurrences at least.
MIN_LENGTH = 7
MIN_COUNT = 2
#: How much more frequent the form of a word has to be.
RATIO = 10
#: Words of a filter block of 64 bits, on average.
BLOCK_WORDS = 4
#: Blocks that are broadcast at once: 32 MB.
PASS_BLOCKS = 4_000_000
#: Edits that are probed in one go.
_CHUNK = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, word)``: every maximal run of letters (A to Z, a to z, U+00C0 to U+00FF) of ``min_length`` or more.

    A to Z are lower-cased, nothing else is. A null text has none.
    """
    letters = f"[a-zÀ-ÿ]{{{min_length},}}"
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(letters), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word"))


def vocabulary(occurrences: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough; null words do not count."""
    long_enough = occurrences.where(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class Layout:
    """Where the blocks of each word length lie: one row per length on the driver."""

    def __init__(self, counts: dict[int, int]):
        self.blocks = {length: max(1, -(-n // BLOCK_WORDS)) for length, n in sorted(counts.items())}
        ends = np.cumsum(list(self.blocks.values()), dtype=np.int64)
        self.first = dict(zip(self.blocks, (ends - list(self.blocks.values())).tolist(), strict=True))
        self.total = int(ends[-1]) if len(ends) else 0

    def place(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The block and the bits of words of one length."""
        key = mixed(hashes)
        block = ((key >> np.uint64(32)) * np.uint64(self.blocks[length])) >> np.uint64(32)
        bits = np.zeros(len(key), dtype=np.uint64)
        for k in (0, 6, 12, 18):
            bits |= np.uint64(1) << ((key >> np.uint64(k)) & np.uint64(63))
        return block.astype(np.int64) + self.first[length], bits

    def meets(self, length: int, begin: int, end: int) -> bool:
        """Whether blocks from ``begin`` up to ``end`` hold any of a length."""
        first = self.first.get(length)
        return first is not None and first < end and first + self.blocks[length] > begin


def by_length(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each word length, and their code points as a matrix."""
    lengths = batch["word"].str.len().to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(batch["word"].iloc[rows]).encode("utf-32-le"), dtype="<u4")
        yield int(length), rows, codes.reshape(len(rows), length).astype(np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """The hashes of all prefixes of each word; the last is that of the word."""
    power, _ = powers(codes.shape[1])
    found = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum(codes * power[: codes.shape[1]], axis=1, out=found[:, 1:])
    return found


def _filters(vocab: DataFrame, layout: Layout, begin: int, end: int) -> np.ndarray:
    """The blocks from ``begin`` up to ``end``; at most ``PASS_BLOCKS`` numbers come to the driver."""

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, _, codes in by_length(batch):
                if layout.meets(length, begin, end):
                    block, bits = layout.place(_sums(codes)[:, -1], length)
                    inside = (block >= begin) & (block < end)
                    yield pd.DataFrame({"block": block[inside] - begin, "bits": bits[inside].view(np.int64)})

    rows = vocab.select("word").mapInPandas(place, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    filters = np.zeros(end - begin, dtype=np.uint64)
    filters[rows["block"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return filters


def _edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray | None, np.ndarray]]:
    """(length, rows, position, new code points or None for a deletion, hashes) of all edits that are probed."""
    length = codes.shape[1]
    power, inverse = powers(length + 1)
    sums = _sums(codes)
    for at in range(length):
        # Deleting any of equal neighbours gives the same word.
        rows = np.arange(len(codes)) if at == 0 else np.flatnonzero(codes[:, at] != codes[:, at - 1])
        yield length - 1, rows, at, None, sums[rows, at] + (sums[rows, -1] - sums[rows, at + 1]) * inverse[1]
        greater = alphabet[None, :] > codes[:, at, None]
        rows, symbol = np.nonzero(greater)
        new = alphabet[symbol]
        yield length, rows, at, new, sums[rows, -1] + (new - codes[rows, at]) * power[at]


def probe(vocab: DataFrame, layout: Layout, alphabet: np.ndarray, filters, begin: int, end: int) -> DataFrame:
    """``(word, n, other)``: the edits that may be words, by the broadcast ``filters`` of the blocks from ``begin`` up to ``end``."""

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = filters.value
        for batch in batches:
            for length, own, codes in by_length(batch):
                if not (layout.meets(length, begin, end) or layout.meets(length - 1, begin, end)):
                    continue
                step = max(1, _CHUNK // max(1, len(alphabet)))
                for cut in range(0, len(own), step):
                    rows_of, found = own[cut : cut + step], []
                    part = batch["word"].iloc[rows_of].tolist()
                    for wide, rows, at, new, hashes in _edits(codes[cut : cut + step], alphabet):
                        if not layout.meets(wide, begin, end):
                            continue
                        block, bits = layout.place(hashes, wide)
                        block -= begin
                        if begin > 0 or end < layout.total:
                            here = np.flatnonzero((block >= 0) & (block < end - begin))
                            rows, block, bits = rows[here], block[here], bits[here]
                            new = None if new is None else new[here]
                        hit = np.flatnonzero((blocks[block] & bits) == bits)
                        letters = [""] * len(hit) if new is None else map(chr, new[hit].tolist())
                        found += [(r, part[r][:at] + c + part[r][at + 1 :]) for r, c in zip(rows[hit].tolist(), letters, strict=True)]
                    if found:
                        which = rows_of[[r for r, _ in found]]
                        yield pd.DataFrame({"word": batch["word"].to_numpy()[which], "n": batch["n"].to_numpy()[which], "other": [w for _, w in found]})

    return vocab.select("word", "n").mapInPandas(search, "word string, n long, other string")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: every two words of ``vocab`` that differ by one code point inserted, deleted or replaced, once.

    ``vocab`` holds distinct words (not null, not empty) and their counts. An empty one has no pairs.
    """
    spark = vocab.sparkSession
    counts = {row[0]: row[1] for row in vocab.groupBy(F.length("word")).count().collect()}
    layout = Layout(counts)
    symbols = vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(row["c"]) for row in symbols.collect()), dtype=np.uint64)
    parts = []
    for begin in range(0, layout.total, PASS_BLOCKS):
        end = min(begin + PASS_BLOCKS, layout.total)
        sent = spark.sparkContext.broadcast(_filters(vocab, layout, begin, end))
        parts.append(probe(vocab, layout, alphabet, sent, begin, end))
    known = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    if not parts:
        return vocab.select("word", "n").join(known, F.lit(False))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found.join(known, "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``(word, root)`` of a table ``(word, form)`` without cycles and chains of at most ``2 ** rounds`` steps.

    Each round doubles the steps that all words have gone.
    """
    gone = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(rounds):
        ahead = gone.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        further = gone.join(ahead, gone["root"] == ahead["__at"], "left")
        gone = written(further.select("word", F.coalesce("__next", "root").alias("root")), "variant-roots")
    return gone


def group(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each row of ``vocab`` (distinct words and counts).

    ``form`` is the near word with the greatest count, the first in code-point order of
    several, if its count is at least ``ratio`` times the word's own; else null, with
    ``form_n``. ``root`` is where following forms ends. ``vocab`` is read several times, so it should be a written table.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in circles")
    best = F.when(F.col("other_n") >= F.col("n") * ratio, F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    sides = [F.struct(*[F.col(c).alias(a) for c, a in zip(names, ("word", "n", "other", "other_n"), strict=True)])
             for names in (("word", "n", "other", "other_n"), ("other", "other_n", "word", "n"))]
    near = near_pairs(vocab).select(F.inline(F.array(*sides)))
    around = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    forms = vocab.select("word", "n").join(around, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"),
    )
    found = written(forms, "variant-forms")
    span = found.agg(F.max("n"), F.min("n")).first()
    # Every step multiplies the count by the ratio, so chains are short.
    steps = int(math.log(span[0] / span[1], ratio)) + 1 if span[0] else 1
    rounds = max(0, math.ceil(math.log2(max(steps, 1))))
    ends = roots(found.where("form is not null"), rounds)
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
