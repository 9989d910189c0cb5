"""Packing of tokenised documents into sequences of fixed length.

Documents become pieces of at most the sequence length; pieces are packed by swap-based
local search. A shard of pieces starts from best fit by falling length. Then the least
filled bin is emptied step by step: a piece moves into another bin's gap, one or two of
its pieces are exchanged for a smaller one of a fuller bin, always so that the sum of squared fills
grows, until the bin is empty or no exchange is left. The bins that stay underfull in all
shards meet in larger rounds of the same search, which start from those bins, so that a
round never needs more sequences than the one before.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colonnade.llm.shared import remembers, small_batches, working_on, written

#: Tokens of one sequence.
CAPACITY = 1024
#: The id that ends every document.
END_ID = 2
#: Words whose ids a worker remembers, in two generations; the older one is dropped when the newer is half of this.
CACHED_WORDS = 500_000
#: Pieces that one task packs together.
SHARD_PIECES = 8_000
#: Rounds over the bins that are left underfull.
ROUNDS = 3
#: Share of the capacity from which a bin is not packed anew in a later round.
WELL_FILLED = 0.98
#: Bins that a pass of the search tries to empty, and passes without success after which it ends.
_EMPTIEST, _PASSES = 64, 20

PIECES = "doc_id long, piece int, start long, length long, ids binary"

_ODD_SPACE = re.compile(r"[^\S \n]")
_MARKS = ",.;:!?"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


# Fixed value: the parts that byte-level tokenizers cut a text into.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters on which all versions of Unicode's tables agree whether they are letters, digits or white space.
_SAFE = re.compile(r"[\t\n\r -~\u00A0-\u02AF\u0391-\u03A1\u03A3-\u03C9\u0410-\u044F\u2010-\u2027\u2030-\u205E\u20AC\u2122]*")


def by_rank(model: str):
    """The same tokenizer in a form that is fast for single words, or None where it cannot be had.

    A byte-level tokenizer whose merges come in the order of their results' ids merges by those ids.
    """
    import tiktoken

    spec = json.loads(model)
    bpe = spec["model"]
    level = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and bpe.get("type") == "BPE" and not bpe.get("dropout")
    if not plain or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or level.get("use_regex") is False or sys.byteorder != "little":
        return None
    # The printable stand-ins of bytes in such files: printable ones are themselves, the others follow from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in bpe["merges"]]
    made = [bpe["vocab"].get(a + b, -1) for a, b in merges]
    ranks = {bytes(byte_of[c] for c in token): n for token, n in bpe["vocab"].items() if all(c in byte_of for c in token)}
    singles = [ranks.get(bytes([b]), -1) for b in range(256)]
    known = set(singles) | set(made)
    if min(singles + made) < 0 or made != sorted(set(made)) or (made and max(singles) > made[0]):
        return None
    return tiktoken.Encoding("words", pat_str=_PARTS, mergeable_ranks={t: n for t, n in ranks.items() if n in known}, special_tokens={})


class Encoder:
    """Ids of whole texts, as little-endian 32-bit numbers, with a memory of words.

    The tokenizer's pattern always begins a new part at a single space, and at a single
    line break and after it, between characters that are no white space; so the ids of a
    text are those of its words (each with the space before it) put together. Texts with
    any other white space are cut only at such single spaces. That serves texts with characters
    on which tables of letters may differ; all others are encoded whole by rank, where the tokenizer allows it.
    """

    def __init__(self, model: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        self.by_rank = by_rank(model)
        self.added = [token["content"] for token in json.loads(model).get("added_tokens") or ()]
        self.cached_words = cached_words
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"": b""}
        # The words of the generation before: those that come again move to the new one.
        self.earlier: dict[str, dict[str, bytes]] = {" ": {}, "": {}}
        self.line_break, *marks = self._encode(["\n", *_MARKS])
        self.marks = dict(zip(_MARKS, marks, strict=True))

    def _ranked(self, text: str) -> bytes | None:
        """The ids of a text by rank, or None where they might not be the tokenizer's."""
        if self.by_rank is None or not _SAFE.fullmatch(text) or any(token in text for token in self.added):
            return None
        return array("I", self.by_rank.encode_ordinary(text)).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of short texts: by rank where that is the same for sure, else by the tokenizer."""
        quick = [self._ranked(t) for t in texts]
        odd = [t for t, ids in zip(texts, quick, strict=True) if ids is None]
        slow = iter([np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(odd, add_special_tokens=False)])
        return [next(slow) if ids is None else ids for ids in quick]

    def _learn(self, cache: dict[str, bytes], words: set[str], before: str) -> None:
        if len(cache) > self.cached_words // 2:
            self.earlier[before] = dict(cache)
            cache.clear()
            if not before:
                cache[""] = b""
        new = words.difference(cache)
        earlier = self.earlier[before]
        if earlier:
            again = new.intersection(earlier)
            cache.update((w, earlier[w]) for w in again)
            new -= again
        # After a letter or digit, a mark at the end is a part of its own.
        marked = [w for w in new if w[-1:] in _MARKS and w[-2:-1].isalnum()]
        new.difference_update(marked)
        new.update({w[:-1] for w in marked}.difference(cache))
        todo = list(new)
        for at in range(0, len(todo), 20_000):
            part = todo[at : at + 20_000]
            cache.update(zip(part, self._encode([before + w for w in part] if before else part), strict=True))
        for w in marked:
            cache[w] = cache[w[:-1]] + self.marks[w[-1]]

    @staticmethod
    def _cut(text: str) -> list[list[str]]:
        """Lines of words; an irregular text is one line."""
        odd = _ODD_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        if odd or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
            return [_BETWEEN.split(text)]
        return [line.split(" ") for line in text.split("\n")]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text: whole by rank where that is sure, else word by word."""
        quick = [self._ranked(t) for t in texts]
        slow = self._by_words([t for t, ids in zip(texts, quick, strict=True) if ids is None])
        for ids in quick:
            yield next(slow) if ids is None else ids

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._cut(t) for t in texts]
        spaced: set[str] = set()
        bare: set[str] = set()
        for lines in cut:
            for words in lines:
                bare.add(words[0])
                spaced.update(words[1:])
        self._learn(self.spaced, spaced, " ")
        self._learn(self.bare, bare, "")
        for lines in cut:
            out = []
            for words in lines:
                out.append(self.bare[words[0]])
                out.extend(map(self.spaced.__getitem__, words[1:]))
                out.append(self.line_break)
            yield b"".join(out[:-1])


@lru_cache(maxsize=1)
def encoder_of(model: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(model)


remembers("packing", encoder_of.cache_clear)


def tokenized(documents: DataFrame, model_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and ids.

    Ids are those of the tokenizer in ``model_file`` plus ``end_id``; ``ids`` holds them
    as little-endian unsigned 32-bit numbers. A document of more than ``capacity`` ids is
    cut so that all pieces but the first are full. A null text is empty: a piece of one
    id. Repeated rows and rows without an id give pieces each; an empty table gives none.
    Other columns are ignored. The tokenizer's file is read on the driver and sent to
    the workers, a few megabytes.
    """
    spark = documents.sparkSession
    small_batches(spark)
    with open(model_file, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("packing")
        encoder = encoder_of(model.value)
        for batch in batches:
            for low in range(0, len(batch), 250):  # few documents at once: the pieces of a batch can be many
                part = batch.iloc[low : low + 250]
                out = []
                for doc_id, ids in zip(part["doc_id"], encoder.encode(list(part["text"])), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(doc_id, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])
                yield frame.astype({"doc_id": "Int64"})

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(encode, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places into ``sizes``: the longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g is set while some bin has gap g
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = open_gaps >> sizes[i]
        if fits:
            gap = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        by_gap[gap - sizes[i]].append(b)
        open_gaps |= 1 << (gap - sizes[i])
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empty as many bins as moves and exchanges can; every step raises the sum of squared fills.

    Each pass tries the least filled bins in turn and ends with the first one emptied. The
    search ends when the sizes show that no bin can be saved, in a local optimum, or after
    ``_PASSES`` passes without a bin emptied.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    full = [bins[b] for b in range(len(bins)) if fill[b] == capacity]
    open_bins = {b: sorted(bins[b], key=lambda i: sizes[i]) for b in range(len(bins)) if fill[b] < capacity and bins[b]}
    least = -(-sum(fill[b] for b in open_bins) // capacity)
    # Bins that hold a piece of a size, and bins with a gap of a size.
    holds: list[set[int]] = [set() for _ in range(capacity + 1)]
    gaps: list[set[int]] = [set() for _ in range(capacity + 1)]
    for b, items in open_bins.items():
        gaps[capacity - fill[b]].add(b)
        for i in items:
            holds[sizes[i]].add(b)
    widest = max((capacity - fill[b] for b in open_bins), default=0)

    def put(b: int, add: list[int], drop: list[int]) -> None:
        gaps[capacity - fill[b]].discard(b)
        items = open_bins[b]
        for i in drop:
            items.remove(i)
        items.extend(add)
        items.sort(key=lambda i: sizes[i])
        fill[b] += sum(sizes[i] for i in add) - sum(sizes[i] for i in drop)
        gaps[capacity - fill[b]].add(b)
        here = {sizes[i] for i in items}
        for i in drop:
            if sizes[i] not in here:
                holds[sizes[i]].discard(b)
        for size in here:
            holds[size].add(b)

    def improve(v: int) -> bool:
        """One step that makes bin ``v`` emptier and another, at least as full, fuller."""
        items = open_bins[v]
        groups = [[i] for i in reversed(items)] + [[i, j] for n, i in enumerate(items[:12]) for j in items[n + 1 : 12]]
        best = None
        for group in groups:
            s = sum(sizes[i] for i in group)
            if len(group) == 1:
                for gap in range(s, widest + 1):
                    other = next((b for b in gaps[gap] if b != v and fill[b] + s > fill[v]), None)
                    if other is not None:
                        put(other, group, [])
                        put(v, [], group)
                        return True
            for gain in range(min(s - 1, widest), 0, -1):
                if best is not None and gain <= best[0]:
                    break
                t = s - gain
                if t > capacity or not holds[t]:
                    continue
                for b in holds[t]:
                    if b != v and capacity - fill[b] >= gain and fill[b] + gain > fill[v]:
                        best = (gain, b, group, t)
                        break
        if best is None:
            return False
        _, b, group, t = best
        swapped = next(i for i in open_bins[b] if sizes[i] == t)
        put(b, group, [swapped])
        put(v, [swapped], group)
        return True

    passes = 0
    while len(open_bins) > least and passes < _PASSES:
        passes += 1
        moved = False
        for v in heapq.nsmallest(_EMPTIEST, open_bins, key=lambda b: (fill[b], b)):
            while open_bins[v] and improve(v):
                moved = True
            if not open_bins[v]:
                gaps[capacity - fill[v]].discard(v)
                del open_bins[v]
                passes = 0
                break
        if not moved:
            break
    return full + list(open_bins.values())


def _place(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack a shard (uid, length, bin), from scratch and from the given bins where ``bin`` is set."""
    frame = frame.sort_values("uid", kind="stable")
    sizes = [int(x) for x in frame["length"]]
    bins = local_search(best_fit(sizes, capacity), sizes, capacity)
    given = frame["bin"].to_numpy()
    if (given >= 0).all():
        order: dict[int, list[int]] = {}
        for i, b in enumerate(given):
            order.setdefault(int(b), []).append(i)
        bins = min(bins, local_search(list(order.values()), sizes, capacity), key=len)
    uid = frame["uid"].to_numpy()
    out = []
    for b in bins:
        # A bin is named after its smallest piece, so names never meet across shards.
        name, at = min(int(uid[i]) for i in b), 0
        fill = sum(sizes[i] for i in b)
        for i in sorted(b, key=lambda i: uid[i]):
            out.append((int(uid[i]), sizes[i], name, at, fill))
            at += sizes[i]
    return pd.DataFrame(out, columns=["uid", "length", "bin", "offset", "fill"])


def _dealt(items: DataFrame, shards: int) -> DataFrame:
    """Each task deals its pieces, sorted by length, to the shards in turn, so that all shards get the same mix of lengths."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("packing")
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            yield batch.assign(shard=(at + np.arange(len(batch))) % shards)
            at += len(batch)

    return items.sortWithinPartitions("length", "uid").mapInPandas(deal, "uid long, length long, bin long, shard int")


PLACES = "uid long, length long, bin long, offset long, fill long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (any columns, with ``uid`` unique and ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Offsets in a sequence run from 0 without gaps; no sequence exceeds ``capacity``.
    Shards hold some ``shard_pieces`` pieces of the same mix of lengths, however many there
    are and however often one document is repeated. An empty table gives none.
    """
    full = F.col("length") == capacity
    items = pieces.where(~full).select("uid", F.col("length").cast("long").alias("length"), F.lit(-1).cast("long").alias("bin"))
    done: list[DataFrame] = []
    for k in range(ROUNDS):
        shards = max(1, -(-items.count() // shard_pieces))
        # A bin of an earlier round stays together: it is dealt by its name.
        by_name = F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(shards)).cast("int")
        shared_out = _dealt(items, shards) if k == 0 else items.withColumn("shard", by_name)
        packed = written(
            shared_out.groupBy("shard").applyInPandas(
                lambda frame: _place(frame[["uid", "length", "bin"]], capacity), PLACES
            ),
            "packing",
        )
        last = k == ROUNDS - 1 or shards == 1
        loose = F.col("fill") < WELL_FILLED * capacity
        done.append(packed if last else packed.where(~loose))
        if last:
            break
        items = packed.where(loose).select("uid", "length", "bin")
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    places = places.select("uid", F.col("bin").alias("sequence_id"), "offset")
    single = pieces.where(full).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return pieces.where(~full).join(places, "uid").select(*single.columns).unionByName(single)


def pack_documents(documents: DataFrame, model_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``documents``.

    Texts are tokenised once; only the pieces' lengths and checksums are kept for the
    packing. The ids themselves are those of ``tokenized``.
    """
    pieces = tokenized(documents, model_file, capacity).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).drop("uid")
