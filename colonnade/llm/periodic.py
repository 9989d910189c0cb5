"""Runs: stretches of words that repeat with a period, found by a dictionary of basic factors.

For each power of two L, equal stretches of L words get the same name, made from the names of
their halves. The next occurrences of a stretch that begin at least L and less than 2 L words
after it propose their distance as a period; two are enough, as is shown below. A proposed
period is extended to both sides by the names of all lengths, longest first, and
what is at least twice its period long is a run. Of the periods of one run the smallest counts.

Why two occurrences are enough: take a run with smallest period q and L <= q < 2 L. Were q
not among the first two distances in [L, 2 L) for any of the stretches that begin in the run's
first words, each of them would occur three times within less than L words, so each had a
period below L / 2; neighbours overlap by L - 1 words, so all had the same one, p. Then p
would be a period of the run's first q + L words beside q, hence the greatest common divisor of both
a period of its first q words, and q not the smallest.

A stretch that occurs only once in its document is not followed further, so ordinary text
leaves little to do after the first lengths. Documents are searched many at once, as one
sequence of numbers in which no two share a number. All work on a document happens in its
task, over its whole text; memory is linear in the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least.
MIN_LENGTH = 12
#: Characters of the texts that are searched at once, but at least one text.
GROUP_CHARS = 1_500_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = "struct<start:long,length:long,period:long>"
#: What :func:`find` returns beside the id.
FOUND = f"n_words long, runs array<{_RUN}>, collapsed string"


def _classes(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs again, by key and place, and a number per key."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    last = np.ones(len(keys), dtype=bool)
    last[:-1] = first[1:]
    again = ~(first & last)
    return places[again], np.cumsum(first[again]) - 1


class _Names:
    """The names of the stretches of one length that occur more than once."""

    def __init__(self, places: np.ndarray, names: np.ndarray):
        order = np.argsort(places)
        self.places, self.names = places[order].astype(np.int32), names[order].astype(np.int32)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The names at some places, -1 where the stretch does not occur again."""
        near = np.searchsorted(self.places, places)
        near[near == len(self.places)] = 0
        return np.where(self.places[near] == places, self.names[near], -1)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left = self.at(a)
        return (left >= 0) & (left == self.at(b))


def _proposed(places: np.ndarray, names: np.ndarray, length: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods in [length, 2 length): the first two later occurrences that lie so far off."""
    far = np.int64(4 * n + 4)  # names are further apart than any two places
    keys = names.astype(np.int64) * far + places
    later = np.searchsorted(keys, keys + length)
    for step in (0, 1):
        at = later + step
        inside = np.flatnonzero(at < len(keys))
        period = keys[at[inside]] - keys[inside]
        near = period < 2 * length
        yield places[inside[near]], period[near]


def runs(codes: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of a sequence of numbers, by start and period."""
    n = len(codes)
    places, names = _classes(codes, np.arange(n, dtype=np.int64))
    levels: list[_Names] = []
    starts, periods = [], []
    length = 1
    while len(places):
        for at, period in _proposed(places, names, length, n):
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            # Neighbouring places with one period lie in one stretch.
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
            starts.append(at[fresh])
            periods.append(period[fresh])
        level = _Names(places, names)
        levels.append(level)
        follow = level.at(level.places + length)
        both = follow >= 0
        halves = level.names[both].astype(np.int64) * (int(names.max()) + 1) + follow[both]
        places, names = _classes(halves, level.places[both].astype(np.int64))
        length *= 2
    if not starts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    low, period = np.concatenate(starts), np.concatenate(periods)
    high = low.copy()  # words from low up to high equal those one period later
    for k in range(len(levels) - 1, -1, -1):
        high += levels[k].same(high, high + period).astype(np.int64) << k
        back = low - (1 << k)
        low = np.where((back >= 0) & levels[k].same(back, back + period), back, low)
    whole = high - low + period
    kept = (high - low >= period) & (whole >= min_length)
    low, whole, period = low[kept], whole[kept], period[kept]
    order = np.lexsort((period, whole, low))
    low, whole, period = low[order], whole[order], period[order]
    smallest = np.ones(len(low), dtype=bool)
    smallest[1:] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])
    low, whole, period = low[smallest], whole[smallest], period[smallest]
    order = np.lexsort((period, low))
    return low[order], whole[order], period[order]


def _search(texts: list[str | None], min_length: int) -> tuple[list[int], list[int], list[np.ndarray], list[str]]:
    """Per text the number of its words and of its runs, the runs of all, and the texts without repeats."""
    words = [_WORD.findall(text or "") for text in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    every = np.empty(int(offsets[-1]), dtype=object)
    for k, own in enumerate(words):
        every[offsets[k] : offsets[k + 1]] = own
    codes, known = pd.factorize(every)
    codes = codes.astype(np.int64) + np.repeat(np.arange(len(texts), dtype=np.int64), counts) * max(len(known), 1)
    start, length, period = runs(codes, min_length)
    of = np.searchsorted(offsets, start, side="right") - 1
    change = np.zeros(len(every) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    repeated = np.cumsum(change[:-1]) > 0
    found = np.bincount(of, minlength=len(texts))
    collapsed = []
    for k, own in enumerate(words):
        if found[k]:
            own = every[offsets[k] : offsets[k + 1]][~repeated[offsets[k] : offsets[k + 1]]]
        collapsed.append(" ".join(own))
    return counts.tolist(), found.tolist(), [start - offsets[of], length, period], collapsed


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring texts of a bounded size together."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text or "") > GROUP_CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def find(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id with ``n_words``, its ``runs`` and its text without their repeats.

    Words are runs of anything but space, tab, line breaks, vertical tab and form feed. A run
    is a stretch of words with smallest period q, at least ``min_length`` and 2 q words long,
    that no neighbouring word extends; ``runs`` is ordered by start, then period, and counts words
    from 0. ``collapsed`` joins by one space the words that no run contains after its first q.

    A null or blank text has no words, no runs and an empty ``collapsed``. Rows that repeat
    an id stay rows of their own; an empty table gives an empty table. Other columns are left.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _groups(texts):
                counts, found, (start, length, period), collapsed = _search(texts[begin:end], min_length)
                structs = pa.StructArray.from_arrays([pa.array(a, pa.int64()) for a in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]), pa.int32()), structs)
                columns = [batch.column(0)[begin:end], pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(search, f"`{doc_id}` {kind}, {FOUND}")
