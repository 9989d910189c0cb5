"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a benchmark item if some stretch of it is within a share of
edits of a passage of the item (both in plain form: lower case, only letters and digits,
single spaces). The passages of a long item are its equal parts and windows of about ``PASSAGE_CHARS``
characters, so close that any quote of 110 plain characters holds one but for fewer characters than
may be edited; a shorter item is one passage. A passage within ``k`` edits of a stretch, cut into more
than ``k`` pieces, has at least one piece unedited. So all
pieces of all items are searched exactly in one pass over each document.

The pieces of an item's windows lie on one grid, so that windows share them, in pairs and pairs of pairs.
In any match some four pieces of the window have at most three edits, two of those at most one, and one
of these none. A hit is checked in the other order: its neighbour in the pair by comparing
texts, then the four pieces and last the windows by Myers' bit-parallel distance. Chance hits end at the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.shared import remembers, small_batches, small_or_joined, working_on, written

#: Edits allowed per hundred characters of an item.
EDIT_PERCENT = 10
#: Items shorter than this in plain form are searched unedited, between word bounds.
MIN_CHARS = 40
#: Items shorter than this, or of fewer words than three, say too little to be found in other texts.
MIN_EXACT_CHARS = 20
#: Plain characters of a window of a longer item, about; see :func:`grid`.
PASSAGE_CHARS = 100
#: Items whose pieces are searched in one pass; more items take more passes.
ITEMS_PER_PASS = 20_000

MATCHES = "doc_id long, item_id long, edits int, start long, end long"


class _Plain(dict):
    """Lower-cased letters and digits stay, all else is a space."""

    def __missing__(self, code: int):
        c = chr(code)
        low = c.lower()
        out = low if c.isalnum() and len(low) == 1 else (c if c.isalnum() else " ")
        self[code] = out
        return out


_PLAIN = _Plain()


#: The same for characters of one byte, which plain lower-casing never leaves.
_PLAIN_BYTES = "".join(chr(c).translate(_PLAIN) for c in range(256)).encode("latin-1")


def plain(text: str) -> str:
    try:
        text = text.encode("latin-1").translate(_PLAIN_BYTES).decode("latin-1")
    except UnicodeEncodeError:
        text = text.translate(_PLAIN)
    return " ".join(text.split())


@lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


remembers("decontam", _masks.cache_clear)


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The fewest edits between ``pattern`` and any stretch of ``text``, and where the first such stretch ends."""
    m = len(pattern)
    masks, full, top = _masks(pattern), (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a stretch may start anywhere: row 0 is all zero
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def grid(size: int = PASSAGE_CHARS, edit_percent: int = EDIT_PERCENT) -> tuple[int, int, int]:
    """(characters of a piece, pieces of a window, edits allowed in a window): whole fours of pieces, more than there may be edits."""
    pieces = 4
    while True:
        length = -(-size // pieces)
        budget = length * pieces * edit_percent // 100
        if pieces > budget:
            return length, pieces, budget
        pieces += 4


def starts_of(length: int, size: int = PASSAGE_CHARS, edit_percent: int = EDIT_PERCENT) -> list[int]:
    """Where windows begin in an item longer than one: at every second piece, and where the last one ends with the item."""
    piece, pieces, _ = grid(size, edit_percent)
    return sorted({*range(0, length - piece * pieces + 1, 2 * piece), length - piece * pieces})


def passages(text: str, size: int = PASSAGE_CHARS, edit_percent: int = EDIT_PERCENT) -> list[str]:
    """A short item's text whole; all windows of a longer one, and its text in equal parts of at least ``size`` characters."""
    piece, pieces, _ = grid(size, edit_percent)
    if len(text) <= piece * pieces:
        return [text]
    windows = [text[a : a + piece * pieces] for a in starts_of(len(text), size, edit_percent)]
    return list(dict.fromkeys([*windows, *parts(text, size)]))


def parts(text: str, size: int = PASSAGE_CHARS) -> list[str]:
    """The equal parts of a long item. Longer than windows, they may hold more edits close together."""
    n = max(1, len(text) // size)
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]


def _follows(piece: str, text: str, at: int) -> bool:
    """Whether ``piece`` comes in ``text`` from ``at`` on with at most one edit."""
    if text.startswith(piece, at):
        return True
    n = len(piece)
    here = text[at : at + n + 1]
    i = 0
    while i < len(here) and i < n and piece[i] == here[i]:
        i += 1
    return here.startswith(piece[i + 1 :], i + 1) or here.startswith(piece[i + 1 :], i) or here.startswith(piece[i:], i + 1)


def _chain(leaf: int, cuts: list[int]) -> list[tuple[int, int, int]]:
    """The stretches around a piece, from the smallest to all but the whole: (start, end, edits allowed).

    A stretch of j pieces may have j - 1 edits. If both halves of a stretch had more than
    theirs, the stretch would too; so in any match some piece has all of its chain in budget.
    """
    low, high, out = 0, len(cuts) - 1, []
    while high - low > 1:
        out.append((cuts[low], cuts[high], high - low - 1))
        middle = (low + high) // 2
        low, high = (low, middle) if leaf < middle else (middle, high)
    return out[:0:-1]


class Matcher:
    """The pieces of a set of (item id, plain text), searched together."""

    def __init__(self, items: list[tuple[int, str]], edit_percent: int = EDIT_PERCENT, passage_chars: int = PASSAGE_CHARS, min_chars: int = MIN_CHARS):
        self.piece, self.pieces, self.budget = grid(passage_chars, edit_percent)
        self.patterns: list[tuple[list[int], str, int]] = []
        self.automaton = ahocorasick.Automaton()
        texts: dict[str, list[int]] = {}
        for item_id, text in items:
            texts.setdefault(text, []).append(item_id)
        # Of each piece: the whole passages it is part of, and its places on the grids of longer items.
        places: dict[str, tuple[list, list]] = {}
        windows: dict[str, int] = {}
        whole: dict[str, int] = {}
        for text, same in texts.items():
            same = sorted(set(same))
            if len(text) < min_chars:
                places.setdefault(f" {text} ", ([], []))[0].append((self._pattern(same, f" {text} ", 0), 0, None, []))
            elif len(text) <= self.piece * self.pieces:
                self._cut_up(text, same, edit_percent, whole, places)
            else:
                self._lay_out(text, same, windows, places)
                for part in parts(text, passage_chars):
                    self._cut_up(part, same, edit_percent, whole, places)
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), *where))
        if places:
            self.automaton.make_automaton()

    def _pattern(self, items: list[int], text: str, budget: int) -> int:
        self.patterns.append((items, text, budget))
        return len(self.patterns) - 1

    def _cut_up(self, text: str, items: list[int], edit_percent: int, known: dict[str, int], places: dict[str, tuple[list, list]]) -> None:
        """The pieces of a passage that is searched by itself, one more than it may have edits."""
        if text in known:
            self.patterns[known[text]][0].extend(items)
            return
        budget = len(text) * edit_percent // 100
        cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
        number = known[text] = self._pattern(list(items), text, budget)
        for leaf in range(budget + 1):
            around = [(a, b, e, text[a:b]) for a, b, e in _chain(leaf, cuts)]
            low, high = cuts[leaf], cuts[leaf + 1]
            neighbour = None
            if around and around[0][2] == 1:
                # Two pieces with one edit: the other one comes before or after this one with at most one.
                a, b, _, _ = around.pop(0)
                neighbour = (True, text[high:b]) if a == low else (False, text[a:low][::-1])
            places.setdefault(text[low:high], ([], []))[0].append((number, low, neighbour, around))

    def _lay_out(self, text: str, items: list[int], windows: dict[str, int], places: dict[str, tuple[list, list]]) -> None:
        """The pieces of a long item: those of the windows from its start on, and those of the last one."""
        g, span = self.piece, self.piece * self.pieces
        last = len(text) - span
        for base, starts in ((0, range(0, last + 1, 2 * g)), (last, [last] if last % (2 * g) else [])):
            if not starts:
                continue
            numbers = {}
            for start in starts:
                window = text[start : start + span]
                if window not in windows:
                    windows[window] = self._pattern([], window, self.budget)
                number = windows[window]
                known = self.patterns[number][0]
                known.extend(i for i in items if i not in known)
                numbers[start] = number
            end = max(starts) + span
            for at in range(base, end, g):
                pair = at - (at - base) % (2 * g)
                first = at == pair
                other = text[at + g : at + 2 * g] if first else text[at - g : at]
                fours = []
                for low in (pair - 2 * g, pair):
                    # The windows in which these four pieces are one of the fours.
                    held = [(s, numbers[s]) for s in range(low, max(base, low - span + 4 * g) - 1, -4 * g) if s in numbers]
                    if held and low >= base and low + 4 * g <= end:
                        fours.append((at - low, text[low : low + 4 * g], [(at - s, n) for s, n in held]))
                places.setdefault(text[at : at + g], ([], []))[1].append((first, other if first else other[::-1], fours))

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For every item found, (edits, start, end) of its best passage; places in the plain text."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.patterns:
            return found
        g = self.piece
        # Bounds for items that are searched between spaces; places count them until the end.
        text = f" {text} "
        spots: dict[int, set[int]] = {}
        for end, (size, whole, laid) in self.automaton.iter(text):
            at = end + 1 - size
            before = None
            for number, offset, neighbour, around in whole:
                start = at - offset
                if neighbour is not None:
                    follows, other = neighbour
                    if not (_follows(other, text, end + 1) if follows else _follows(other, text[max(0, at - len(other) - 1) : at][::-1], 0)):
                        continue
                for a, b, e, stretch in around:
                    low = max(0, start + a - e)
                    if not text.startswith(stretch, start + a) and myers(stretch, text[low : start + b + e])[0] > e:
                        break
                else:
                    spots.setdefault(number, set()).add(start)
            for first, other, fours in laid:
                if first:
                    if not _follows(other, text, end + 1):
                        continue
                else:
                    if before is None:
                        before = text[max(0, at - g - 1) : at][::-1]
                    if not _follows(other, before, 0):
                        continue
                for offset, stretch, held in fours:
                    start = at - offset
                    if text.startswith(stretch, max(start, 0)) or myers(stretch, text[max(0, start - 3) : start + 4 * g + 3])[0] <= 3:
                        for offset, number in held:
                            spots.setdefault(number, set()).add(at - offset)
        for number, starts in spots.items():
            same, pattern, budget = self.patterns[number]
            best = (budget + 1, 0)
            for start in sorted(starts):
                low = max(0, start - budget)
                edits, end = (0, start + len(pattern) - low) if start >= 0 and text.startswith(pattern, start) else myers(pattern, text[low : start + len(pattern) + budget])
                best = min(best, (edits, low + end))
                if edits == 0:
                    break
            if best[0] <= budget:
                low, high = best[1] - len(pattern), best[1]
                if pattern[0] == pattern[-1] == " " and not budget:
                    low, high = low + 1, high - 1
                hit = (best[0], max(0, low - 1), max(0, min(high - 1, len(text) - 2)))
                for item in same:
                    found[item] = min(found.get(item, hit), hit)
        return found


def find(documents: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT, min_chars: int = MIN_CHARS,
         items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, edits, start, end.

    Edits, start and end are those of the item's best passage. Start and end are places in the document's plain text; start is exact for a match
    without edits. Null texts are empty and match nothing, nor do items without an id. Items below
    ``min_chars`` plain characters are found unedited between word bounds, those below
    ``MIN_EXACT_CHARS`` or of fewer than three words not at all. Equal items match together, equal
    documents each. Documents without an id are searched and reported with a null id.
    Items are searched in passes of ``items_per_pass``, so the pieces held in a task are
    bounded however large the benchmark is. Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    passes = max(1, -(-items.count() // items_per_pass))
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = [(r.item_id, p) for r in part.toLocalIterator() if len(p := plain(r.text)) >= min_chars or (len(p) >= MIN_EXACT_CHARS and p.count(" ") >= 2)]
        shared = spark.sparkContext.broadcast(sorted(rows))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            working_on("decontam")
            matcher = Matcher(shared.value, edit_percent, min_chars=min_chars)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    found += [(doc_id, item, *hit) for item, hit in matcher.matches(plain(text)).items()]
                frame = pd.DataFrame(found, columns=["doc_id", "item_id", "edits", "start", "end"])
                yield frame.astype({"doc_id": "Int64"})

        one = texts.mapInPandas(search, MATCHES)
        out = one if out is None else out.unionByName(one)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows and columns otherwise as they are.

    If one of several documents of an id, or without one, holds an item, all of them go.
    """
    hit = written(find(documents, benchmark).select(F.col("doc_id").alias("__hit")).distinct(), "leaks")
    return documents.join(small_or_joined(hit), documents["doc_id"].cast("long").eqNullSafe(F.col("__hit")), "left_anti")
