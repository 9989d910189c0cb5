"""Hashes of word shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bytes that are hashed in one go; arrays of eight-byte numbers of this length are held at once.
_BLOCK = 250_000
_K = 0x9E3779B97F4A7C15 | 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX[1])
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash's base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, _BLOCK + 1)
        step = np.full(n, _K, dtype=np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step[1:] = pow(_K, -1, 1 << 64)
        _inverses = np.multiply.accumulate(step)
    return _powers, _inverses


def _words(data: bytes) -> np.ndarray:
    """The hashes of the words of lower-cased ``data`` that ends in white space."""
    b = np.frombuffer(data, dtype=np.uint8)
    power, inverse = powers(len(b) + 1)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start])


def _blocks(data: bytes) -> Iterable[bytes]:
    """``data`` in blocks cut at white space, each ending in it."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        if end >= len(data):
            yield data[at:] + b" "
            return
        cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:  # a word longer than a block
            ends = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(c, end)) >= 0]
            cut = min(ends, default=len(data))
        yield data[at:cut] + b" "
        at = cut + 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many each text has.

    Words are runs of anything but space, tab, line breaks, vertical tab and form feed;
    A to Z count as a to z.
    """
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    group: list[bytes] = []
    members: list[int] = []

    def flush() -> None:
        if not group:
            return
        data = b"".join(group)
        found = _words(data)
        hashes.append(found)
        b = np.frombuffer(data, dtype=np.uint8)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        bounds = np.cumsum([len(g) for g in group])
        at = np.searchsorted(starts, bounds, side="left")
        np.add.at(counts, members, np.diff(np.concatenate([[0], at])))
        group.clear()
        members.clear()

    size = 0
    for i, text in enumerate(texts):
        for block in _blocks(text.encode("utf-8", "surrogatepass").lower()):
            if size + len(block) > _BLOCK and group:
                flush()
                size = 0
            group.append(block)
            members.append(i)
            size += len(block)
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def shingle_sets(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, sorted within it, and the bounds of each text's stretch.

    A text with fewer than ``width`` words has the whole sequence as its one shingle, one
    without words none.
    """
    words, counts = word_hashes(texts)
    n = len(words)
    doc = np.repeat(np.arange(len(texts)), counts)
    salts = [np.uint64(pow(_K, k + 2, 1 << 64)) for k in range(width)]
    long = np.zeros(0, dtype=np.uint64)
    owner = np.zeros(0, dtype=np.int64)
    if n >= width:
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for k, salt in enumerate(salts):
            total += words[k : n - width + 1 + k] * salt
        inside = doc[: n - width + 1] == doc[width - 1 :]
        long, owner = mixed(total[inside]), doc[: n - width + 1][inside]
    short_docs = np.flatnonzero((counts > 0) & (counts < width))
    if len(short_docs):
        first = np.cumsum(counts) - counts
        short = np.zeros(len(short_docs), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[short_docs] > k
            short[has] += words[first[short_docs[has]] + k] * salts[k]
        short = mixed(short ^ mixed(counts[short_docs].astype(np.uint64)))
        long, owner = np.concatenate([long, short]), np.concatenate([owner, short_docs])
    order = np.lexsort((long, owner))
    long, owner = long[order], owner[order]
    keep = np.ones(len(long), dtype=bool)
    keep[1:] = (long[1:] != long[:-1]) | (owner[1:] != owner[:-1])
    long, owner = long[keep], owner[keep]
    return long, np.searchsorted(owner, np.arange(len(texts) + 1))
