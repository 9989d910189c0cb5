"""Gradient-boosted trees for binary labels, grown from sums over all rows: of a matrix in one process, or of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradients are summed as whole numbers of this fraction, so that the sums don't depend on the order of the rows.
_UNIT = 1 << 20


@dataclass
class Boosted:
    """Trees of one depth; in level order, a row goes right where x[feature] > cut."""

    base: float
    features: np.ndarray  # trees x nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            total += leaves[_node(x, features, cuts, depth) - (2**depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _node(x: np.ndarray, features: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree that every row reaches after ``depth`` steps."""
    rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
    return node


@dataclass
class Level:
    """What the sums of a level of a tree need: the trees so far and the nodes above, all on coded rows."""

    trees: Boosted
    features: np.ndarray
    cuts: np.ndarray
    level: int
    bins: int

    def sums(self, coded: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sums of gradient and curvature by node, feature and bin; row i counts ``n[i]`` times."""
        p = self.trees.probability(coded)
        grad = np.rint((y - p) * _UNIT) * n
        hess = np.rint(np.maximum(p * (1 - p), 1e-9) * _UNIT) * n
        count, width = 2**self.level, coded.shape[1]
        local = _node(coded, self.features, self.cuts, self.level) - (count - 1)
        out = np.zeros((2, count, width, self.bins), dtype=np.int64)
        for f in range(width):
            at = local * self.bins + coded[:, f]
            for k, values in enumerate((grad, hess)):
                out[k, :, f] = np.rint(np.bincount(at, values, count * self.bins)).astype(np.int64).reshape(count, self.bins)
        return out


def grow(
    edges: list[np.ndarray], base: float, sums: Callable[[Level], np.ndarray], trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0
) -> Boosted:
    """Second-order boosting of the logistic loss over binned features, level by level from ``sums``."""
    nodes, bins = 2**depth - 1, max((len(e) + 1 for e in edges), default=1)
    found = Boosted(base, np.zeros((0, nodes), dtype=np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    for _ in range(trees):
        features, cuts = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            g, h = sums(Level(found, features, cuts, level, bins)) / _UNIT
            g, h = g.cumsum(axis=2), h.cumsum(axis=2)
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            place = gain.reshape(count, -1).argmax(axis=1)
            better = np.flatnonzero(gain.reshape(count, -1)[np.arange(count), place] > 1e-12)
            features[low + better], cuts[low + better] = place[better] // bins, place[better] % bins
        # What the last level's nodes send left and right; a node without a cut sends all left.
        at = np.arange(count), features[low:], np.minimum(cuts[low:], bins - 1).astype(np.int64)
        left_g, left_h = g[at], h[at]
        sides_g = np.stack([left_g, total_g.ravel() - left_g], axis=1).ravel()
        sides_h = np.stack([left_h, total_h.ravel() - left_h], axis=1).ravel()
        leaves = rate * sides_g / (sides_h + ridge)
        found = Boosted(base, *(np.concatenate([a, b[None]]) for a, b in ((found.features, features), (found.cuts, cuts), (found.leaves, leaves))))
    for f, cut in enumerate(edges):
        own = (found.features == f) & np.isfinite(found.cuts)
        found.cuts[own] = cut[found.cuts[own].astype(np.int64)]
    return found


def edges_of(values: np.ndarray, n: np.ndarray, bins: int = 32) -> np.ndarray:
    """Cuts between ``bins`` equal shares of a feature whose distinct ``values`` in order occur ``n`` times; between all values if they are few."""
    if len(values) <= bins:
        return values[:-1]
    wanted = np.linspace(0, 1, bins + 1)[1:-1] * n.sum()
    return np.unique(values[np.minimum(np.searchsorted(np.cumsum(n), wanted), len(values) - 2)])


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def _base(positive: float, n: float) -> float:
    p0 = (positive + 1) / (n + 2)
    return float(np.log(p0 / (1 - p0)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """The trees of a matrix that fits in one process."""
    edges = [edges_of(*np.unique(x[:, f], return_counts=True), bins) for f in range(x.shape[1])]
    rows, ones = coded(x, edges), np.ones(len(x))
    return grow(edges, _base(y.sum(), len(y)), lambda level: level.sums(rows, y, ones), trees, depth, rate, ridge)


ROWS = "label int, x binary, n long"


def unpacked(x: pd.Series, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype=dtype).reshape(len(x), width)


def table_edges(rows: DataFrame, width: int, bins: int = 32) -> list[np.ndarray]:
    """The edges of every feature over all ``rows`` (ROWS, x as 32-bit floats); the driver gets a feature's distinct values with their numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, n = unpacked(batch["x"], "<f4", width).astype(float), batch["n"].to_numpy()
            for f in range(width):
                values, at = np.unique(x[:, f], return_inverse=True)
                yield pd.DataFrame({"feature": f, "value": values, "n": np.bincount(at, n, len(values)).astype(np.int64)})

    found = rows.mapInPandas(count, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")).toPandas()
    found = found.sort_values(["feature", "value"])
    own = [found[found["feature"] == f] for f in range(width)]
    return [edges_of(o["value"].to_numpy(), o["n"].to_numpy(), bins) if len(o) else np.zeros(0) for o in own]


def table_codes(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``rows`` (ROWS) with x as a byte for each feature's bin, equal rows as one."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = coded(unpacked(batch["x"], "<f4", len(edges)), edges).astype(np.uint8)
            yield batch.assign(x=[row.tobytes() for row in x])

    return rows.mapInPandas(code, ROWS).groupBy("label", "x").agg(F.sum("n").alias("n"))


def fit_table(codes: DataFrame, edges: list[np.ndarray], trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """The trees of all rows of a table of ``table_codes``, with a job for each level of each tree; the driver gets sums by node, feature and bin."""
    width = len(edges)

    def sums(level: Level) -> np.ndarray:
        shape = (2, 2**level.level, width, level.bins)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape, dtype=np.int64)
            for batch in batches:
                rows = unpacked(batch["x"], "u1", width).astype(np.int64)
                total += level.sums(rows, batch["label"].to_numpy(float), batch["n"].to_numpy(float))
            total = total.ravel()
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "value": total[at]})

        out = np.zeros(int(np.prod(shape)), dtype=np.int64)
        found = codes.mapInPandas(add, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        out[found["at"].to_numpy(dtype=np.int64)] = found["value"].to_numpy(dtype=np.int64)
        return out.reshape(shape)

    size = codes.agg(F.sum(F.col("label") * F.col("n")).alias("positive"), F.sum("n").alias("n")).first()
    return grow(edges, _base(size.positive or 0, size.n or 0), sums, trees, depth, rate, ridge)
