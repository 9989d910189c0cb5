"""Exact top-k inner products, pruned by norms and SVD-rotated partial sums.

Vectors are sorted by descending length and packed into blocks. The blocks of the longest
vectors give each query a first threshold: its k-th best score so far. A later block whose
longest vector times the query's length stays below that threshold is skipped whole. In
the blocks that are left, vectors and queries are rotated onto the singular vectors of the
corpus; inner products over the first few rotated dimensions plus the Cauchy-Schwarz bound
on the rest (the product of the two residual lengths) discard most vectors, and only the
others are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm.shared import shuffle_partitions, written

BLOCK = "dim int, max_norm double, ids binary, vectors binary"
HITS = "query_id long, vec_id long, score long"
#: Inner products of doubles are exact below this.
_EXACT = 2.0**53
_LONGEST = 2**63 - 1


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm): vectors as whole numbers floor(scale * x), without unusable ones.

    A vector that is null or empty, or holds a null or a non-finite component, or whose id is null,
    takes no part.
    """
    x = F.col(vec_col)
    good = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("double"))
    return (
        df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & good)
        .select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))
    )


def _packed(clean: DataFrame, rows: int, partitions: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension, in order of descending norm."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def block() -> pd.DataFrame:
            matrix = np.asarray(vectors, dtype=np.float64)
            norm = float(np.sqrt((matrix * matrix).sum(axis=1)).max())
            return pd.DataFrame(
                [(matrix.shape[1], norm, np.asarray(ids, dtype=np.int64).tobytes(), matrix.tobytes())],
                columns=["dim", "max_norm", "ids", "vectors"],
            )

        for batch in batches:
            for vec_id, v in zip(batch["vec_id"], batch["v"], strict=True):
                if ids and (len(ids) == rows or len(v) != len(vectors[0])):
                    yield block()
                    ids, vectors = [], []
                ids.append(vec_id)
                vectors.append(v)
        if ids:
            yield block()

    dim = F.size("v")
    return (
        clean.repartitionByRange(partitions, dim, F.col("norm").desc(), "vec_id")
        .sortWithinPartitions(dim, F.col("norm").desc(), "vec_id")
        .select("vec_id", "v")
        .mapInPandas(pack, BLOCK)
    )


def _rotations(clean: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the singular vectors of all its vectors, by falling singular value.

    What reaches the driver is the sum of the partitions' Gram matrices: dim * dim numbers.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch["v"].map(len)
            for dim, part in batch["v"].groupby(lengths):
                matrix = np.stack(part.to_numpy())
                sums[dim] = sums.get(dim, 0) + matrix.T @ matrix
        for dim, total in sums.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(dim * dim), "value": total.ravel()})

    rows = (
        clean.select("v").mapInPandas(gram, "dim int, at long, value double")
        .groupBy("dim", "at").agg(F.sum("value").alias("value"))
    ).toPandas()
    out = {}
    for dim, part in rows.groupby("dim"):
        flat = np.zeros(dim * dim)
        flat[part["at"].to_numpy()] = part["value"].to_numpy()
        _, vectors = np.linalg.eigh(flat.reshape(dim, dim))
        out[int(dim)] = vectors[:, ::-1].copy()
    return out


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=np.float64).reshape(-1, dim)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; beyond the range of doubles by Python's integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if bound < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries) @ whole(vectors).T, -_LONGEST, _LONGEST)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _survivors(q: np.ndarray, c: np.ndarray, floor: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Which (query, vector) pairs can still reach the query's floor.

    The bound grows tighter with each further stretch of rotated dimensions.
    """
    dim = q.shape[1]
    qr, cr = q @ rotation, c @ rotation
    alive = np.ones((len(q), len(c)), dtype=bool)
    partial = np.zeros((len(q), len(c)))
    done = 0
    slack = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]) + 1e-6
    for upto in sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2)}):
        partial += qr[:, done:upto] @ cr[:, done:upto].T
        done = upto
        rest = np.linalg.norm(qr[:, done:], axis=1)[:, None] * np.linalg.norm(cr[:, done:], axis=1)[None, :]
        alive &= partial + rest + slack >= floor[:, None]
        if alive.mean() < 0.02:
            break
    return alive


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, block_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """The ``k`` vectors with the highest inner product for every query row.

    ``is_query`` is a condition on ``vec_id``. Returns query_id, rank (from 1), vec_id and
    score; ties go to the smaller id, a query is no candidate of its own. Rows with equal
    ids are candidates each, but not for queries of that id; a repeated query id is one
    query, the row with the largest norm and then the largest components. Vectors of different
    dimensions don't meet. Components and scores beyond 64 bits are cut to that range. Fewer than ``k`` candidates give all of them, an empty table
    gives no rows.

    Query blocks meet candidate blocks by an equi-join on the block number, so each task
    holds one block of either side.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    clean = written(clean_vectors(df, id_col, vec_col, scale), "topk-vectors")
    rotations = spark.sparkContext.broadcast(_rotations(clean))
    number = Window.partitionBy("dim").orderBy(F.col("max_norm").desc(), F.col("place"))
    packed = written(_packed(clean, block_rows, parts).withColumn("place", F.monotonically_increasing_id()), "topk-blocks")
    # The directory has one small row per block of vectors; only it is numbered in order.
    order = packed.select("dim", "max_norm", "place").withColumn("block", F.row_number().over(number) - 1)
    blocks = written(packed.join(order.select("place", "block"), "place").drop("place"), "topk-numbered")
    once = Window.partitionBy("vec_id").orderBy(F.col("norm").desc(), F.col("v").desc())
    asked = clean.where(is_query).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    queries = _packed(asked, query_rows, parts).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    counts = blocks.groupBy("dim").agg(F.count("*").alias("blocks"), F.sum(F.length("ids") / 8).alias("rows"))
    first = blocks.where("block = 0").select("dim", "ids", "vectors")

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floors = []
            for row in batch.itertuples():
                ids, vectors = _matrix(row.ids, row.vectors, row.dim)
                q_ids, q = _matrix(row.q_ids, row.q_vectors, row.dim)
                scores = _exact(q, vectors).astype(np.float64)
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                if scores.shape[1] < k:
                    floor = np.full(len(q), -np.inf)
                else:
                    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                floor = np.where(np.abs(floor) < _EXACT, floor, floor - 1e-12 * np.abs(floor))  # rounded scores
                floors.append(floor.tobytes())
            yield batch[["dim", "q_ids", "q_vectors"]].assign(floors=floors)

    seeded = written(
        queries.join(first, "dim").mapInPandas(seed, "dim int, q_ids binary, q_vectors binary, floors binary"),
        "topk-queries",
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, vectors = _matrix(row.ids, row.vectors, row.dim)
                q_ids, q = _matrix(row.q_ids, row.q_vectors, row.dim)
                floor = np.frombuffer(row.floors, dtype=np.float64)
                reach = np.linalg.norm(q, axis=1) * row.max_norm * (1 + 1e-9) + 1e-6 >= floor
                if not reach.any():
                    continue
                q_ids, q, floor = q_ids[reach], q[reach], floor[reach]
                alive = _survivors(q, vectors, floor, rotations.value[row.dim])
                alive &= q_ids[:, None] != ids[None, :]
                out = []
                for i in np.flatnonzero(alive.any(axis=1)):
                    at = np.flatnonzero(alive[i])
                    scores = _exact(q[i : i + 1], vectors[at])[0]
                    best = _best(scores, ids[at], k)
                    out += [(q_ids[i], ids[at[j]], int(scores[j])) for j in best if scores[j] >= floor[i]]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # Each query block is dealt to every block number of its dimension.
    dealt = seeded.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    hits = dealt.join(blocks, ["dim", "block"]).select(
        "dim", "q_ids", "q_vectors", "floors", "max_norm", "ids", "vectors"
    ).mapInPandas(score, HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
