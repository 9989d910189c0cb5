import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import search


def brute(rows, is_query, k=5):
    clean = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in clean:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in clean if i != q and len(v) == len(u))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def result(df, **how):
    return sorted(tuple(r) for r in search.top_k(df, F.col("vec_id") % 10 == 0, **how).collect())


@pytest.mark.parametrize("block_rows", [3, 16, 2048])
def test_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    scale = rng.lognormal(0, 1, 300)[:, None]
    vectors = (rng.normal(size=(300, 12)) * scale).astype(np.float32)
    vectors[100:130] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(df, block_rows=block_rows, query_rows=7) == brute(rows, lambda i: i % 10 == 0)


def test_unusable_and_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [0.5, -0.25]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
        (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (20, [9.0]), (None, [1.0, 1.0]), (30, [1e30, 1e30]), (31, [1e30, -1e30]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("dim", F.lit(1))
    usable = [(i, v) for i, v in rows if not (i in (30, 31))]
    got = result(df.where("vec_id < 30"))
    assert got == brute(usable, lambda i: i % 10 == 0)
    assert result(df.limit(0)) == []


def test_big_numbers_are_exact(spark):
    rows = [(i, [float(2**30 + i), float(2**31 - i)]) for i in range(11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df, scale=1) == [
        (q, n, i, s) for q, n, i, s in brute([(i, [x / 256 for x in v]) for i, v in rows], lambda i: i % 10 == 0)
    ]
