import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from khata.llm import topk


def plain(rows, k):
    """Every query with every row, in Python's integers."""
    ints = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ints:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def rows_of(n, seed, stretch):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, 8)) * np.exp(rng.normal(0, stretch, (n, 1)))
    v[n // 2:n // 2 + n // 4] = v[0]  # a large group of equal vectors
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "stretch", "part", "block"), [(300, 0.0, 64, 4), (300, 1.5, 16, 5), (15, 0.5, 4096, 4096)])
def test_equals_brute_force(spark, n, stretch, part, block):
    rows = rows_of(n, n, stretch)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_products(df, F.col("vec_id") % 20 == 0, 20, part=part, block=block).collect()
    assert sorted(map(tuple, got)) == plain(rows, 20)


def test_focus_loses_no_candidate():
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (4000, 6))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in rng.normal(0, 1, (20, 6)):
        for cosine in (0.7, 0.9, 0.99):
            good = np.flatnonzero(unit @ q / np.linalg.norm(q) >= cosine)
            near = topk.focus_candidates(q, unit, cosine)
            assert set(good) <= set(near) and len(near) < len(v)


def test_large_numbers_are_exact():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert topk.products(q, v).tolist() == [[2**60 + 1, 2**60 + 2]]


def test_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, nan], "b"), (2, None, "c"), (3, [1.0, None], "d"), (4, [0.5, 0.5], "e"), (5, [0.5, 0.5], "f"), (None, [9.0, 9.0], "g"), (20, [], "h"), (6, [-1.0, float("inf")], "i"), (5, [0.5, 0.5], "f")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    got = topk.top_products(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 4, 2048), (0, 2, 5, 2048), (0, 3, 5, 2048), (0, 4, 20, 0), (20, 1, 0, 0), (20, 2, 4, 0), (20, 3, 5, 0), (20, 4, 5, 0)]
    assert topk.top_products(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
