"""The exact search against brute force, on vectors with nulls, numbers that aren't finite, repeats, ties and a hot group of copies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symbolith.llm import topk

SCHEMA = "vec_id long, embedding array<float>, base int, query string, d double"


def vectors(n, seed, dims=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    hot = [r.gauss(0, 1) for _ in range(dims)]
    rows += [(n + i, hot) for i in range(n // 2)]  # a third of all
    rows += [(1, None), (100, [None] * dims), (200, [1.0, float("nan")]), (300, [float("inf")] * dims), (None, hot), (None, [2.0] * dims)]
    rows += [(100, []), (100, hot), (100, hot), (7, [1.0, -1.0]), (400, [0.5] * dims), (5000, [0.0] * dims), (-100, [-1.0] * dims)]
    return rows


def brute(rows, every, k=10):
    v = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for a, (i, q) in enumerate(v):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, c)), j is None, j or 0) for b, (j, c) in enumerate(v) if a != b)[:k]
        want += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored, 1)]
    return sorted(want, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"ROWS": 16, "BASE_ROWS": 8}, {"ROWS": 7, "BASE_ROWS": 20, "PIVOTS": 3, "SAMPLE": 9}])
def test_search_is_exact(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    rows = vectors(240, 3)
    df = spark.createDataFrame([(*r, 1, "q", 0.0) for r in rows], SCHEMA).repartition(4)
    got = topk.topk(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 20)


@pytest.mark.parametrize("rows", [[(100, [1.0])], [(100, None)], [(1, [1.0]), (2, [2.0])], [(100, []), (200, [])], [(100, [3.0, 1.0]), (3, [1.0]), (200, None)]])
def test_few_rows(spark, rows):
    got = topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 100)


def test_large_numbers_are_exact(spark):
    """Beyond 2^51 the products are taken in whole numbers."""
    rows = [(i, [float(2**17 + 3 * i), float(2**16 - i)]) for i in range(0, 300, 7)] + [(1000, [131072.0, 65536.0])]
    got = topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert max(r.score for r in got) > 2**53
    assert sorted(map(tuple, got), key=repr) == brute(rows, 100)
    with pytest.raises(ValueError, match="64 bits"):
        topk.topk(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), F.lit(True))


def test_pivots_rule_out_what_is_far():
    """In clustered vectors most candidates are never scored, and the results are those of a full search."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16)) * 3000
    c = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 16)) * 60)
    pivots = topk.farthest(c[:500], 32)
    scored = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal scored
            scored += len(self)
            return np.asarray(self) @ np.asarray(other)

    table, norms = topk.distances(c, pivots), (c * c).sum(1)
    for a in range(0, 4000, 100):
        got = topk.visit((c[a], norms[a], table[a]), (c.view(Counted), norms, table, np.arange(4000)), 10, float("-inf"), a)
        full = c @ c[a]
        full[a] = -np.inf
        assert [int(p) for p, _ in got] == np.lexsort((np.arange(4000), -full))[:10].tolist()
    assert scored < 40 * 4000 / 3


def test_bounds_hold():
    r = np.random.default_rng(4)
    c = np.floor(r.normal(size=(300, 8)) * 1000)
    table = topk.distances(c, topk.farthest(c, 12))
    low = np.abs(table[:, None] - table[None]).max(2)
    assert (low <= topk.distances(c, c) + 1e-6).all()
