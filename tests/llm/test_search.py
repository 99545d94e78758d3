import math
import random

import numpy as np
import pytest

from quillguard.llm import topk


def brute(vectors, queries, k):
    """Highest integer inner products of all usable pairs."""
    good = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, [])
            whole = [math.floor(1024 * x) for x in v]
            if whole not in good[i]:
                good[i].append(whole)
    out = []
    for q in sorted(set(queries) & set(good)):
        for a in good[q]:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, vs in good.items() if j != q for b in vs if len(a) == len(b))
            out += [(q, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, vectors, k=10, step=10):
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<double>, query_id int")
    got = topk.search(df, df.filter(f"vec_id % {step} = 0"), k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    random.seed(1)
    vectors = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    vectors += [(200 + i, vectors[5][1]) for i in range(60)] + [(1000 + i, [random.choice([0.0, 0.5]) for _ in range(6)]) for i in range(40)]
    assert run(spark, vectors) == brute(vectors, [i for i, _ in vectors if i % 10 == 0], 10)


def test_odd_rows(spark):
    vectors = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, []), (6, [1.0]), (7, [0.25, 0.25]), (7, [0.25, 0.25]), (None, [1.0, 1.0]), (10, [3.0])]
    assert run(spark, vectors) == brute(vectors, [0, 10], 10) == [(0, 1, 7, 256 * 1024 + 256 * 2048), (10, 1, 6, 3072 * 1024)]


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    low = rng.integers(-900, 900, (30, 8))
    high = low + rng.integers(0, 50, (30, 8))
    rows = rng.integers(low, high + 1)
    q = rng.integers(-1000, 1000, (5, 8))
    least, most = topk.bounds(q, low, high)
    assert ((least <= q @ rows.T) & (q @ rows.T <= most)).all()
