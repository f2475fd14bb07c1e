"""Block-at-a-time top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk
from lodestone.llm.topk import Queries, build_index, kth_best, products, search_shard, top_k, usable

SCHEMA = "vec_id long, embedding array<float>, label int, score string, dim string"


def brute(rows, asked, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if asked(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])}
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, v, None, "s", "d") for i, v in rows], SCHEMA)


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    v = centres[rng.integers(0, 8, n)] + 0.2 * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in row / np.linalg.norm(row)]) for i, row in enumerate(v)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEED_ROWS", 50)
    rows = clustered(1500)
    rows += [(1500 + i, v) for i, v in rows[:40]]  # ties
    df = make(spark, rows)
    got = {tuple(r) for r in top_k(df, df.filter("vec_id % 100 = 0"), 10).collect()}
    assert got == brute(rows, lambda i: i % 100 == 0, 10)
    monkeypatch.setattr(topk, "QUERY_BYTES", 16 * 8 * 4)  # several batches
    assert {tuple(r) for r in top_k(df, df.filter("vec_id % 100 = 0"), 10).collect()} == got


def test_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-0.0004, 1.0]), (6, [0.0, 0.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [2.0, 3.0, 1.0])]
    df = make(spark, rows)
    got = {tuple(r) for r in top_k(df, df.filter("vec_id % 100 = 0"), 10).collect()}
    assert got == brute(rows, lambda i: i % 100 == 0, 10) and len(got) == 3
    assert top_k(df.limit(0), df, 3).count() == 0 and top_k(df, df.limit(0), 3).count() == 0
    same = make(spark, [(0, [1.0, 1.0])] * 3 + [(9, [1.0, 1.0])] * 3)
    assert [tuple(r) for r in top_k(same, same.filter("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1, 9, 2097152), (0, 2, 9, 2097152)]


def test_pruning_skips_blocks_and_stays_exact(spark):
    rows = clustered(4000, seed=3)
    shards = build_index(usable(make(spark, rows), "vec_id", "embedding").coalesce(1)).collect()
    ids = np.arange(0, 4000, 100)
    full = np.array([[math.floor(1024 * float(np.float32(x))) for x in v] for _, v in rows], np.int64)
    q = Queries(ids, full[ids], kth_best(full[ids], ids, full[:500], np.arange(500), 10))
    scored = possible = 0
    for s in shards:
        parts = [np.frombuffer(x, "<i4").reshape(-1, 16).astype(np.int64) for x in (s.forward, s.high, s.low)]
        *_, visited = search_shard(q, np.frombuffer(s.ids, "<i8"), *parts, 10)
        scored += visited
        possible += len(ids) * len(parts[1])
    assert scored < 0.7 * possible


def test_products_are_exact():
    rng = random.Random(2)
    for bits in (10, 28):
        a = np.array([[rng.getrandbits(bits) - (1 << bits - 1) for _ in range(5)] for _ in range(4)], np.int64)
        assert products(a, a).tolist() == [[sum(x * y for x, y in zip(r, s)) for s in a.tolist()] for r in a.tolist()]
    assert products(np.array([[1 << 40, 3]]), np.array([[1 << 40, 5]])).tolist() == [[(1 << 80) + 15]]
    least = np.iinfo(np.int64).min
    assert products(np.array([[least]]), np.array([[1]])).tolist() == [[least]]


@pytest.mark.parametrize("seed_rows", [3, 2048])
def test_every_finite_component(spark, monkeypatch, seed_rows):
    """Components of up to 3.4e38 beside small ones: ranked by exact products, scores beyond a long come back as the nearest long."""
    monkeypatch.setattr(topk, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(8)
    sizes = [1.0, 1e10, 3e38, 1e-30, 2e15, 0.0]
    rows = [(i, [rng.choice(sizes) * rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(60, [3.4028234663852886e38] * 3), (61, [-3.4028234663852886e38] * 3), (62, [3.4028234663852886e38] * 3), (63, [1e10, 1.0, 1.0])]
    df = make(spark, rows)
    got = {tuple(r) for r in top_k(df, df.filter("vec_id % 20 = 0"), 10).collect()}
    nearest = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    assert got == {(q, r, v, nearest(x)) for q, r, v, x in brute(rows, lambda i: i % 20 == 0, 10)} and len(got) == 40


def test_quantisation(spark):
    got = usable(make(spark, [(1, [0.9999, -0.0001, -1.0])]), "vec_id", "embedding").first().vec
    assert got == [1023, -1, -1024]
