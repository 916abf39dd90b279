"""Operators 8 and 10 against brute force over all pairs."""

import numpy as np
import pytest

from metaloom.llm import egojoin, topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n, d, seed, lengths=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.exponential(size=(n, 1)) if lengths else 1)
    x[n // 2 :: 7] = x[: len(x[n // 2 :: 7])]  # repeated vectors
    return x.astype(np.float32)


@pytest.mark.parametrize("n,d,k,block,span", [(150, 12, 5, 32, 1 << 20), (150, 12, 5, 32, 4096), (40, 3, 60, 16, 1 << 20), (120, 33, 1, 50, 8192)])
def test_top_k_is_exact(spark, n, d, k, block, span):
    x = vectors(n, d, k)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in topk.neighbours(df, k, block_rows=block, range_bytes=span).collect():
        got[r.vec_id, r["rank"]] = (r.neighbor_id, r.inner_product)
    p = x.astype(np.float64) @ x.astype(np.float64).T
    for i in range(n):
        others = sorted(((-p[i, j], j) for j in range(n) if j != i))[:k]
        mine = [got[i, r + 1] for r in range(len(others))]
        assert np.allclose([v for _, v in mine], [-a for a, _ in others], atol=2e-6)
        assert {j for j, _ in mine} == {j for _, j in others} or len({round(a, 9) for a, _ in others}) < len(others) or np.isclose(others[-1][0], sorted(-p[i])[k] if k < n - 1 else 0, atol=1e-9)
    assert len(got) == n * min(k, n - 1)


def test_blocks_of_short_vectors_are_skipped():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x *= np.geomspace(100, 0.01, 400)[:, None].astype(np.float32) / np.linalg.norm(x, axis=1, keepdims=True)
    q = topk.Queries(np.arange(100), x[:100], np.eye(8), 3)
    assert q.meet(np.arange(100), x[:100], np.eye(8))
    assert not q.meet(np.arange(300, 400), x[300:], np.eye(8))


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0], 0), (3, None, 0), (4, [float("nan"), 1.0], 0), (None, [1.0, 1.0], 0), (5, [], 0), (6, [0.5, None], 0), (7, [1.0, 0.01], 0), (8, [float("inf")], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS block")
    got = topk.neighbours(df, 2).collect()
    assert {r.vec_id for r in got} == {1, 2, 5, 7}
    assert [(r.neighbor_id, r.inner_product) for r in sorted(got, key=lambda r: r["rank"]) if r.vec_id == 1] == [(2, 1.0), (7, 1.0)]
    near = {r.vec_id: (r.class_id, r.links) for r in egojoin.near_duplicates(df, 0.1).collect()}
    assert near == {1: (1, 2), 2: (1, 2), 5: (5, 0), 7: (1, 2)}
    none = spark.createDataFrame([], SCHEMA)
    assert topk.neighbours(none).collect() == [] and egojoin.near_duplicates(none).collect() == []


@pytest.mark.parametrize("n,d,radius,block,seed", [(300, 2, 0.1, 40, 1), (300, 6, 0.8, 64, 2), (200, 20, 3.0, 300, 3)])
def test_near_duplicates_are_all_pairs(spark, monkeypatch, n, d, radius, block, seed):
    monkeypatch.setattr(egojoin, "SHORT", 16)
    x = vectors(n, d, seed, lengths=False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: (r.class_id, r.links) for r in egojoin.near_duplicates(df, radius, block_rows=block).collect()}
    dist = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(-1)) <= radius
    root = list(range(n))
    for _ in range(n):  # least labels along links, until nothing changes
        root = [min(root[j] for j in np.flatnonzero(dist[i])) for i in range(n)]
    assert got == {i: (root[i], int(dist[i].sum()) - 1) for i in range(n)} and any(links for _, links in got.values())
