"""The vector join against brute force: clusters, ties, odd rows, more queries than travel, and what it passes over."""

import numpy as np
import pytest

from tarn.operators import vecjoin, vector

KIND = "seq long, embedding array<double>"


def brute(rows, queries, k, digits=9):
    out = []
    for q, v in queries:
        if v is None or not np.isfinite(np.array(v, float)).all():
            continue
        fine = [(s, x) for s, x in rows if x is not None and len(x) == len(v) and all(c is not None and np.isfinite(c) for c in x)]
        near = sorted((np.floor(((np.array(x) - np.array(v)) ** 2).sum() * 10**digits + 0.5) / 10**digits, s) for s, x in fine)[:k]
        out += [(q, i, s, d) for i, (d, s) in enumerate(near, 1)]
    return sorted(out)


def clusters(n, d=8, seed=0):
    hearts = np.random.default_rng(7).normal(size=(20, d)) * 10
    rng = np.random.default_rng(seed)
    which = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 20, n))  # one cluster has a large part
    return [(i, (hearts[c] + rng.normal(size=d) * 0.1).tolist()) for i, c in enumerate(which)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vecjoin, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(vecjoin, "QUERY_BLOCK", 8)
    monkeypatch.setattr(vecjoin, "PIVOTS", 16)


def test_clusters(spark, small):
    rows = clusters(1500)
    queries = [(i + 10_000, v) for i, v in clusters(300, seed=1)[:150]] + [(i + 20_000, v) for i, v in rows[:50]]
    v, q = spark.createDataFrame(rows, KIND).repartition(4), spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(3)
    blocks = vecjoin.Blocks.of(v, pivots=32)
    assert sorted(map(tuple, blocks.top_k(q, 5).collect())) == brute(rows, queries, 5)
    share = blocks.passed_over(q, 5).first()
    assert share["pairs"] > 1000 and share["met"] < 0.35 * share["pairs"]


def test_odd_rows(spark, small):
    """Several dimensions, nulls, components that are no numbers, ties, groups of fewer than k rows."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(100, None), (101, []), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [1.0, 2.0, 3.0]), (105, [0.0, 0.0, 0.0]), (106, [50.0, 50.0])]
    queries = [(1, [0.0, 1.0]), (2, [50.0, 50.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0]), (5, None), (6, [float("inf"), 0.0])]
    v, q = spark.createDataFrame(rows, KIND), spark.createDataFrame(queries, "query_id long, embedding array<double>")
    want = brute(rows, queries, 4)
    assert sorted(map(tuple, vecjoin.Blocks.of(v).top_k(q, 4).collect())) == want
    assert vecjoin.Blocks.of(v.limit(0)).top_k(q, 4).collect() == [] and vecjoin.Blocks.of(v).top_k(q.limit(0), 4).collect() == []


def test_many_queries_are_joined(spark, small, monkeypatch):
    rows = clusters(300, seed=2)
    v = spark.createDataFrame(rows, KIND)
    q = v.withColumnRenamed("seq", "query_id")
    few = sorted(map(tuple, vector.top_k(v, q, 3, v["seq"] % 2 == 0).collect()))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 100)
    assert sorted(map(tuple, vector.top_k(v, q, 3, v["seq"] % 2 == 0).collect())) == few == brute(rows[::2], rows, 3)


def test_vectors_travel_once_a_shelf(spark, small, monkeypatch):
    """A vector block is sent once to a shelf of queries, whatever the number of groups; no list of a pair of blocks is sent."""
    monkeypatch.setattr(vecjoin, "SHELF", 64)
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(3).normal(size=(600, 16)).tolist())]
    v = spark.createDataFrame(rows, KIND).repartition(3)
    blocks = vecjoin.Blocks.of(v)
    sent = blocks.shelves(v.selectExpr("seq", "embedding v")).selectExpr("turn", "shelf", "size(ids) n").collect()
    shelves = {r.shelf for r in sent if r.turn == 0}
    assert len(shelves) > 4 and sum(r.n for r in sent if r.turn == 0) == 600
    assert sum(r.n for r in sent if r.turn) == 600 * len(shelves)
    assert sorted(map(tuple, blocks.top_k(v, 4, "seq").collect())) == brute(rows, rows, 4)
