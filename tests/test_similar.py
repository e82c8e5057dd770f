"""Candidates by sign bits: recall against all pairs, work, hot buckets; vector search without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.operators import similar, vectors
from chatlake.sources.fixtures import view

from .conftest import SF


def pairs_of(df):
    return {(r.batch, r.a, r.b) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.3, 0.35, 0.55, 0.92])
def test_recall_at_the_registered_thresholds(spark, monkeypatch, threshold):
    """The given vectors and a near copy of each; the plan of a large batch, whatever these few rows would ask for."""
    posts = similar.near_copies(spark, SF)
    want = pairs_of(similar.near_pairs(posts, threshold))
    plan = similar.sign_plan(threshold, 0.95, 1e6, 64)
    assert plan is not None
    monkeypatch.setattr(similar, "sign_plan", lambda *a, **k: plan)
    got = pairs_of(similar.sign_pairs(posts, threshold))
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_work_at_092(spark, monkeypatch):
    """Below half of all pairs are compared; of the planted copies nearly all are found."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(300, 64))
    side -= (side * base[:300]).sum(axis=1, keepdims=True) * base[:300]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    copies = 0.93 * base[:300] + np.sqrt(1 - 0.93**2) * side
    rows = [(0, i, x.tolist()) for i, x in enumerate(np.concatenate([base, copies]))]
    posts = spark.createDataFrame(rows, "batch long, id long, embedding array<double>")
    monkeypatch.setattr(similar, "FILING", 20)
    bits, probes, tables = similar.sign_plan(0.92, 0.95, 1800, 64)
    keys = []
    plain = similar._compared
    monkeypatch.setattr(similar, "_compared", lambda df, *a: keys.append(df) or plain(df, *a))
    got = pairs_of(similar.sign_pairs(posts, 0.92))
    assert {(0, i, 1500 + i) for i in range(300)} >= got and len(got) >= 0.9 * 300
    sizes = [r["count"] for r in keys[0].groupBy("bucket").count().collect()]
    assert sum(sizes) == 1800 * (1 + probes) * tables and sum(n * (n - 1) // 2 for n in sizes) < 0.5 * 1800 * 1799 / 2


def test_hot_buckets_and_batches(spark):
    """A bucket with most rows is split; batches never meet."""
    rng = np.random.default_rng(6)
    near = np.ones(16) + rng.normal(size=(90, 16)) * 0.01
    rows = [(i % 2, i, x.tolist()) for i, x in enumerate(np.concatenate([near, rng.normal(size=(30, 16))]))]
    rows += [(0, 500, None), (1, 501, [0.0] * 16)]
    posts = spark.createDataFrame(rows, "batch long, id long, embedding array<double>")
    want = pairs_of(similar.near_pairs(posts, 0.95))
    for size in (7, 2000):
        assert pairs_of(similar.near_pairs(posts, 0.95, size)) == want
    import unittest.mock as mock

    with mock.patch.object(similar, "sign_plan", lambda *a, **k: (6, 1, 6)):
        got = [pairs_of(similar.sign_pairs(posts, 0.95, size=size)) for size in (7, 2000)]
    assert got[0] == got[1] and len(got[0]) >= 0.95 * len(want) and got[0] <= want
    assert all((a - b) % 2 == 0 for _, a, b in want) and len(want) >= 2 * 45 * 44 // 2
    assert similar.sign_pairs(posts.limit(0), 0.95).count() == 0


def test_copies_go(spark):
    kept = {r.id for r in similar.d4c(spark, SF).where("kept").collect()}
    ids = {r.id for r in similar.near_copies(spark, SF).collect()}
    first = {i for i in ids if i >= 0}
    gone = {-i - 1 for i in ids - kept if i < 0}
    assert first <= kept | {i for i in first if i not in kept} and len(gone) >= 0.95 * len(first)
    assert all(i in kept for i in first)


def test_plan_grows_with_the_batch():
    plans = [similar.sign_plan(0.92, 0.95, n, 64) for n in (100, 1e4, 1e6, 1e8)]
    assert plans[0] is None and plans[1][0] < plans[2][0] < plans[3][0]


def test_search_shuffles_no_vector(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 8)))] + [(900, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(25, 8)))] + [(77, None)], "query_id long, q array<double>")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    one = vectors.vector_search(data, asked, 4)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(query_id" in plan
    assert rows(one) == rows(vectors.vector_search(data, asked, 4, query_bytes=100)) == rows(vectors.vector_search_in_blocks(data, asked, 4, size=20))
    assert vectors.vector_search(data, asked.limit(0), 4).count() == 0 == vectors.vector_search(data.limit(0), asked, 4).count()


def test_pruned_search_in_batches(spark, monkeypatch):
    v, q = view(spark, SF, "vectors"), view(spark, SF, "vectors").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    centroids, placed = vectors.cells(v, 8)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    whole = rows(vectors.vector_search_pruned(placed, centroids, q, 5, 3))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 8 * 64 * 20)
    assert rows(vectors.vector_search_pruned(placed, centroids, q, 5, 3)) == whole
    assert rows(vectors.vector_search_pruned(placed, centroids, q, 5, 8)) == rows(vectors.vector_search_in_blocks(v, q, 5))
