"""Clusters and verdicts of large batches in few rounds, and without pairs."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.operators import graph, similar, vectors


def posts_of(spark, n, spread, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=8)
    rows = [(i % 2, i, float(i % 5), (base + rng.normal(size=8) * spread).tolist()) for i in range(n)] + [(0, 9000, 9.0, None), (1, 9001, 9.0, [0.0] * 8)]
    return spark.createDataFrame(rows, "batch long, id long, score double, embedding array<double>")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture
def writes(monkeypatch):
    names, plain = [], similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: names.append(name) or plain(df, name))
    return names


@pytest.mark.parametrize("spread, listed", [(0.1, 1_000_000), (1.5, 1_000_000), (0.1, 400), (1.5, 400)])
def test_clusters_in_few_rounds(spark, monkeypatch, writes, spread, listed):
    """Also where a front's lists are cut off before they end."""
    monkeypatch.setattr(similar, "LISTED", listed)
    posts = posts_of(spark, 600, spread)
    columns = ("batch", "id", "cluster_id", "position")
    want = rows_of(similar.greedy_clusters(posts.where("id < 9000"), 0.5, 4), *columns)
    got = similar.clusters_in_blocks(posts, 0.5, 4, size=100)
    assert [r for r in rows_of(got, *columns) if r[1] < 9000] == want
    assert {(r.id, r.cluster_id) for r in got.where("id >= 9000").collect()} == {(9000, -1), (9001, -1)}
    assert len(writes) <= (20 if listed > 400 else 120)


@pytest.mark.parametrize("spread", [0.3, 2.0])
def test_dense_batches_list_no_pairs(spark, monkeypatch, spread):
    """Where kept posts remove much of a batch, its pairs are never listed; where they do not, only those of the undecided are."""
    listed, plain = [], similar.near_pairs
    monkeypatch.setattr(similar, "near_pairs", lambda posts, *a: listed.append(posts.count()) or plain(posts, *a))
    posts = posts_of(spark, 600, spread)
    for threshold in (0.5, 0.97):
        listed.clear()
        got = similar.dedup_in_blocks(posts, threshold, size=50)
        kept = [r for r in rows_of(got.where("kept"), "batch", "id") if r[1] < 9000]
        assert kept == rows_of(similar.dedup_semantic(posts.where("id < 9000"), threshold), "batch", "id") and got.count() == 602
        assert not listed if spread == 0.3 and threshold == 0.5 else sum(listed) < 602


def test_vectors_are_shuffled_as_they_are(spark, monkeypatch):
    """Of four bytes a number, not eight."""
    filed, plain = [], similar._compared
    monkeypatch.setattr(similar, "_compared", lambda rows, *a: filed.append(rows.schema["x"].dataType.simpleString()) or plain(rows, *a))
    posts = posts_of(spark, 60, 1.0).withColumn("embedding", F.col("embedding").cast("array<float>"))
    monkeypatch.setattr(similar, "sign_plan", lambda *a, **k: (3, 1, 4))
    assert similar.near_pairs(posts, 0.9).count() >= similar.sign_pairs(posts, 0.9).count()
    assert set(filed) == {"array<float>"}


def test_all_cosines_without_a_join(spark):
    """The values of the query's SQL also for null rows (0) and rows of zeros (NaN); queries in parts give the same rows."""
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=(40, 8)).astype(np.float32).tolist(), None, [0.0] * 8]
    v = spark.createDataFrame(list(enumerate(x)), "id long, embedding array<float>")
    q = v.where("id % 3 = 0 or id >= 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = vectors.all_cosines(v, q)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.id, r.query_id): r.cosine for r in got.collect()}
    assert len(rows) == 42 * 16 and rows[41, 40] == rows[40, 41] == 0.0 and np.isnan(rows[41, 0]) and np.isnan(rows[0, 41])
    u = np.array(x[:40], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert all(abs(rows[i, j] - u[i] @ u[j]) <= 5.1e-5 for i in range(40) for j in range(0, 40, 3))
    assert {(r.id, r.query_id): r.cosine for r in vectors.all_cosines(v.where("id < 40"), q.where("query_id < 40"), 300).collect()} == {k: c for k, c in rows.items() if max(k) < 40}


def test_hops_between_kinds_and_hot_keys(spark, monkeypatch):
    """Two hops in a dense graph take steps in the number of kinds; a join of few hot keys is dealt to more tasks than keys."""
    rel = spark.createDataFrame([(1, f"s{i}", f"p{j}", "r") for i in range(40) for j in range(10)] + [(1, "p0", "q", "r"), (1, "q", "q", "r"), (1, "s0", "s1", "r")], "domain_id long, source string, target string, type string")
    starts = spark.createDataFrame([(1, f"s{i}") for i in range(0, 40, 2)] + [(1, "p0"), (1, "none")], "domain_id long, name string")
    near = {}
    for r in rel.collect():
        if r.source != r.target:
            near.setdefault(r.source, set()).add(r.target)
            near.setdefault(r.target, set()).add(r.source)
    want = {(s.name, y) for s in starts.collect() for x in near.get(s.name, ()) for y in {x, *near[x]} if y != s.name}
    steps, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (lambda out: steps.append((name, out.count())) or out)(plain(df, name)))
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    got = graph.neighbors(rel, starts).select("start", "name").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert dict(steps)["neighbor-steps"] == 16
    star = rel.withColumn("type", F.when(F.col("source").startswith("s"), "A").otherwise("B"))
    found = graph.find(star, [("a", "A", "n"), ("c", "A", "n"), ("n", "B", "m")])
    rows = {(r.source, r.target, r.type) for r in star.collect()}
    assert sorted((r.a, r.c, r.n, r.m) for r in found.collect()) == sorted((a, c, n, m) for a, n, k in rows if k == "A" for c, n2, k2 in rows if k2 == "A" and n2 == n for n3, m, k3 in rows if k3 == "B" and n3 == n)
    assert "_part" in found._jdf.queryExecution().executedPlan().toString()


def test_many_by_many_copies_little(spark, monkeypatch):
    """A key's rows are copied along a grid: 400 by 400 rows in 64 parts take 8 copies a row, not 64 of one side. Nulls, repeated rows and keys of one row stay."""
    monkeypatch.setattr(graph, "TASK_ROWS", 2_500)
    shuffled, plain = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: shuffled.append(self) or plain(self, *a))
    side = lambda n, c: spark.createDataFrame([(1, f"{c}{i}") for i in range(n)] + [(2, "x"), (2, "x"), (2, None), (3, c), (None, c)] + [(4, f"{c}{i}") for i in range(n // 4 if c == "a" else 1)], f"k long, {c} string")
    left, right = side(400, "a"), side(400, "c")
    got = graph.multiplied(left, right, ["k"])
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, left.join(right, "k").collect()))
    assert sum(df.count() for df in shuffled) <= 2 * 8 * 400 + 200


def test_right_rows_of_a_part_are_bounded(spark, monkeypatch):
    """One left row meets 3,000 right rows of its key: they go to several parts, though the join makes few rows."""
    monkeypatch.setattr(graph, "TASK_ROWS", 3_000)
    monkeypatch.setattr(graph, "COLUMN_ROWS", 300, raising=False)
    parts, plain = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: parts.append(self) or plain(self, *a))
    got = graph.multiplied(spark.createDataFrame([(1, "a")], "k long, a string"), spark.range(3000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("c")), ["k"])
    assert sorted(r.c for r in got.collect()) == list(range(3000))
    assert max(r["count"] for df in parts for r in df.groupBy("_part").count().collect()) <= 400


def test_motif_steps_are_made_once(spark, monkeypatch):
    rel = spark.createDataFrame([(1, "a", "p", "A"), (1, "b", "p", "R"), (1, "c", "q", "A"), (1, "d", "q", "N")], "domain_id long, source string, target string, type string")
    plans, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    assert [tuple(r) for r in graph.find(rel, [("a", "A", "b"), ("c", "R", "b")]).select("a", "b", "c").collect()] == [("a", "p", "b")]
    assert sum("= R)" in p for p in plans) == 1
