"""The stored index against plain BM25, over increments and merges; names by automaton; words once a text."""

import collections
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlake.functions import text as T
from chatlake.operators import graph, index, models
from chatlake.sources.fixtures import view
from chatlake.sources.tables import new_path

from .conftest import SF


def plain_bm25(docs, queries, terms_of, most):
    """(query, rank) -> (id, score), and matches of each query."""
    words = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, text in queries:
        scores = collections.Counter()
        for term, boost in terms_of[q]:
            holding = {i: ws.count(term) for i, ws in words.items() if term in ws}
            idf = math.log(1 + (len(words) - len(holding) + 0.5) / (len(holding) + 0.5))
            for i, tf in holding.items():
                scores[i] += boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        best = sorted(((-round(s, 4), i) for i, s in scores.items()))[:most]
        out |= {(q, r + 1): (i, -s, len(scores)) for r, (s, i) in enumerate(best)}
    return out


def corpus(seed=1, n=700):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["longestwords", "rarest"]
    weights = [1 / (i + 1) for i in range(120)] + [0.02, 0.002]
    return [(i, " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(n)]


def asked(spark, docs, most, found):
    queries = [(1, "w3 rarest w60"), (2, "longestwords w0"), (3, "nowhere"), (4, "w1 w2 w5 w8 w13 w90 w91")]
    df = spark.createDataFrame(queries, "query_id long, query_text string")
    terms = {q: [(t.term, t.boost) for t in row] for q, row in df.select("query_id", T.bm25_terms(F.col("query_text"))).collect()}
    want = plain_bm25(docs, queries, terms, most)
    got = {(x.query_id, x["rank"]): (x.id, x.score, x.total_matches) for x in found(df).collect()}
    assert got.keys() == want.keys()
    for k, (i, s, n) in want.items():
        assert got[k][0] == i and math.isclose(got[k][1], s, abs_tol=1e-4) and got[k][2] == n


DOC = "id long, content string"


@pytest.mark.parametrize("first", [1, 1000])
def test_search_equals_plain_bm25(spark, first):
    docs = corpus()
    df = spark.createDataFrame(docs, DOC)
    asked(spark, docs, 7, lambda q: index.search_texts(df, q, 7))
    stored = index.write_index(df, new_path(spark, "index"))
    asked(spark, docs, 7, lambda q: index.search(stored, q, 7, first))


def test_increments_and_merge(spark):
    """New texts, texts replaced once and twice, then all in one piece."""
    docs, path = dict(corpus()), new_path(spark, "index")
    frame = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], DOC)
    kept = [i for i in docs if i < 400]
    index.write_index(frame(kept), path)
    docs |= {i: t for (i, _), (_, t) in zip(corpus()[:90], corpus(5)[:90])}  # 0 to 89 are replaced
    kept = [*range(90), *range(400, 600)]
    index.append(frame(kept), path)
    docs |= {i: t for (i, _), (_, t) in zip(corpus()[30:50], corpus(9)[30:50])}
    stored = index.append(frame([*range(30, 50), *range(600, 700)]), path)
    whole = sorted(docs.items())
    asked(spark, whole, 9, lambda q: index.search(stored, q, 9))
    merged = index.merge(spark, path, to := new_path(spark, "merged"))
    asked(spark, whole, 9, lambda q: index.search(merged, q, 9))
    assert merged.where("bucket >= 0").count() <= stored.where("bucket >= 0").count()
    # and it grows on
    docs |= {3: "rarest w3 w3", 1000: "longestwords again"}
    asked(spark, sorted(docs.items()), 9, lambda q: index.search(index.append(frame([3, 1000]), to), q, 9))


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    q = spark.createDataFrame([(1, "w1"), (2, None)], "query_id long, query_text string")
    assert index.search_texts(none, q, 3).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w1"), (3, "w1 again"), (None, "w1")], DOC)
    got = [(x.id, x["rank"]) for x in index.search_texts(odd, q, 5).collect()]
    assert sorted(r for _, r in got) == [1, 2, 3] and sorted((i or 0) for i, _ in got) == [0, 3, 3]


def test_a_search_opens_its_terms_buckets(spark):
    path = new_path(spark, "index")
    stored = index.write_index(view(spark, SF, "posts").select("id", "content"), path)
    local = path.removeprefix("file://")
    size = lambda b: sum(os.path.getsize(f"{local}/{b}/{x}") for x in os.listdir(f"{local}/{b}"))
    folders = [x for x in os.listdir(local) if x.startswith("bucket=") and x >= "bucket=0"]
    one = stored.where("bucket = 5 and term = 'the'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,the)" in plan
    assert size("bucket=5") < 0.1 * sum(map(size, folders))
    # a row is a term in 64 documents, and not one in a document
    pairs = view(spark, SF, "posts").select("id", F.explode(F.array_distinct(T.terms(F.col("content")))).alias("w")).count()
    rows = stored.where("bucket >= 0")
    assert rows.agg(F.sum(F.bit_count("mask"))).first()[0] == pairs > rows.count()


def test_bounds_hold(spark):
    """No hit gains more than its block says, whatever the mean length."""
    rows = index.write_index(spark.createDataFrame(corpus(), DOC), new_path(spark, "index")).where("bucket >= 0")
    each = rows.select("max_tf", "min_dl", F.inline("hits"))
    for mean in (1.0, 30.0, 900.0):
        g = lambda tf, dl: index.gain(F.lit(1.0), F.col(tf), F.col(dl), mean)
        assert each.where(g("tf", "dl") > g("max_tf", "min_dl") + 1e-12).count() == 0


def test_names_in_shards(spark):
    names = spark.createDataFrame([(x,) for x in ["Ada", "ADA", "Ada Byron", "on", "ßtraße", "yron, of", "Ünder", None]], "name string")
    texts = spark.createDataFrame([(1, "ada byron, of Ovada"), (2, None), (3, ""), (4, "STRASSE ßTRASSE ünder"), (1, "ADA BYRON")], "id long, content string")
    want = {(r.id, r.name) for r in texts.crossJoin(names).where("contains(lower(content), lower(name)) and char_length(name) >= 3").collect()}
    for most_bytes in (10, 2_000_000):
        assert {(r.id, r.name) for r in graph.entities_in_text(texts, names, most_bytes=most_bytes).collect()} == want and len(want) >= 4
    assert graph.entities_in_text(texts, names.limit(0)).count() == 0


def test_texts_are_tokenised_once(spark):
    hits = view(spark, SF, "posts").select("id", "content", F.lit(1.0).alias("score"), F.lit(1).alias("query_id"))
    q = view(spark, SF, "queries").withColumn("query_id", F.lit(1))
    plan = models.rerank(hits, q, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(content") == 1 and not re.search(r"lambdafunction\([^)]*regexp_extract_all", plan)


# ---- motifs and communities

def test_motifs(spark):
    rows = [(1, "a", "b", "T"), (1, "b", "c", "T"), (1, "c", "d", "T"), (1, "d", "a", "U"), (1, "e", "e", "T"), (2, "a", "z", "T"), (1, "a", "b", "U")]
    r = spark.createDataFrame(rows, "domain_id long, source string, target string, type string")
    names = lambda df, *c: sorted(tuple(x) for x in df.select("domain_id", *c).collect())
    assert names(graph.find(r, [("x", "T*2..3", "y")]), "x", "y") == [(1, "a", "c"), (1, "a", "d"), (1, "b", "d"), (1, "e", "e")]
    assert names(graph.find(r, [("x", "*1..9", "y")]), "x", "y") == sorted([(1, x, y) for x in "abcd" for y in "abcd"] + [(1, "e", "e"), (2, "a", "z")])
    assert names(graph.find(r, [("x", "T", "x")]), "x") == [(1, "e")]
    assert names(graph.find(r, [("x", "T", "y"), ("z", "U", "w"), ("y", "T", "z")]), "x", "y", "z", "w") == [(1, "b", "c", "d", "a")]
    assert names(graph.find(r, [("x", "T", "y"), ("y", "T", "z"), ("z", "T*1..2", "w"), ("w", "U", "x")]), "x", "y", "z", "w") == [(1, "a", "b", "c", "d")]
    with pytest.raises(ValueError, match="shares no name"):
        graph.find(r, [("x", "T", "y"), ("v", "U", "w")])
    assert graph.find(r, [("x", "T", "y"), ("v", "U", "w")], product=True).count() == 8
    assert graph.find(r.limit(0), [("x", "*2..3", "y")]).count() == 0


def test_motifs_are_reduced_from_the_leaves(spark):
    """A hub with a thousand relations of which one leads on: the first join already has that one alone."""
    rows = [(1, f"s{i}", "hub", "T") for i in range(1000)] + [(1, "s7", "x", "U")]
    r = spark.createDataFrame(rows, "domain_id long, source string, target string, type string")
    got = graph.find(r, [("p", "T", "h"), ("q", "T", "h"), ("p", "U", "x"), ("q", "U", "x")])
    assert [tuple(x) for x in got.select("p", "q", "h", "x").collect()] == [("s7", "s7", "hub", "x")]


def test_communities_are_connected(spark):
    r = random.Random(3)
    edges = {(min(a, b), max(a, b)) for _ in range(260) for a, b in [(r.randrange(90), r.randrange(90))] if a != b}
    df = spark.createDataFrame([(1, f"n{a:02}", f"n{b:02}", "T") for a, b in edges], "domain_id long, source string, target string, type string")
    groups = collections.defaultdict(set)
    for x in graph.communities(df, 1).collect():
        groups[x.community_id].add(x.name)
    near = collections.defaultdict(set)
    for a, b in edges:
        near[f"n{a:02}"].add(f"n{b:02}")
        near[f"n{b:02}"].add(f"n{a:02}")
    for group in groups.values():
        seen, todo = set(), [min(group)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x] & group
        assert seen == group
    # and a community that fell apart is cut
    labels = spark.createDataFrame([(1, f"n{i:02}", "n00") for i in range(90)], "domain_id long, a string, c string")
    both = spark.createDataFrame([(1, a, b, 1.0) for a, bs in near.items() for b in bs if (a < "n40") == (b < "n40")], "domain_id long, a string, b string, w double")
    parts = {(x.a < "n40", x.c) for x in graph.refined(both, labels).collect()}
    assert len({c for _, c in parts}) == len(parts) >= 2


@pytest.mark.parametrize("most", [1, 6, 900])
def test_texts_are_scanned_once_and_keep_ties(spark, monkeypatch, most):
    """Without a stored index no blocks are made and no postings are shuffled; of equal texts, in whatever order, the smallest ids are kept."""
    r = random.Random(3)
    docs = corpus(n=1300) + [(2000 + i, "w3 rarest w60 longestwords") for i in range(700)]
    r.shuffle(docs)
    df = spark.createDataFrame([*docs, (5000, None)], DOC).coalesce(2)
    queries = spark.createDataFrame([(1, "w3 rarest w60"), (2, "longestwords w0"), (4, "w1 w2 w5 w8 w13 w90 w91")], "query_id long, query_text string")
    rows = lambda x: sorted((y.query_id, y["rank"], y.id, y.score, y.total_matches) for y in x.collect())
    blocks = rows(index.search(index.write_index(df, new_path(spark, "index")), queries, most))
    monkeypatch.setattr(index, "block_rows", lambda *_: pytest.fail("blocks were made"))
    got = rows(index.search_texts(df, queries, most))
    assert got == blocks and [x[2] for x in got[:most]][:600] == list(range(2000, 2000 + min(most, 600)))


def test_many_queries_are_answered_by_blocks(spark):
    df = spark.createDataFrame(corpus(n=200), DOC)
    queries = spark.createDataFrame([(1, "w3 rarest w60"), (2, "longestwords w0")], "query_id long, query_text string")
    rows = lambda x: sorted((y.query_id, y["rank"], y.id, y.score, y.total_matches) for y in x.collect())
    assert rows(index.search_texts(df, queries, 5)) == rows(index.search_texts(df, queries, 5, cells=3))


def test_a_stored_index_is_read_once_for_few_queries(spark, monkeypatch):
    """Counts by range, without bounds and second reads of the blocks; the same rows as by bounds, also of replaced and lost texts."""
    path = new_path(spark, "index")
    index.write_index(spark.createDataFrame([*corpus(n=300), (4000, None)], DOC), path)
    stored = index.append(spark.createDataFrame([*corpus(5, 90), (3, None), (None, "rarest w0"), (4000, "w0 " * 300)], DOC), path)
    queries = spark.createDataFrame([(1, "w3 rarest w60"), (2, "longestwords w0"), (3, "nowhere"), (4, " ".join(f"w{i}" for i in range(119)))], "query_id long, query_text string")
    rows = lambda x: sorted((y.query_id, y["rank"], y.id or -1, y.score, y.total_matches) for y in x.collect())
    bounds = rows(index.search(stored, queries, 8, first=1, cells=0))
    made, written = [], index.written
    monkeypatch.setattr(index, "written", lambda df, name: (made.append(name), written(df, name))[1])
    assert rows(index.search(stored, queries, 8)) == bounds and len(bounds) == 24
    assert made == ["index-terms", "index-counts", "index-found"]
