"""Retrieval over texts: postings, BM25, fallbacks, fusion and merging of hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import message_link
from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import written
from .graph import entities_in_text
from .index import _BM25, _POSTINGS, _TERMS, BM25_SQL, MOST_TERMS, query_terms, search_texts
from .tables import top_per_key


def postings(docs: DataFrame, stem=lambda c: c) -> DataFrame:
    """(id, term, tf, dl); stem: a column function on the array of terms."""
    words = docs.select("id", stem(T.terms(F.col("content"))).alias("ws")).withColumn("dl", F.size("ws").cast("long"))
    return words.select("id", "dl", F.explode("ws").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


@query("f5_postings", cte("posts") + _POSTINGS + " SELECT id, term, tf, dl FROM post")
def f5(spark, sf_dir):
    return postings(view(spark, sf_dir, "posts")).select("id", "term", "tf", "dl")


def bm25_search(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, rank, total_matches): OR-search of many queries at once, of texts without a stored index."""
    return search_texts(docs, queries, most)


@query("r1_bm25_search", BM25_SQL + " SELECT query_id, id, score, rank, total_matches FROM bm WHERE rank <= 10")
def r1(spark, sf_dir):
    return bm25_search(view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries"), 10)


@query("k1_topk_score", cte("posts") + " SELECT id, length(content) AS score FROM posts ORDER BY score DESC, id LIMIT 25")
def k1(spark, sf_dir):
    return topk_score(view(spark, sf_dir, "posts").select("id", F.char_length("content").cast("long").alias("score")), 25)


def topk_score(hits: DataFrame, most: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "id").limit(most)


def fts_fallback(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, level, score): any-term match ranked by sum of tf / dl, or, where a query has none, substrings with score 1."""
    q = written(query_terms(queries), "fallback-terms")
    wanted = [r.term for r in q.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    # this file's postings, only those of query terms: others are dropped before they are rows, or where there are many terms by the join
    words = docs.select("id", T.terms(F.col("content")).alias("ws")).select("id", F.size("ws").cast("double").alias("dl"), (F.filter("ws", lambda w: w.isin(wanted)) if len(wanted) <= MOST_TERMS else F.col("ws")).alias("ws"))
    tf = words.select("id", "dl", F.explode("ws").alias("term")).join(q, "term").groupBy("query_id", "id").agg(F.round(F.count("*") / F.max("dl"), 6).alias("score"))
    # each query's best are written once: they also say which queries have an answer
    level2 = written(top_per_key(tf, ["query_id"], most, F.desc("score"), F.col("id")).select("query_id", "id", "score", F.lit(2).alias("level")), "fallback-hits")
    open_terms = q.join(level2.select("query_id").distinct(), "query_id", "left_anti")
    # the terms of queries without an answer, as parts of words
    found = entities_in_text(docs, open_terms.select(F.col("term").alias("name")), 1).withColumnRenamed("name", "term")
    level3 = found.join(open_terms, "term").select("query_id", "id").distinct().select("query_id", "id", F.lit(1.0).alias("score"), F.lit(3).alias("level"))
    return top_per_key(level2.unionByName(level3), ["query_id"], most, F.desc("score"), F.col("id"))


_QPART = cte("posts", "queries").replace("AS query_text FROM benchmark", "AS query_text FROM benchmark UNION ALL SELECT -1, 'entio'")


@query("r2_fts_fallback", _QPART + _POSTINGS + _TERMS + ", l2 AS (SELECT query_id, id, 2 AS level, round(sum(tf)::DOUBLE / max(dl), 6) AS score FROM post JOIN qt USING (term) GROUP BY 1, 2), l3 AS (SELECT DISTINCT query_id, id, 3 AS level, 1.0::DOUBLE AS score FROM qt JOIN posts ON contains(lower(content), term) WHERE query_id NOT IN (SELECT query_id FROM l2)), u AS (SELECT * FROM l2 UNION ALL SELECT * FROM l3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u) SELECT query_id, id, level, score FROM r WHERE rank <= 10")
def r2(spark, sf_dir):
    q = view(spark, sf_dir, "queries")
    more = q.limit(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("entio").alias("query_text"))
    return fts_fallback(view(spark, sf_dir, "posts"), q.unionByName(more), 10).select("query_id", "id", "level", "score")


def rank_lists(hits: DataFrame) -> DataFrame:
    """1-based rank of each hit in each retriever's list of each query."""
    w = W.partitionBy("query_id", "retriever").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long"))


def rrf(ranked: DataFrame, most: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the lists of each query."""
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return top_per_key(fused, ["query_id"], most, F.desc("score"), F.col("id"))


def merge_hits(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of the retrievers' lists in order; of equal (query, id) the first list's hit stays."""
    union = None
    for order, (name, df) in enumerate(lists):
        part = df.select("query_id", "id", "rank", "score").withColumn("src_order", F.lit(order)).withColumn("retriever", F.lit(name))
        union = part if union is None else union.unionByName(part)
    return top_per_key(union.withColumnRenamed("rank", "src_rank"), ["query_id", "id"], 1, F.col("src_order"), F.col("src_rank")).drop("rank")


def dedup_prefix(hits: DataFrame, chars: int = 200) -> DataFrame:
    """Hits of each query without a repeated id or a repeated beginning, by rank."""
    first = top_per_key(hits.withColumnRenamed("rank", "hit_rank"), ["query_id", "id"], 1, F.col("hit_rank")).drop("rank")
    keyed = first.withColumn("_prefix", F.substring("content", 1, chars))
    return top_per_key(keyed, ["query_id", "_prefix"], 1, F.col("hit_rank"), F.col("id")).drop("rank", "_prefix")


@query("d2_dedup_prefix", cte("posts") + ", h AS (SELECT domain_id AS query_id, id, row_number() OVER (PARTITION BY domain_id ORDER BY id) AS hit_rank, content FROM posts), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(content, 1, 200) ORDER BY hit_rank, id) AS rn FROM h) SELECT query_id, id, hit_rank FROM p WHERE rn = 1")
def d2(spark, sf_dir):
    w = W.partitionBy("domain_id").orderBy("id")
    h = view(spark, sf_dir, "posts").select(F.col("domain_id").alias("query_id"), "id", F.row_number().over(w).cast("long").alias("rank"), "content")
    return dedup_prefix(h.unionByName(h)).select("query_id", "id", "hit_rank")


def source_links(hits: DataFrame, user: Column, most: int) -> DataFrame:
    """One link per message in rank order, at most so many per query."""
    once = top_per_key(hits.withColumn("_r", F.col("rank")).drop("rank"), ["query_id", "id"], 1, F.col("_r")).drop("rank")
    return top_per_key(once, ["query_id"], most, F.col("_r"), F.col("id")).select("query_id", "id", "rank", message_link(user, F.col("id")).alias("link"))


@query("d6_source_links", BM25_SQL + ", l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS rank FROM bm WHERE rank <= 20) SELECT query_id, id, rank, 'https://t.me/chan' || (id % 20) || '/' || id AS link FROM l WHERE rank <= 5")
def d6(spark, sf_dir):
    hits = bm25_search(view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries"), 20)
    return source_links(hits, F.concat(F.lit("chan"), F.col("id") % 20), 5)


def hits_with_domain(hits: DataFrame, domains: DataFrame) -> DataFrame:
    """Channel name and source link of each hit."""
    d = domains.select("domain_id", "channel_username")
    return hits.join(d, "domain_id", "left").withColumn("link", message_link(F.col("channel_username"), F.col("id")))


@query("j10_hits_with_domain", cte("posts", "domains") + " SELECT id, channel_username, CASE WHEN channel_username IS NULL THEN '' ELSE 'https://t.me/' || channel_username || '/' || id END AS link FROM posts LEFT JOIN domains USING (domain_id)")
def j10(spark, sf_dir):
    return hits_with_domain(view(spark, sf_dir, "posts"), view(spark, sf_dir, "domains")).select("id", "channel_username", "link")


def relevance_gate(hits: DataFrame, high: float, low: float, top: int = 3, queries: DataFrame | None = None, model=None) -> DataFrame:
    """Labels each query's top hits; reformulate if two or more are low; low ones go unless all would.

    The label is a pair model's (a string for "query, blank line, text"), or where there is none, or it fails, the score's.
    """
    label = F.when(F.col("score") >= high, "high").when(F.col("score") >= low, "medium").otherwise("low")
    if model is not None:
        from .models import judged_pairs

        said = judged_pairs(hits.where(F.col("rank") <= top), queries, model).select("query_id", "id", F.lower(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).alias("_said"))
        hits = hits.join(said, ["query_id", "id"], "left")
        label = F.when(F.col("_said").isin("high", "medium", "low"), F.col("_said")).otherwise(label)
    w = W.partitionBy("query_id")
    labelled = hits.withColumn("relevance", F.when(F.col("rank") <= top, label))
    n_low = F.count_if(F.col("relevance") == "low").over(w)
    left = F.count_if(F.coalesce(F.col("relevance") != "low", F.lit(True))).over(w)
    out = labelled.withColumn("reformulate", n_low >= 2).withColumn("_left", left)
    return out.where((F.coalesce(F.col("relevance"), F.lit("")) != "low") | (F.col("_left") == 0)).drop("_left", "_said")


@query("r9_relevance_gate", BM25_SQL + ", h AS (SELECT query_id, id, rank, CASE WHEN rank <= 3 THEN CASE WHEN score >= 12 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END END AS relevance FROM bm WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 3 ELSE 10 END), c AS (SELECT *, count(*) FILTER (WHERE relevance = 'low') OVER (PARTITION BY query_id) >= 2 AS reformulate, count(*) FILTER (WHERE coalesce(relevance <> 'low', true)) OVER (PARTITION BY query_id) AS n_left FROM h) SELECT query_id, id, relevance, reformulate FROM c WHERE coalesce(relevance, '') <> 'low' OR n_left = 0")
def r9(spark, sf_dir):
    hits = bm25_search(view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries"), 10).where("rank <= CASE WHEN query_id % 2 = 0 THEN 3 ELSE 10 END")
    return relevance_gate(hits, 12, 8).select("query_id", "id", "relevance", "reformulate")


def route_path(queries: DataFrame, fresh_summary: DataFrame, hits: DataFrame, many: int = 30) -> DataFrame:
    """overview (a fresh summary and an overview question), cascaded (many keyword hits), else standard."""
    n = hits.groupBy("query_id").agg(F.max("total_matches").alias("n_hits"))
    out = queries.join(fresh_summary.select("query_id", F.lit(True).alias("_fresh")), "query_id", "left").join(n, "query_id", "left")
    path = F.when(F.coalesce("_fresh", F.lit(False)) & T.is_overview(F.col("query_text")), "overview").when(F.coalesce("n_hits", F.lit(0)) > many, "cascaded").otherwise("standard")
    return out.select("query_id", path.alias("path"))


@query("r12_route_path", BM25_SQL + ", n AS (SELECT query_id, max(total_matches) AS n FROM bm GROUP BY 1) SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'overview' WHEN coalesce(n, 0) > 30 THEN 'cascaded' ELSE 'standard' END AS path FROM queries LEFT JOIN n USING (query_id)")
def r12(spark, sf_dir):
    q = view(spark, sf_dir, "queries")
    hits = bm25_search(view(spark, sf_dir, "posts"), q, 1)
    asked = q.withColumn("query_text", F.expr("CASE WHEN query_id % 5 = 0 THEN concat('summary of ', query_text) ELSE query_text END"))
    return route_path(asked, q.where("query_id % 5 < 3").select("query_id"), hits)
