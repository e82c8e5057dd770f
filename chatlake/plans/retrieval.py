"""Whole retrieval plans for a batch of queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.clean import entity_type_hits, since
from ..operators.graph import entities_in_text, graph_enrich, graph_retrieve
from ..operators.models import Model, decisions, rerank
from ..operators.search import BM25_SQL, bm25_search, hits_with_domain, merge_hits, rank_lists, relevance_gate, rrf
from ..operators.tables import component_scores, top_per_key
from ..operators.vectors import cosine, hash_embed, vector_search
from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import written

#: Depth of a search: vector hits, reranked hits, context tokens, corrective rounds.
MODES = {"fast": (30, 10, 16_000, 0), "balanced": (50, 15, 32_000, 1), "deep": (100, 20, 48_000, 3)}


def corrective_loop(hits: DataFrame, docs: DataFrame, vectors: DataFrame, queries: DataFrame, variants: DataFrame, rounds: int, most: int, rerank_model: Model | None = None, gate_model: Model | None = None) -> DataFrame:
    """Gate, then for queries to reformulate search by the next variant of the query, rerank, and append what is new.

    variants: (query_id, turn, q), the vectors of a query's reformulations, turn 1 first; a query without one more stays as it is.
    """
    gate = lambda h: relevance_gate(h, 0.5, 0.2, queries=queries, model=gate_model)
    kept = gate(hits)
    for turn in range(1, rounds + 1):
        kept = written(kept, "gate")
        again = kept.where("reformulate").select("query_id").distinct()
        asked = variants.where(F.col("turn") == turn).select("query_id", "q").join(again, "query_id", "left_semi")
        if not asked.take(1):
            break
        more = vector_search(vectors, asked, most).select("query_id", "id", "score")
        fresh = more.join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti").join(docs.select("id", "content"), "id")
        scored = rerank(fresh, queries, most, rerank_model).drop("rank")
        both = kept.select("query_id", "id", "content", "score").unionByName(scored.select("query_id", "id", "content", "score"))
        kept = gate(top_per_key(both, ["query_id"], most, F.desc("score"), F.col("id")))
    return kept


def context_budget(parts: DataFrame, budget: int) -> DataFrame:
    """(query_id, part_no, text): parts in order until the tokens are used up; the part at the edge is cut after a whole token."""
    w = W.partitionBy("query_id").orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    out = parts.withColumn("tokens", T.count_tokens(F.col("text"))).withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    left = F.lit(budget) - F.col("before")
    cut = F.when(F.col("tokens") <= left, F.col("text")).otherwise(T.truncate_tokens(F.col("text"), left))
    return out.where(left > 0).withColumn("text", cut).select("query_id", "part_no", "text")


def hashtag_hits(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, rank): for each query the newest posts with one of its tags."""
    asked = queries.select("query_id", F.explode(T.hashtags(F.lower("query_text"))).alias("tag")).distinct()
    tagged = docs.where(F.contains("content", F.lit("#"))).select("id", "msg_date", F.explode(F.array_distinct(T.hashtags(F.lower("content")))).alias("tag"))
    found = tagged.join(asked, "tag").select("query_id", "id", "msg_date").distinct().withColumn("score", F.lit(1.0))
    return top_per_key(found, ["query_id"], most, F.desc("msg_date"), F.col("id"))


def standard_pipeline(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, entities: DataFrame, relations: DataFrame, mode: str = "balanced",
    domains: DataFrame | None = None, variants: DataFrame | None = None, memberships: DataFrame | None = None, summaries: DataFrame | None = None,
    types: list[str] | None = None, rerank_model: Model | None = None, gate_model: Model | None = None,
) -> DataFrame:
    """A row per query: hits with score, relevance and link, context text.

    Retrievers: tags, BM25 and vectors fused by rank, and the graph (the first vector hits; relations of entities that the query
    names). Context: number of hits, 5 community summaries, 30 relations, then the chunks, cut to the mode's tokens.
    """
    depth, most, budget, rounds = MODES[mode]
    near = written(vector_search(vectors, query_vectors, depth), "near")
    words = bm25_search(docs, queries, depth)
    listed = lambda df, name: df.select("query_id", "id", "score", F.lit(name).alias("retriever"))
    fused = rrf(rank_lists(listed(words, "keyword").unionByName(listed(near, "vector"))), depth)
    graph = graph_retrieve(queries, entities, relations, types=types, vector_hits=near)
    lists = [("hashtag", hashtag_hits(docs, queries, depth)), ("hybrid", fused), ("graph", graph["hits"])]
    merged = written(merge_hits(lists).select("query_id", "id", "score"), "merged")
    bodies = written(docs.join(merged.select("id").distinct(), "id", "left_semi").select("id", "domain_id", "content"), "bodies")
    hits = rerank(merged.join(bodies.select("id", "content"), "id"), queries, most, rerank_model)
    variants = queries.sparkSession.createDataFrame([], "query_id long, turn int, q array<double>") if variants is None else variants
    kept = written(corrective_loop(hits, docs, vectors, queries, variants, rounds, most, rerank_model, gate_model).select("query_id", "id", "content", "score", "relevance"), "kept")
    ranked = written(top_per_key(kept, ["query_id"], most, F.desc("score"), F.col("id")), "ranked")
    found, about = graph_enrich(ranked.where("rank <= 5"), entities, relations, types=types, memberships=memberships, summaries=summaries)
    edges = graph["relations"].select("query_id", "source", "target", "type").unionByName(found.select("query_id", "source", "target", "type")).distinct()
    numbered = lambda df, after, text: df.select("query_id", (F.col("rank") + after).alias("part_no"), text.alias("text"))
    parts = ranked.groupBy("query_id").agg(F.concat(F.lit("hits: "), F.count("*").cast("string")).alias("text")).select("query_id", F.lit(0).cast("long").alias("part_no"), "text")
    if about is not None:
        parts = parts.unionByName(numbered(top_per_key(about, ["query_id"], 5, F.col("community_id"), F.col("summary")), 1, F.col("summary")))
    parts = parts.unionByName(numbered(top_per_key(edges, ["query_id"], 30, F.col("source"), F.col("target"), F.col("type")), 10, F.concat_ws(" ", "source", "type", "target")))
    parts = parts.unionByName(numbered(ranked, 1000, F.col("content")))
    context = context_budget(parts, budget).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "text"))), lambda x: x["text"]), "\n").alias("context"))
    linked = ranked.join(docs.select("id", "domain_id"), "id")
    linked = hits_with_domain(linked, domains).select(*ranked.columns, "link") if domains is not None else ranked.withColumn("link", F.lit(""))
    payload = linked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "relevance", T.snippet(F.col("content"), 500).alias("snippet"), "link"))).alias("hits"))
    return queries.join(payload, "query_id", "left").join(context, "query_id", "left")


def _inputs(spark, sf_dir):
    return [view(spark, sf_dir, n) for n in ("posts", "vectors", "queries", "query_vectors", "entities", "relations")]


def _variants(query_vectors: DataFrame, vectors: DataFrame, turns: int = 3) -> DataFrame:
    """The fixtures' reformulations of a query: the vectors of the next ids."""
    each = query_vectors.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"))
    return each.join(vectors.select("id", F.col("embedding").alias("q")), F.col("query_id") + F.col("turn") == F.col("id")).select("query_id", "turn", "q")


def _standard(spark, sf_dir, mode: str = "balanced") -> DataFrame:
    docs, vectors, queries, query_vectors, entities, relations = _inputs(spark, sf_dir)
    tagged = queries.withColumn("query_text", F.expr("CASE WHEN query_id % 3 = 0 THEN concat(query_text, ' #part of supplier#000000001') ELSE query_text END"))
    mb = relations.select("domain_id", F.concat(F.lit("c"), "type").alias("community_id"), F.col("source").alias("name")).distinct()
    summaries = mb.select("domain_id", "community_id").distinct().withColumn("summary", F.concat(F.lit("summary "), "community_id"))
    domains = view(spark, sf_dir, "domains")
    return standard_pipeline(docs, vectors, tagged, query_vectors, entities, relations, mode, domains, _variants(query_vectors, vectors), mb, summaries, ["Vendor"])


@query("r14_standard_pipeline")
def r14(spark, sf_dir):
    return _standard(spark, sf_dir).select("query_id", F.size("hits").alias("n_hits"), F.char_length("context").alias("context_chars"), "hits")


@query("r10_corrective_loop")
def r10(spark, sf_dir):
    docs, vectors, queries, query_vectors, *_ = _inputs(spark, sf_dir)
    hits = rerank(bm25_search(docs, queries, 30).join(docs.select("id", "content"), "id"), queries, 10)
    return corrective_loop(hits, docs, vectors, queries, _variants(query_vectors, vectors), 3, 10).select("query_id", "id", "score", "relevance")


_PIECES = r"regexp_extract_all(content, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])')"


@query("w5_context_budget", cte("posts") + rf", p AS (SELECT domain_id AS query_id, row_number() OVER (PARTITION BY domain_id ORDER BY id) AS part_no, content, len({_PIECES}) AS tokens FROM posts), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT query_id, part_no, CASE WHEN tokens <= 2000 - before THEN content ELSE array_to_string(list_slice({_PIECES}, 1, CAST(2000 - before AS BIGINT)), '') END AS text FROM b WHERE before < 2000")
def w5(spark, sf_dir):
    w = W.partitionBy("domain_id").orderBy("id")
    parts = view(spark, sf_dir, "posts").select(F.col("domain_id").alias("query_id"), F.row_number().over(w).cast("long").alias("part_no"), F.col("content").alias("text"))
    return context_budget(parts, 2000)


def context_package(docs: DataFrame, messages: DataFrame, queries: DataFrame, as_of, most: int = 10, items: int = 20, model: Model | None = None) -> DataFrame:
    """A row per task: hits, decisions (the same for all tasks) and the number of sources."""
    hits = bm25_search(docs, queries, most).join(docs.select("id", "domain_id"), "id")
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"), F.count_distinct("domain_id").alias("n_sources"))
    best = decisions(messages, as_of, model=model).limit(items).agg(F.collect_list(F.struct("item_id", "type", "content")).alias("decisions"))
    return queries.join(found, "query_id", "left").join(F.broadcast(best))  # one row of `items` decisions at most


@query("r15_context_package")
def r15(spark, sf_dir):
    from ..operators.clean import now

    return context_package(view(spark, sf_dir, "posts"), view(spark, sf_dir, "messages"), view(spark, sf_dir, "queries"), now()).select("query_id", "n_sources", F.size("hits").alias("n_hits"), F.size("decisions").alias("n_decisions"))


def cascaded_analysis(docs: DataFrame, queries: DataFrame, types: DataFrame, domains: DataFrame, cutoff, model: Model | None = None) -> DataFrame:
    """A row per query: text, n_posts, output_budget, links. Up to 500 keyword hits after the cutoff, of these the ones that mention
    an entity type of the query (all, if none would be left), the best 200, map-reduce, and links to the first 10."""
    from .mapreduce import map_reduce

    recent = since(docs, cutoff)
    hits = bm25_search(recent, queries, 500).join(recent.select("id", "content", "domain_id"), "id")
    fits = written(entity_type_hits(hits, queries, types), "cascade-hits")
    best = top_per_key(fits.drop("rank"), ["query_id"], 200, F.desc("score"), F.col("id"))
    said = map_reduce(best.select(F.col("query_id").alias("key"), "id", "rank", "content"), model=model)
    first = hits_with_domain(best.where("rank <= 10"), domains)
    links = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "link"))), lambda x: x["link"]).alias("links"))
    return said.withColumnRenamed("key", "query_id").join(links, "query_id", "left")


@query("r13_cascaded_analysis")
def r13(spark, sf_dir):
    types = spark.createDataFrame([("thent", "stouhe eauxment"), ("america", "tionble")], "type string, description string")
    return cascaded_analysis(view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries"), types, view(spark, sf_dir, "domains"), F.expr("timestamp_ntz'2024-01-02 00:00:00'"))


def eval_metrics(answers: DataFrame, golden: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Scores of a run: token precision and recall of the context against the golden answer, the cosine of their embeddings, and with
    entities, the share of those that the golden answer names which the context names, too (null where it names none)."""
    words = lambda c: F.array_distinct(T.terms(F.coalesce(c, F.lit(""))))
    joined = golden.join(answers, "query_id", "left").select("query_id", "golden", F.coalesce("context", F.lit("")).alias("context"))
    j = joined.withColumn("g", words(F.col("golden"))).withColumn("c", words(F.col("context")))
    both = F.size(F.array_intersect("g", "c"))
    share = lambda n: F.when(F.size(n) > 0, F.round(both / F.size(n), 4)).otherwise(0.0)
    near = F.coalesce(F.round(cosine(hash_embed(F.col("golden")), hash_embed(F.col("context"))), 4), F.lit(0.0))
    out = j.select("query_id", share("c").alias("precision"), share("g").alias("recall"), near.alias("answer_cosine"))
    if entities is None:
        return out
    named = lambda c: entities_in_text(joined.select(F.col("query_id").alias("id"), F.col(c).alias("content")), entities)
    wanted = named("golden").withColumnRenamed("id", "query_id")
    got = named("context").select(F.col("id").alias("query_id"), "name", F.lit(1).alias("hit"))
    recall = wanted.join(got, ["query_id", "name"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("entity_recall"))
    return out.join(recall, "query_id", "left")


def eval_run(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, entities: DataFrame, relations: DataFrame, golden: DataFrame, contexts: int = 15, **options) -> DataFrame:
    """Golden questions through the standard pipeline: a row per question with its metrics, over the first contexts' texts, and the scores of
    the run's parts: high_precision and n_chunks of its hits, context_tokens, and latency, its share of the run's seconds."""
    began = time.time()
    ran = written(standard_pipeline(docs, vectors, queries, query_vectors, entities, relations, **options), "eval-ran")
    seconds = (time.time() - began) / max(1, ran.count())
    answers = ran.select("query_id", F.array_join(F.transform(F.slice("hits", 1, contexts), lambda h: h["snippet"]), "\n").alias("context"))
    chunks = ran.select(F.col("query_id").alias("item_id"), F.inline("hits")).select("item_id", F.col("id").alias("chunk_id"), "relevance", F.lit(seconds).alias("latency"))
    parts = component_scores(chunks).withColumnRenamed("item_id", "query_id").drop("latency")
    tokens = ran.select("query_id", T.count_tokens(F.col("context")).alias("context_tokens"), F.lit(round(seconds, 6)).alias("latency"))
    scored = eval_metrics(written(answers, "eval-answers"), golden, entities).join(tokens, "query_id").join(parts, "query_id", "left")
    return scored.withColumn("high_precision", F.coalesce("high_precision", F.lit(0.0))).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


_GOLD = "concat(query_text, CASE WHEN query_id % 2 = 0 THEN ' supplier#000000001' ELSE '' END)"


@query("m13_eval_run", BM25_SQL + rf", a AS (SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS context FROM bm JOIN posts USING (id) WHERE rank <= 3 GROUP BY 1), j AS (SELECT query_id, list_distinct(regexp_extract_all(lower({_GOLD}), '[\p{{L}}\p{{N}}_]+')) AS g, list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[\p{{L}}\p{{N}}_]+')) AS c, lower({_GOLD}) AS gt, lower(coalesce(context, '')) AS ct FROM queries LEFT JOIN a USING (query_id)), en AS (SELECT DISTINCT lower(s_name) AS name FROM supplier), er AS (SELECT query_id, round(avg(contains(ct, name)::INT), 4) AS entity_recall FROM j JOIN en ON contains(gt, name) GROUP BY 1) SELECT query_id, CASE WHEN len(c) > 0 THEN round(len(list_intersect(g, c))::DOUBLE / len(c), 4) ELSE 0.0 END AS precision, CASE WHEN len(g) > 0 THEN round(len(list_intersect(g, c))::DOUBLE / len(g), 4) ELSE 0.0 END AS recall, entity_recall FROM j LEFT JOIN er USING (query_id)")
def m13(spark, sf_dir):
    docs, queries = view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries")
    top = bm25_search(docs, queries, 3).join(docs.select("id", "content"), "id")
    answers = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("context"))
    golden = queries.select("query_id", F.expr(_GOLD).alias("golden"))
    return eval_metrics(answers, golden, view(spark, sf_dir, "entities")).select("query_id", "precision", "recall", "entity_recall")


@query("m13_eval_pipeline")
def m13_pipeline(spark, sf_dir):
    inputs = _inputs(spark, sf_dir)
    golden = inputs[2].select("query_id", F.expr(_GOLD).alias("golden"))
    return eval_run(*inputs, golden, mode="fast", domains=view(spark, sf_dir, "domains")).drop("latency")
