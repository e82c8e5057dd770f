"""Applying a model to texts in batches, and rules that stand in for models so that every plan runs offline."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.fixtures import cte, view
from .clean import recent_messages, valid_items
from ..sources.tables import written
from .tables import dedup_exact_text, items_by_confidence, top_per_key

CUES = {"decision": ["tion the", "decided", "agreed"], "action_item": ["ing the", "todo", "please"], "open_question": ["?", "eaux"]}


def apply_model(df: DataFrame, build: Callable[[], Callable[[list[str]], list]], key: str = "id", text: str = "text", batch: int = 32, most_chars: int | None = None) -> DataFrame:
    """(key, value as JSON, error): build() makes the model once per task; it maps a list of texts to a list of values.

    Null and blank texts are skipped. A batch that fails gives rows with the error instead of stopping the job.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = build()
        for rows in batches:
            keys, texts = rows.column(0), [t or "" for t in rows.column(1).to_pylist()]
            keep = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(keep), batch):
                part = keep[at : at + batch]
                try:
                    got = list(model([texts[i][:most_chars] for i in part]))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} values for {len(part)} texts")
                    values, errors = [json.dumps(v, ensure_ascii=False) for v in got], [None] * len(part)
                except Exception as e:  # noqa: BLE001  a failed batch is reported, not fatal
                    values, errors = [None] * len(part), [f"{type(e).__name__}: {e}"[:500]] * len(part)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(part)), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=["key", "value", "error"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, value string, error string").withColumnRenamed("key", key)


Model = Callable[[], Callable[[list[str]], list]]


def judged_pairs(hits: DataFrame, queries: DataFrame, model: Model, batch: int = 32) -> DataFrame:
    """(query_id, id, value, error): the model sees a query and a hit's text, a blank line between them."""
    texts = hits.join(queries.select("query_id", "query_text"), "query_id").select(F.struct("query_id", "id").alias("pair"), F.concat_ws("\n\n", "query_text", "content").alias("text"))
    return apply_model(texts, model, "pair", batch=batch).select("pair.query_id", "pair.id", "value", "error")


def word_lengths() -> Callable[[list[str]], list]:
    """The smallest of models: number of words and longest word."""
    return lambda texts: [{"words": len(t.split()), "longest": max(map(len, t.split()))} for t in texts]


@query("u1_apply_model", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(NULL AS VARCHAR) AS error FROM documents WHERE trim(text) <> ''")
def u1(spark, sf_dir):
    got = apply_model(view(spark, sf_dir, "posts").select(F.col("id").alias("doc_id"), F.col("content").alias("text")), word_lengths, "doc_id")
    return got.select("doc_id", F.get_json_object("value", "$.words").cast("long").alias("words"), "error")


def rerank(hits: DataFrame, queries: DataFrame, most: int, model: Model | None = None) -> DataFrame:
    """Re-scores hits, and keeps each query's best. model: a pair model that gives a number for "query, blank line, text".

    Where it fails for one of a query's hits, that query keeps its first ones as they were. Without a model the score is the
    boosts of the query terms that a text holds over those of all, plus 0.1 of the old score's share.
    """
    if model:
        got = judged_pairs(hits, queries, model).select("query_id", "id", F.col("value").try_cast("double").alias("_new"))
        both = hits.join(got, ["query_id", "id"], "left").withColumn("_bad", F.max(F.col("_new").isNull()).over(W.partitionBy("query_id")))
        scored = both.withColumn("_by", F.when(F.col("_bad"), F.col("score")).otherwise(F.col("_new"))).withColumn("score", F.col("_by")).drop("_new", "_bad", "_by", "rank")
        return top_per_key(scored, ["query_id"], most, F.desc("score"), F.col("id"))
    # a map above the join, and the words as an argument: a text is tokenised once, not once a term
    q = queries.select("query_id", F.map_from_entries(T.bm25_terms(F.col("query_text"))).alias("boosts"))
    shared = F.array_intersect(F.map_keys("boosts"), F.coalesce(T.terms(F.col("content")), F.array().cast("array<string>")))
    held = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.element_at("boosts", t))
    every = F.aggregate(F.map_values("boosts"), F.lit(0.0), lambda s, x: s + x)
    scored = hits.join(q, "query_id").withColumn("score", F.round(held / F.greatest(every, F.lit(1.0)) + 0.1 * F.col("score") / (1 + F.col("score")), 6))
    return top_per_key(scored.drop("boosts", "rank"), ["query_id"], most, F.desc("score"), F.col("id"))


@query("r8_rerank")
def r8(spark, sf_dir):
    from .search import bm25_search

    posts, q = view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries")
    hits = bm25_search(posts, q, 20).join(posts.select("id", "content"), "id")
    return rerank(hits, q, 10).select("query_id", "id", "score", "rank")


ITEM = "array<struct<type:string,content:string,confidence:double>>"


def extract_items(messages: DataFrame, cues: dict[str, list[str]] = CUES, model: Model | None = None) -> DataFrame:
    """(domain_id, msg_id, item_id, type, content, confidence): what a model lists for a message's first 500 characters, as JSON
    objects of these three, or by default sentences with a cue phrase."""
    if model:
        keyed = messages.select(F.struct("domain_id", "msg_id").alias("at"), "content")
        got = apply_model(keyed, model, "at", "content", 15, 500).where("error is null")
        each = got.select("at.domain_id", "at.msg_id", F.posexplode(F.from_json("value", ITEM)).alias("pos", "i"))
        return each.select("domain_id", "msg_id", (F.col("msg_id") * 1000 + F.col("pos")).alias("item_id"), "i.type", "i.content", F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"))
    sentences = messages.select("domain_id", "msg_id", F.posexplode(F.split(F.substring("content", 1, 500), r"\. ")).alias("pos", "content"))
    kind = F.lit(None).cast("string")
    for name, phrases in reversed(cues.items()):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(F.lower("content"), F.lit(p))
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return sentences.withColumn("type", kind).select("domain_id", "msg_id", (F.col("msg_id") * 1000 + F.col("pos")).alias("item_id"), "type", "content", F.least(F.lit(1.0), F.char_length("content") / 100).alias("confidence"))


def decisions(messages: DataFrame, as_of, days: int = 30, per_domain: int = 500, model: Model | None = None) -> DataFrame:
    """Recent messages -> valid items, unique by content within a domain, the surest first."""
    recent = recent_messages(messages, as_of, days, per_domain)
    return items_by_confidence(dedup_exact_text(valid_items(extract_items(recent, model=model))))


_CASE = "CASE WHEN contains(lower(c), 'tion the') OR contains(lower(c), 'decided') OR contains(lower(c), 'agreed') THEN 'decision' WHEN contains(lower(c), 'ing the') OR contains(lower(c), 'todo') OR contains(lower(c), 'please') THEN 'action_item' WHEN contains(lower(c), '?') OR contains(lower(c), 'eaux') THEN 'open_question' END"


@query("m6_decisions", cte("messages") + f", k AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY msg_date DESC, msg_id DESC) AS rn FROM messages WHERE NOT (content_type IN ('sticker','geo','video_note','dice','contact','venue') OR (content_type = 'poll' AND trim(coalesce(content, '')) = '') OR (length(trim(coalesce(content,''))) < 5 AND reply_to_msg_id IS NULL)) AND msg_date >= TIMESTAMP '2024-01-02 00:00:00'), s AS (SELECT domain_id, msg_id, string_split(substr(content, 1, 500), '. ') AS ss FROM k WHERE rn <= 500), e AS (SELECT domain_id, msg_id * 1000 + i - 1 AS item_id, ss[i] AS c FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)), t AS (SELECT *, {_CASE} AS type FROM e), d AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(c)) ORDER BY item_id) AS rn FROM t WHERE type IS NOT NULL) SELECT domain_id, item_id, type FROM d WHERE rn = 1")
def m6(spark, sf_dir):
    from .clean import now

    return decisions(view(spark, sf_dir, "messages"), now()).select("domain_id", "item_id", "type")


GRAPH = "struct<entities:array<struct<name:string,type:string,confidence:double>>,relations:array<struct<source:string,target:string,type:string,confidence:double>>>"


def extract_entities(threads: DataFrame, most: int = 10, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of thread texts: (domain_id, name, type, n_threads, confidence) and (domain_id, source, target,
    n_threads, type). threads: domain_id, thread_id, text.

    A model gives for a text {"entities": [{name, type, confidence}], "relations": [{source, target, type, confidence}]}; what it
    leaves out is 0.8 and RELATED_TO. By default tags, mentions and capitalised word pairs are entities, and those of one thread are
    related, at most `most` of a thread (by name).
    """
    if model:
        keyed = threads.select(F.struct("domain_id", "thread_id").alias("at"), "text")
        got = written(apply_model(keyed, model, "at", "text", 5, 4000).where("error is null").select("at.domain_id", F.from_json("value", GRAPH).alias("g")), "extracted")
        each = got.select("domain_id", F.inline("g.entities")).where("trim(name) <> ''")
        entities = each.groupBy("domain_id", "name").agg(F.min("type").alias("type"), F.count("*").alias("n_threads"), F.max(F.coalesce("confidence", F.lit(0.8))).alias("confidence"))
        linked = got.select("domain_id", F.inline("g.relations")).where("source <> target").withColumn("type", F.coalesce("type", F.lit("RELATED_TO")))
        return entities, linked.groupBy("domain_id", "source", "target", "type").agg(F.count("*").alias("n_threads")).select("domain_id", "source", "target", "n_threads", "type")
    text = F.substring("text", 1, 4000)
    kinds = [("Tag", r"#([\p{L}\p{N}_]+)"), ("Person", r"@([A-Za-z0-9_]{3,})"), ("Term", r"([A-Z][a-z]{3,} [A-Z][a-z]{3,})")]
    named = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type")))
    found = F.flatten(F.array(*[named(k, p) for k, p in kinds]))
    each = threads.select("domain_id", "thread_id", F.array_sort(F.array_distinct(found)).alias("es"))
    entities = each.select("domain_id", F.inline("es")).groupBy("domain_id", "name").agg(F.min("type").alias("type"), F.count("*").alias("n_threads")).withColumn("confidence", F.lit(0.8))
    few = each.withColumn("es", F.slice("es", 1, most))
    pairs = few.select("domain_id", "es", F.posexplode("es").alias("i", "a")).select("domain_id", "a", F.posexplode("es").alias("j", "b"), "i").where("i < j")
    relations = pairs.groupBy("domain_id", F.col("a.name").alias("source"), F.col("b.name").alias("target")).agg(F.count("*").alias("n_threads")).withColumn("type", F.lit("RELATED_TO")).where("source <> target")
    return entities, relations


_M7 = cte("messages") + r", e AS (SELECT domain_id, msg_id, unnest(regexp_extract_all(substr(content, 1, 4000), '#([\p{L}\p{N}_]+)', 1)) AS name, 'Tag' AS type FROM messages UNION SELECT domain_id, msg_id, unnest(regexp_extract_all(substr(content, 1, 4000), '@([A-Za-z0-9_]{3,})', 1)), 'Person' FROM messages UNION SELECT domain_id, msg_id, unnest(regexp_extract_all(substr(content, 1, 4000), '([A-Z][a-z]{3,} [A-Z][a-z]{3,})', 1)), 'Term' FROM messages), few AS (SELECT *, row_number() OVER (PARTITION BY domain_id, msg_id ORDER BY name, type) AS i FROM e)"


@query("m7_entity_extraction", _M7 + " SELECT domain_id, name AS source, NULL AS target, min(type) AS type, count(*) AS n_threads FROM e GROUP BY 1, 2 UNION ALL SELECT a.domain_id, a.name, b.name, 'RELATED_TO', count(*) FROM few a JOIN few b ON a.domain_id = b.domain_id AND a.msg_id = b.msg_id AND a.i < b.i AND b.i <= 10 AND a.name <> b.name GROUP BY 1, 2, 3")
def m7(spark, sf_dir):
    m = view(spark, sf_dir, "messages").select("domain_id", F.col("msg_id").alias("thread_id"), F.col("content").alias("text"))
    entities, relations = extract_entities(m)
    return entities.select("domain_id", F.col("name").alias("source"), F.lit(None).cast("string").alias("target"), "type", "n_threads").unionByName(relations.select("domain_id", "source", "target", "type", "n_threads"))
