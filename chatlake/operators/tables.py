"""Aggregates, snapshots and maintenance of message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.fixtures import cte, table, view
from .clean import _NOISE_SQL, with_noise
from .running import place
from .scope import last_row
from .threads import THREADS_SQL

_TAGS = r"regexp_extract_all(content, '#([\p{L}\p{N}_]+)', 1)"


def _threads_sql(*names: str) -> str:
    return THREADS_SQL + ", " + cte(*names).removeprefix("WITH ")


def posts_per_hashtag(messages: DataFrame) -> DataFrame:
    return messages.select("domain_id", F.explode(T.hashtags(F.col("content"))).alias("tag")).groupBy("domain_id", "tag").agg(F.count("*").alias("n_posts"))


@query("a1_posts_per_hashtag", cte("messages") + f" SELECT domain_id, tag, count(*) AS n_posts FROM (SELECT domain_id, unnest({_TAGS}) AS tag FROM messages) GROUP BY 1, 2")
def a1(spark, sf_dir):
    return posts_per_hashtag(view(spark, sf_dir, "messages"))


def stale_tags(counts: DataFrame, summaries: DataFrame, least: int = 100) -> DataFrame:
    """Tags with enough posts and no fresh summary. summaries: domain_id, tag, is_stale."""
    return counts.where(F.col("n_posts") >= least).join(summaries.where("not is_stale"), ["domain_id", "tag"], "left_anti")


@query("a2_stale_tags_to_summarise", cte("messages") + f", c AS (SELECT domain_id, tag, count(*) AS n_posts FROM (SELECT domain_id, unnest({_TAGS}) AS tag FROM messages) GROUP BY 1, 2) SELECT domain_id, tag, n_posts FROM c WHERE n_posts >= 20 AND NOT (tag = 'user' AND domain_id % 2 = 0)")
def a2(spark, sf_dir):
    c = posts_per_hashtag(view(spark, sf_dir, "messages"))
    summaries = c.where("tag = 'user'").select("domain_id", "tag", (F.col("domain_id") % 2 == 1).alias("is_stale"))
    return stale_tags(c, summaries, 20).select("domain_id", "tag", "n_posts")


def domain_counters(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Totals per domain after a batch: state (domain_id, n_messages, last_id) with the batch's rows added."""
    new = batch.groupBy("domain_id").agg(F.count("*").alias("n_messages"), F.max("msg_id").alias("last_id"))
    return state.unionByName(new).groupBy("domain_id").agg(F.sum("n_messages").alias("n_messages"), F.max("last_id").alias("last_id"))


@query("a5_domain_counters", cte("messages") + " SELECT domain_id, count(*) AS n_messages, max(msg_id) AS last_id FROM messages GROUP BY domain_id")
def a5(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    empty = m.where("msg_id < 4000").groupBy("domain_id").agg(F.count("*").alias("n_messages"), F.max("msg_id").alias("last_id"))
    return domain_counters(m.where("msg_id >= 4000"), empty)


def reply_counts(messages: DataFrame) -> DataFrame:
    return messages.where("reply_to_msg_id is not null").groupBy("domain_id", F.col("reply_to_msg_id").alias("msg_id")).agg(F.count("*").alias("n_replies"))


@query("a9_reply_counts", cte("messages") + " SELECT domain_id, reply_to_msg_id AS msg_id, count(*) AS n_replies FROM messages WHERE reply_to_msg_id IS NOT NULL GROUP BY 1, 2")
def a9(spark, sf_dir):
    return reply_counts(view(spark, sf_dir, "messages"))


def ingestion_stats(messages: DataFrame, **tables: DataFrame) -> DataFrame:
    """Totals of stored tables in one row: all, noise, clean, replies of the messages and the seconds that they span, and n_NAME of each further
    table. A run's own duration is in `ingest_run`, which counts as it writes."""
    noisy = with_noise(messages)
    span = F.unix_seconds(F.max("msg_date").cast("timestamp")) - F.unix_seconds(F.min("msg_date").cast("timestamp"))
    out = noisy.agg(F.count("*").alias("n_all"), F.count_if("is_noise").alias("n_noise"), F.count_if(~F.col("is_noise")).alias("n_clean"), F.count_if(F.col("reply_to_msg_id").isNotNull()).alias("n_replies"), span.alias("duration_s"))
    for name, df in tables.items():
        out = out.join(F.broadcast(df.agg(F.count("*").alias(f"n_{name}"))))  # one row each
    return out


@query("a10_ingestion_stats", _threads_sql("entities", "relations", "vectors") + f" SELECT count(*) AS n_all, count(*) FILTER (WHERE {_NOISE_SQL}) AS n_noise, count(*) FILTER (WHERE NOT {_NOISE_SQL}) AS n_clean, count(reply_to_msg_id) AS n_replies, CAST(date_diff('second', min(msg_date), max(msg_date)) AS BIGINT) AS duration_s, (SELECT count(DISTINCT (domain_id, thread_root)) FROM t) AS n_threads, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM relations) AS n_relations, (SELECT count(*) FROM vectors) AS n_vectors FROM messages")
def a10(spark, sf_dir):
    from .threads import build_threads

    m = view(spark, sf_dir, "messages")
    return ingestion_stats(m, threads=build_threads(m), **{n: view(spark, sf_dir, n) for n in ("entities", "relations", "vectors")})


def engagement_top(messages: DataFrame, most: int = 200) -> DataFrame:
    """score = 3 * replies + min(length / 100, 5), the best first."""
    scored = messages.join(reply_counts(messages), ["domain_id", "msg_id"], "left").withColumn("score", 3 * F.coalesce("n_replies", F.lit(0)) + T.content_score(F.col("content")))
    return scored.orderBy(F.desc("score"), "msg_id").limit(most)


@query("k2_engagement_top", cte("messages") + ", r AS (SELECT domain_id, reply_to_msg_id AS msg_id, count(*) AS n FROM messages WHERE reply_to_msg_id IS NOT NULL GROUP BY 1, 2) SELECT msg_id, CAST(3 * coalesce(n, 0) + least(CAST(length(content) AS DOUBLE) / 100, 5.0) AS DOUBLE) AS score FROM messages LEFT JOIN r USING (domain_id, msg_id) ORDER BY score DESC, msg_id LIMIT 200")
def k2(spark, sf_dir):
    return engagement_top(view(spark, sf_dir, "messages")).select("msg_id", "score")


def top_per_key(df: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


@query("k3_representatives", cte("vectors") + ", p AS (SELECT v.id, channel_id AS cluster_id, d.text FROM vectors v JOIN documents d ON d.doc_id = v.id), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, id) AS rank FROM p) SELECT cluster_id, id, rank, substr(text, 1, 500) AS snippet FROM r WHERE rank <= 5")
def k3(spark, sf_dir):
    p = view(spark, sf_dir, "vectors").join(table(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id")).select("id", F.col("channel_id").alias("cluster_id"), "text")
    return representatives(p)


def representatives(posts: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    return top_per_key(posts, ["cluster_id"], most, F.desc(F.char_length("text")), F.col("id")).select("cluster_id", "id", "rank", T.snippet(F.col("text"), chars).alias("snippet"))


def tag_sample(messages: DataFrame, most: int = 50) -> DataFrame:
    """The newest posts of every tag."""
    tags = messages.select("domain_id", "msg_id", "msg_date", F.explode(T.hashtags(F.col("content"))).alias("tag"))
    return top_per_key(tags, ["domain_id", "tag"], most, F.desc("msg_date"), F.desc("msg_id"))


@query("k4_tag_sample", cte("messages") + f", t AS (SELECT domain_id, msg_id, msg_date, unnest({_TAGS}) AS tag FROM messages), r AS (SELECT *, row_number() OVER (PARTITION BY domain_id, tag ORDER BY msg_date DESC, msg_id DESC) AS rank FROM t) SELECT domain_id, tag, msg_id, rank FROM r WHERE rank <= 50")
def k4(spark, sf_dir):
    return tag_sample(view(spark, sf_dir, "messages")).select("domain_id", "tag", "msg_id", "rank")


def items_by_confidence(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "item_id")


@query("k5_items_by_confidence", "WITH i AS (SELECT event_id AS item_id, CASE WHEN event_id % 3 > 0 THEN value END AS confidence FROM events), r AS (SELECT *, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, item_id) AS rn FROM i) SELECT item_id FROM r WHERE rn <= 100")
def k5(spark, sf_dir):
    return items_by_confidence(table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.expr("CASE WHEN event_id % 3 > 0 THEN value END").alias("confidence"))).limit(100).select("item_id")


def merge_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (domain_id, msg_id): known rows only gain a missing topic; the result is a new snapshot."""
    key = ["domain_id", "msg_id"]
    fresh = last_row(new, key, F.col("topic_id").desc_nulls_last())
    both = old.alias("o").join(fresh.alias("n"), key, "full_outer")
    rest = [F.when(F.col("o._known"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns if c not in [*key, "topic_id", "_known"]]
    return both.select(*key, F.coalesce("o.topic_id", "n.topic_id").alias("topic_id"), *rest)


@query("m1_merge_messages", cte("messages") + " SELECT domain_id, msg_id, CASE WHEN msg_id % 4 = 0 THEN 1 WHEN msg_id % 3 = 0 THEN 2 END AS topic_id, CASE WHEN msg_id % 4 < 3 THEN content ELSE 'new' END AS content FROM messages")
def m1(spark, sf_dir):
    m = view(spark, sf_dir, "messages").select("domain_id", "msg_id", "content")
    old = m.where("msg_id % 4 < 3").withColumn("topic_id", F.expr("CASE WHEN msg_id % 4 = 0 THEN 1 END")).withColumn("_known", F.lit(True))
    new = m.withColumn("content", F.lit("new")).withColumn("topic_id", F.expr("CASE WHEN msg_id % 3 = 0 THEN 2 END"))
    return merge_messages(old, new.unionByName(new)).select("domain_id", "msg_id", "topic_id", "content")


def mark_stale(summaries: DataFrame, changed: DataFrame, new_posts: Column) -> DataFrame:
    """Summaries of the changed tags become stale, and their counter of new posts grows."""
    hit = changed.select("domain_id", "tag", new_posts.alias("_n"))
    out = summaries.join(hit, ["domain_id", "tag"], "left")
    return out.select("domain_id", "tag", F.col("_n").isNotNull().alias("is_stale") | F.col("is_stale"), (F.col("new_posts") + F.coalesce("_n", F.lit(0))).alias("new_posts"))


@query("m2_tag_summary_merge", cte("messages") + f", c AS (SELECT domain_id, tag, count(*) AS n FROM (SELECT domain_id, unnest({_TAGS}) AS tag FROM messages WHERE msg_id >= 3000) GROUP BY 1, 2), s AS (SELECT DISTINCT domain_id, tag FROM (SELECT domain_id, unnest({_TAGS}) AS tag FROM messages WHERE msg_id < 3000)) SELECT s.domain_id, s.tag, n IS NOT NULL AS is_stale, coalesce(n, 0) AS new_posts FROM s LEFT JOIN c USING (domain_id, tag)")
def m2(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    summaries = posts_per_hashtag(m.where("msg_id < 3000")).select("domain_id", "tag", F.lit(False).alias("is_stale"), F.lit(0).cast("long").alias("new_posts"))
    changed = posts_per_hashtag(m.where("msg_id >= 3000"))
    return mark_stale(summaries, changed, F.col("n_posts")).toDF("domain_id", "tag", "is_stale", "new_posts")


def feedback_upsert(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("message_id", "user_id").agg(F.max_by("score", F.struct("at", "feedback_id")).alias("score"))


@query("m12_feedback_upsert", "SELECT event_id % 500 AS message_id, user_id % 20 AS user_id, max_by(CASE WHEN value > 50 THEN 1 ELSE -1 END, (ts, event_id)) AS score FROM events GROUP BY 1, 2")
def m12(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), (F.col("event_id") % 500).alias("message_id"), (F.col("user_id") % 20).alias("user_id"), F.expr("CASE WHEN value > 50 THEN 1 ELSE -1 END").alias("score"), F.col("ts").alias("at"))
    return feedback_upsert(f)


# ---- evaluation tables

_CHUNKS = "SELECT o_custkey AS item_id, o_orderkey AS chunk_id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS relevance, o_totalprice AS latency FROM {}orders"


def component_scores(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("item_id").agg(F.round(F.avg(F.when(F.col("relevance") == "high", 1.0).otherwise(0.0)), 4).alias("high_precision"), F.count("*").alias("n_chunks"), F.round(F.max("latency"), 4).alias("latency"))


def _chunks(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("given_orders")
    return spark.sql(_CHUNKS.format("given_"))


@query("a11_component_scores", f"WITH c AS ({_CHUNKS.format('')}) SELECT item_id, round(avg(CASE WHEN relevance = 'high' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS high_precision, count(*) AS n_chunks, round(max(latency), 4) AS latency FROM c GROUP BY item_id")
def a11(spark, sf_dir):
    return component_scores(_chunks(spark, sf_dir))


def run_score_means(scores: DataFrame, metrics: list[str], last: int = 5) -> DataFrame:
    """Mean of each metric over a run, nulls and NaN skipped, of the last runs; a column per metric."""
    runs = scores.select("run_id").distinct().orderBy(F.desc("run_id")).limit(last)
    kept = scores.join(runs, "run_id").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.groupBy("run_id").pivot("metric", metrics).agg(F.round(F.avg("value"), 4))


@query("a12_run_score_means", "WITH s AS (SELECT o_custkey // 100 AS run_id, o_orderpriority AS metric, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS value FROM orders), r AS (SELECT DISTINCT run_id FROM s ORDER BY run_id DESC LIMIT 5) SELECT run_id, round(avg(value) FILTER (WHERE metric = '1-URGENT'), 4) AS \"1-URGENT\", round(avg(value) FILTER (WHERE metric = '5-LOW'), 4) AS \"5-LOW\" FROM s WHERE run_id IN (SELECT run_id FROM r) GROUP BY run_id")
def a12(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("run_id"), F.col("o_orderpriority").alias("metric"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN double('NaN') END ELSE o_totalprice END").alias("value"))
    return run_score_means(s, ["1-URGENT", "5-LOW"])


@query("a13_relevance_histogram", f"WITH c AS ({_CHUNKS.format('')}) SELECT relevance, count(*) AS n_chunks FROM c GROUP BY relevance")
def a13(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("relevance").agg(F.count("*").alias("n_chunks"))


def eval_items(items: DataFrame, domain_id: int) -> DataFrame:
    return items.where(F.col("is_active") & (F.col("domain_id").isNull() | (F.col("domain_id") == domain_id)))


@query("n15_eval_items", "SELECT item_id, text AS question FROM benchmark WHERE item_id % 5 > 0 AND (item_id % 3 = 0 OR item_id % 7 = 2)")
def n15(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), (F.col("item_id") % 5 > 0).alias("is_active"), F.expr("CASE WHEN item_id % 3 > 0 THEN item_id % 7 END").alias("domain_id"))
    return eval_items(items, 2).select("item_id", "question")


@query("j11_run_items_scores", "SELECT l_orderkey AS trace_id, o_custkey AS item_id, l_linenumber AS metric, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j11(spark, sf_dir):
    items = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("trace_id"), F.col("o_custkey").alias("item_id"))
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("metric"), F.col("l_quantity").alias("value"))
    return run_items_scores(items, scores)


def run_items_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    return items.join(scores, "trace_id")


def dedup_exact_text(items: DataFrame) -> DataFrame:
    """The first item of each trimmed, lower-cased content."""
    return last_row(items.withColumn("_key", F.lower(F.trim("content"))), ["_key"], F.col("item_id")).drop("_key")


@query("d3_dedup_exact_text", "SELECT min(doc_id) AS item_id FROM documents GROUP BY lower(trim(text))")
def d3(spark, sf_dir):
    return dedup_exact_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"))).select("item_id")


def history_budget(turns: DataFrame, last: int = 10, budget: float = 4000) -> DataFrame:
    """Recent turns of each conversation, kept or older: if all fit the budget they stay, else the newest that fit half of it."""
    recent = top_per_key(turns, ["conv_id"], last, F.desc("turn"))
    back = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    out = recent.withColumn("total", F.sum("token_count").over(W.partitionBy("conv_id"))).withColumn("running", F.sum("token_count").over(back))
    return out.withColumn("kept", (F.col("total") <= budget) | (F.col("running") <= F.lit(budget // 2)))


@query("w4_history_budget", cte("chat") + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM chat), s AS (SELECT *, sum(token_count) OVER (PARTITION BY conv_id) AS total, sum(token_count) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM r WHERE rank <= 10) SELECT conv_id, turn, total <= 400 OR running <= 200 AS kept FROM s")
def w4(spark, sf_dir):
    return history_budget(view(spark, sf_dir, "chat"), budget=400).select("conv_id", "turn", "kept")


def decisions_grouped(items: DataFrame) -> DataFrame:
    """Each item with its type's number of items and its place in the type by confidence: a type of any size, a row an item."""
    n = items.groupBy("type").agg(F.count("*").alias("n_items"))
    return place(items.withColumn("_order", -F.col("confidence")), ["type"], ["_order", "item_id"], "place").join(n, "type").drop("_order")


@query("a15_decisions_grouped", "SELECT l_returnflag AS type, l_orderkey * 10 + l_linenumber AS item_id, count(*) OVER (PARTITION BY l_returnflag) AS n_items, row_number() OVER (PARTITION BY l_returnflag ORDER BY -l_quantity, l_orderkey * 10 + l_linenumber) AS place FROM lineitem")
def a15(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("double").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"))
    return decisions_grouped(items).select("type", "item_id", "n_items", "place")
