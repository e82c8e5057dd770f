"""Reading messages: canonical schema, incremental fetch, classification of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from .fixtures import cte, table, view

#: Canonical columns and types.
MESSAGE_TYPES = {"domain_id": "long", "msg_id": "long", "reply_to_msg_id": "long", "topic_id": "long", "sender_name": "string", "content": "string", "content_type": "string", "msg_date": "timestamp_ntz", "hashtags": "array<string>"}

#: Media kinds, the first that a record has counts.
KINDS = ["photo", "video", "document", "sticker", "voice", "video_note", "poll", "geo"]


def canonical(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Raw rows -> message schema; mapping gives a column or expression for each canonical column, null where absent."""
    one = lambda c: F.lit(None) if c is None else F.expr(c) if isinstance(c, str) else c
    return df.select(*[one(mapping.get(c)).cast(t).alias(c) for c, t in MESSAGE_TYPES.items()])


def read_messages(spark, path: str, mapping: dict, fmt: str = "parquet") -> DataFrame:
    return canonical(spark.read.format(fmt).load(path), mapping)


def incremental(df: DataFrame, state: DataFrame, since: Column) -> DataFrame:
    """Rows above each domain's high-water mark (state: domain_id, last_id) and not older than since."""
    high = state.groupBy("domain_id").agg(F.max("last_id").alias("hwm"))
    return df.join(high, "domain_id", "left").where((F.col("msg_id") > F.coalesce("hwm", F.lit(0))) & (F.col("msg_date") >= since)).drop("hwm")


def widen_if_empty(df: DataFrame, since: Column) -> DataFrame:
    """Rows in the window, or all rows of a domain that has none there."""
    inside = F.col("msg_date") >= since
    some = df.groupBy("domain_id").agg(F.max(inside).alias("_some"))
    return df.join(some, "domain_id").where(inside | ~F.col("_some")).drop("_some")


def content_type(raw: Column) -> Column:
    """First matching media kind of a raw record (JSON), in the order of KINDS."""
    out = F.when(F.get_json_object(raw, f"$.{KINDS[0]}").isNotNull(), KINDS[0])
    for kind in KINDS[1:]:
        out = out.when(F.get_json_object(raw, f"$.{kind}").isNotNull(), kind)
    return out.otherwise("text")


#: Fixed value: the forms of a channel's link.
LINK = r"(?:https?://)?(?:t\.me|telegram\.me)/(?:\+)?([a-zA-Z0-9_]+)"


def parse_handle(text: Column) -> Column:
    """A channel link, @name or bare name -> name."""
    given = F.trim(text)
    link = F.regexp_extract(given, LINK, 1)
    return F.when(F.startswith(given, F.lit("@")), F.substring(given, 2, 1_000_000)).when(link != "", link).otherwise(given)


def topic_id(raw: Column, reply_id: Column) -> Column:
    """The forum topic: the record's top id, else the reply id of a forum message."""
    top = F.get_json_object(raw, "$.reply_to.reply_to_top_id").cast("long")
    return F.coalesce(top, F.when(F.get_json_object(raw, "$.reply_to.forum_topic") == "true", reply_id))


DOC_MAPPING = {"domain_id": "doc_id % 20", "msg_id": "doc_id", "content": "text", "content_type": "'text'", "sender_name": "source", "msg_date": "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 600)"}


@query("s1_scan_messages", "SELECT CAST(doc_id % 20 AS BIGINT) AS domain_id, doc_id AS msg_id, source AS sender_name, CAST(length(text) AS BIGINT) AS chars, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 600) AS msg_date FROM documents")
def s1(spark, sf_dir):
    return read_messages(spark, f"{sf_dir}/documents.parquet", DOC_MAPPING).select("domain_id", "msg_id", "sender_name", F.char_length("content").cast("long").alias("chars"), "msg_date")


@query("s2_incremental_fetch", cte("messages") + ", state AS (SELECT domain_id, max(msg_id) AS last_id FROM messages WHERE msg_id < 5000 GROUP BY domain_id) SELECT m.domain_id, m.msg_id FROM messages m LEFT JOIN state USING (domain_id) WHERE m.msg_id > coalesce(last_id, 0) AND msg_date >= TIMESTAMP '2024-01-01 12:00:00'")
def s2(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    state = m.where("msg_id < 5000").select("domain_id", F.col("msg_id").alias("last_id"))
    return incremental(m, state, F.expr("timestamp_ntz'2024-01-01 12:00:00'")).select("domain_id", "msg_id")


@query("s3_widen_if_empty", cte("messages") + ", m AS (SELECT *, max(CASE WHEN msg_date >= TIMESTAMP '2024-01-05 00:00:00' THEN 1 ELSE 0 END) OVER (PARTITION BY domain_id, content_type) AS n_in FROM messages) SELECT domain_id * 100 + length(content_type) AS domain_id, msg_id FROM m WHERE msg_date >= TIMESTAMP '2024-01-05 00:00:00' OR n_in = 0")
def s3(spark, sf_dir):
    m = view(spark, sf_dir, "messages").withColumn("real", F.col("domain_id")).withColumn("domain_id", F.concat_ws("/", "domain_id", "content_type"))
    return widen_if_empty(m, F.expr("timestamp_ntz'2024-01-05 00:00:00'")).select((F.col("real") * 100 + F.char_length("content_type")).alias("domain_id"), "msg_id")


_RAW = """CASE event_id % 6 WHEN 0 THEN '{"photo":{"id":1}}' WHEN 1 THEN '{"sticker":{"id":2}}' WHEN 2 THEN '{"voice":{"id":2},"poll":{"q":0}}' WHEN 3 THEN '{"poll":{"q":1}}' WHEN 4 THEN '{"document":{"id":3}}' ELSE props END"""


@query("s4_content_type", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'photo' WHEN 1 THEN 'sticker' WHEN 2 THEN 'voice' WHEN 3 THEN 'poll' WHEN 4 THEN 'document' ELSE 'text' END AS content_type FROM events")
def s4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", content_type(F.expr(_RAW)).alias("content_type"))


@query("s5_parse_handle", r"WITH h AS (SELECT page_id, trim(CASE page_id % 4 WHEN 0 THEN concat('https://t.me/chan_', page_id, '/7') WHEN 1 THEN concat('@name', page_id) WHEN 2 THEN concat('bare_', page_id) ELSE url END) AS h FROM pages), l AS (SELECT page_id, h, regexp_extract(h, '(?:https?://)?(?:t\.me|telegram\.me)/(?:\+)?([a-zA-Z0-9_]+)', 1) AS l FROM h) SELECT page_id, CASE WHEN starts_with(h, '@') THEN substr(h, 2) WHEN l <> '' THEN l ELSE h END AS handle FROM l")
def s5(spark, sf_dir):
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN concat('https://t.me/chan_', page_id, '/7') WHEN 1 THEN concat('@name', page_id) WHEN 2 THEN concat('bare_', page_id) ELSE url END")
    return table(spark, sf_dir, "pages").select("page_id", parse_handle(raw).alias("handle"))


@query("s6_topic_id", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id + 5 WHEN 1 THEN user_id END AS topic_id FROM events")
def s6(spark, sf_dir):
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"reply_to":{"reply_to_top_id":', event_id + 5, '}}') WHEN 1 THEN '{"reply_to":{"forum_topic":true}}' ELSE '{}' END""")
    return table(spark, sf_dir, "events").select("event_id", topic_id(raw, F.col("user_id")).alias("topic_id"))


def domain_history(df: DataFrame, domain_id: int) -> DataFrame:
    return df.where(F.col("domain_id") == domain_id).orderBy("msg_date", "msg_id")


@query("n11_domain_history", cte("messages") + " SELECT msg_id, msg_date FROM messages WHERE domain_id = 3 ORDER BY msg_date, msg_id")
def n11(spark, sf_dir):
    return domain_history(view(spark, sf_dir, "messages"), 3).select("msg_id", "msg_date")


def backfill_topics(messages: DataFrame) -> DataFrame:
    """A missing topic becomes the reply's root where that root is known in the domain."""
    roots = messages.where("topic_id is not null").select(F.col("domain_id"), F.col("topic_id").alias("reply_to_msg_id"), F.col("topic_id").alias("_root")).distinct()
    joined = messages.join(roots, ["domain_id", "reply_to_msg_id"], "left")
    return joined.withColumn("topic_id", F.coalesce("topic_id", "_root")).drop("_root")


@query("j6_topic_backfill", cte("messages") + ", t AS (SELECT *, CASE WHEN msg_id % 3 = 0 THEN reply_to_msg_id END AS topic_id FROM messages), r AS (SELECT DISTINCT domain_id, topic_id AS root FROM t WHERE topic_id IS NOT NULL) SELECT t.msg_id, coalesce(t.topic_id, r.root) AS topic_id FROM t LEFT JOIN r ON t.domain_id = r.domain_id AND t.reply_to_msg_id = r.root")
def j6(spark, sf_dir):
    m = view(spark, sf_dir, "messages").withColumn("topic_id", F.expr("CASE WHEN msg_id % 3 = 0 THEN reply_to_msg_id END"))
    return backfill_topics(m).select("msg_id", "topic_id")


def newest_per_domain(df: DataFrame, most: int) -> DataFrame:
    w = W.partitionBy("domain_id").orderBy(F.desc("msg_date"), F.desc("msg_id"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
