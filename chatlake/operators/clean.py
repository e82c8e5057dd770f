"""Filters and predicates on messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import THREAD_UUID_SQL, thread_uuid
from ..registry import query
from ..sources.fixtures import AS_OF, cte, table, view
from ..sources.messages import newest_per_domain
from ..sources.tables import written

#: Fixed values.
NOISE_TYPES = ["sticker", "geo", "video_note", "dice", "contact", "venue", "new_chat_members", "left_chat_member", "pinned_message", "migrate_to_chat_id", "migrate_from_chat_id"]
NEEDS_TEXT = ["poll", "voice", "audio"]
DIGEST_TAGS = ["дайджест", "digest", "дайджестчата", "дайджестдня", "weekly", "weeklydigest"]
ITEM_TYPES = ["decision", "action_item", "open_question"]


def now() -> Column:
    """The fixtures' as-of time."""
    return F.expr(f"timestamp_ntz'{AS_OF}'")



def is_noise(content: Column, content_type: Column, reply: Column) -> Column:
    trimmed = F.char_length(F.trim(F.coalesce(content, F.lit(""))))
    return content_type.isin(NOISE_TYPES) | (content_type.isin(NEEDS_TEXT) & (trimmed == 0)) | ((trimmed < 5) & reply.isNull())


def with_noise(df: DataFrame) -> DataFrame:
    return df.withColumn("is_noise", F.coalesce(is_noise(F.col("content"), F.col("content_type"), F.col("reply_to_msg_id")), F.lit(False)))


_SHORT = "CASE WHEN msg_id % 5 = 0 THEN substr(content, 1, 4) WHEN msg_id % 17 = 0 THEN NULL ELSE content END"
_NOISE_SQL = "(content_type IN ('sticker','geo','video_note','dice','contact','venue') OR (content_type IN ('poll','voice','audio') AND length(trim(coalesce(content,''))) = 0) OR (length(trim(coalesce(content,''))) < 5 AND reply_to_msg_id IS NULL))"


@query("n1_noise_filter", cte("messages") + f", m AS (SELECT msg_id, content_type, reply_to_msg_id, {_SHORT} AS content FROM messages) SELECT msg_id, {_NOISE_SQL} AS is_noise FROM m")
def n1(spark, sf_dir):
    return with_noise(view(spark, sf_dir, "messages").withColumn("content", F.expr(_SHORT))).select("msg_id", "is_noise")


def since(df: DataFrame, cutoff: Column, column: str = "msg_date") -> DataFrame:
    return df.where(F.col(column) >= cutoff)


@query("n4_since_filter", cte("posts") + " SELECT id, length(content) AS score FROM posts WHERE msg_date >= TIMESTAMP '2024-01-04 00:00:00' ORDER BY score DESC, id LIMIT 50")
def n4(spark, sf_dir):
    hits = since(view(spark, sf_dir, "posts"), F.expr("timestamp_ntz'2024-01-04 00:00:00'")).select("id", F.char_length("content").cast("long").alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(50)


def keyword_any(df: DataFrame, keywords: list[str], most: int | None = None) -> DataFrame:
    """Rows with any keyword as a case-insensitive substring, newest first, with the number of all matches."""
    low = F.lower(F.col("content"))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(low, F.lit(k.lower()))
    return newest_with_total(df.where(hit), most, F.desc("msg_date"), F.col("id"))


def newest_with_total(found: DataFrame, most: int | None, *order: Column) -> DataFrame:
    """The first rows in order, with the number of all. The matches, written once, serve both."""
    found = written(found, "matches")
    total = found.agg(F.count("*").alias("total_matches"))
    top = found.orderBy(*order)
    return (top.limit(most) if most else top).join(F.broadcast(total))  # one row


@query("n5_keyword_any", cte("posts") + ", f AS (SELECT id, msg_date FROM posts WHERE contains(lower(content), 'thion') OR contains(lower(content), 'eaux')) SELECT id, (SELECT count(*) FROM f) AS total_matches FROM f ORDER BY msg_date DESC, id LIMIT 200")
def n5(spark, sf_dir):
    return keyword_any(view(spark, sf_dir, "posts"), ["thion", "EAUX"], 200).select("id", "total_matches")


@query("n6_expand_keywords", cte("queries") + r", p AS (SELECT query_id, 0 AS pos, query_text AS kw FROM queries UNION ALL SELECT query_id, i, string_split(query_text, ' ')[i] FROM (SELECT query_id, query_text, unnest(range(1, len(string_split(query_text, ' ')) + 1)) AS i FROM queries)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(kw) ORDER BY pos) AS rn FROM p WHERE pos = 0 OR length(kw) >= 3) SELECT query_id, kw AS keyword FROM k WHERE rn = 1")
def n6(spark, sf_dir):
    q = view(spark, sf_dir, "queries")
    return q.select("query_id", F.explode(T.expand_keywords(F.array("query_text"))).alias("keyword"))


def hashtag_contains(df: DataFrame, tag: str, most: int) -> DataFrame:
    return newest_with_total(df.where(F.array_contains(T.hashtags(F.col("content")), tag)), most, F.desc("msg_date"), F.desc("msg_id"))


_TAGS = r"regexp_extract_all(content, '#([\p{L}\p{N}_]+)', 1)"


@query("n7_hashtag_contains", cte("messages") + f", f AS (SELECT msg_id, msg_date FROM messages WHERE list_contains({_TAGS}, 'even')) SELECT msg_id, (SELECT count(*) FROM f) AS total_matches FROM f ORDER BY msg_date DESC, msg_id DESC LIMIT 100")
def n7(spark, sf_dir):
    return hashtag_contains(view(spark, sf_dir, "messages"), "even", 100).select("msg_id", "total_matches")


def drop_digest_posts(df: DataFrame) -> DataFrame:
    tags = F.coalesce(T.hashtags(F.col("content")), F.array().cast("array<string>"))
    low = F.lower(F.coalesce("content", F.lit("")))
    return df.where(~F.exists(tags, lambda t: F.lower(t).isin(DIGEST_TAGS)) & ~F.contains(low, F.lit("#дайджест")) & ~F.contains(low, F.lit("#digest")))


_DIGESTY = "CASE WHEN msg_id % 7 = 0 THEN concat(content, ' #Digest') WHEN msg_id % 7 = 1 THEN concat(content, ' #Weekly') ELSE content END"


@query("n8_digest_post_filter", cte("messages") + f", m AS (SELECT msg_id, {_DIGESTY} AS content FROM messages) SELECT msg_id FROM m WHERE NOT contains(lower(content), '#дайджест') AND NOT contains(lower(content), '#digest') AND len(list_filter({_TAGS}, lambda t: lower(t) IN ('дайджест','digest','дайджестчата','дайджестдня','weekly','weeklydigest'))) = 0")
def n8(spark, sf_dir):
    return drop_digest_posts(view(spark, sf_dir, "messages").withColumn("content", F.expr(_DIGESTY))).select("msg_id")


def recent_messages(df: DataFrame, as_of: Column, days: int, most: int) -> DataFrame:
    """The newest clean messages of the last days, at most so many per domain."""
    clean = with_noise(df).where(~F.col("is_noise") & (F.col("msg_date") >= as_of - F.make_dt_interval(F.lit(days))))
    return newest_per_domain(clean, most)


@query("n9_recent_messages", cte("messages") + f", c AS (SELECT domain_id, msg_id, row_number() OVER (PARTITION BY domain_id ORDER BY msg_date DESC, msg_id DESC) AS rn FROM messages WHERE NOT {_NOISE_SQL} AND msg_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) SELECT domain_id, msg_id FROM c WHERE rn <= 10")
def n9(spark, sf_dir):
    return recent_messages(view(spark, sf_dir, "messages"), now(), 30, 10).select("domain_id", "msg_id")


def named_keywords(queries: DataFrame, types: DataFrame) -> DataFrame:
    """(query_id, kw): the words of each type that a query names, by the type itself or a description's word of 5 letters or more.

    types: type, description: a schema's rows, of which each query is held against all.
    """
    words = lambda c, n: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.char_length(w) >= n)
    schema = types.agg(F.collect_list(F.struct(F.lower("type").alias("type"), words(F.col("description"), 5).alias("w5"), words(F.col("description"), 4).alias("w4"))).alias("ts"))
    low = F.lower("query_text")
    asked = queries.join(F.broadcast(schema)).select("query_id", F.explode(F.filter("ts", lambda t: F.contains(low, t["type"]) | F.coalesce(F.exists(t["w5"], lambda w: F.contains(low, w)), F.lit(False)))).alias("t"))
    return asked.select("query_id", F.explode(F.concat(F.array("t.type"), F.coalesce("t.w4", F.array().cast("array<string>")))).alias("kw")).distinct()


def entity_type_filter(posts: DataFrame, queries: DataFrame, types: DataFrame) -> DataFrame:
    """(query_id, id) of posts that mention a type that the query names; all posts of a query that would keep none."""
    wanted = written(named_keywords(queries, types), "type-words")
    # the words in one row: each text is held against every word once, whatever the number of queries
    sought = F.broadcast(wanted.agg(F.collect_set("kw").alias("kws")))
    held = posts.select("id", F.lower("content").alias("low")).join(sought).select("id", F.explode(F.filter("kws", lambda k: F.contains(F.col("low"), k))).alias("kw"))
    hits = written(held.join(wanted, "kw").select("query_id", "id").distinct(), "type-hits")
    # only queries without a hit keep everything
    others = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti").agg(F.collect_list("query_id").alias("qs"))
    return hits.unionByName(posts.select("id").join(F.broadcast(others)).select(F.explode("qs").alias("query_id"), "id"))


def entity_type_hits(hits: DataFrame, queries: DataFrame, types: DataFrame) -> DataFrame:
    """Of each query's own hits (query_id, id, content, ...) those that mention a type that the query names; all, if none would be left."""
    wanted = named_keywords(queries, types).groupBy("query_id").agg(F.collect_set("kw").alias("_kws"))  # a schema's words
    low = F.lower("content")
    marked = hits.join(wanted, "query_id", "left").withColumn("_hit", F.coalesce(F.exists("_kws", lambda k: F.contains(low, k)), F.lit(False)))
    return marked.withColumn("_some", F.max("_hit").over(W.partitionBy("query_id"))).where("_hit or not _some").drop("_kws", "_hit", "_some")


_TYPES = "SELECT r_name AS type, CASE r_regionkey WHEN 0 THEN 'stouhe thent' WHEN 1 THEN 'eauxment' WHEN 2 THEN 'tionble' ELSE 'nothing' END AS description FROM {}region"


@query(
    "n10_entity_type_filter",
    cte("posts", "queries")
    + f", ty AS ({_TYPES.format('')}), w AS (SELECT type, lower(type) AS kw, 99 AS l FROM ty UNION ALL SELECT type, unnest(string_split(lower(description), ' ')), NULL FROM ty), n AS (SELECT DISTINCT q.query_id, w.type FROM queries q, w WHERE contains(lower(query_text), kw) AND coalesce(l, length(kw)) >= 5), k AS (SELECT DISTINCT n.query_id, w.kw FROM n JOIN w USING (type) WHERE coalesce(l, length(kw)) >= 4), h AS (SELECT DISTINCT k.query_id, p.id FROM k JOIN posts p ON contains(lower(p.content), k.kw)), s AS (SELECT DISTINCT query_id FROM h) SELECT query_id, id FROM h UNION ALL SELECT q.query_id, p.id FROM queries q, posts p WHERE q.query_id NOT IN (SELECT query_id FROM s)",
)
def n10(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("given_region")
    return entity_type_filter(view(spark, sf_dir, "posts"), view(spark, sf_dir, "queries"), spark.sql(_TYPES.format("given_")))


def read_by_ids(df: DataFrame, ids: DataFrame, read: DataFrame) -> DataFrame:
    """Rows of the wanted ids that were not read yet. ids: a request's, at most 20."""
    return df.join(F.broadcast(ids), "msg_id", "left_semi").join(read, "msg_id", "left_anti")


@query("n12_read_by_ids", cte("messages") + " SELECT msg_id, content FROM messages WHERE msg_id IN (SELECT conv_id * 100 FROM conversations WHERE turn = 0 AND conv_id < 20) AND msg_id NOT IN (300, 500)")
def n12(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id < 20").select((F.col("conv_id") * 100).alias("msg_id"))
    return read_by_ids(view(spark, sf_dir, "messages"), ids, ids.where("msg_id in (300, 500)")).select("msg_id", "content")


def schema_sample(df: DataFrame, most: int = 75, seed: int = 7) -> DataFrame:
    return df.where(F.char_length(F.trim("content")) >= 10).orderBy(F.xxhash64("msg_id", F.lit(seed)), "msg_id").limit(most)


@query("n16_schema_sample")
def n16(spark, sf_dir):
    return schema_sample(view(spark, sf_dir, "messages")).select("msg_id", "content")


@query("n17_low_confidence_cut", cte("entities") + " SELECT domain_id, name FROM entities WHERE confidence >= 0.5")
def n17(spark, sf_dir):
    return low_confidence_cut(view(spark, sf_dir, "entities")).select("domain_id", "name")


def low_confidence_cut(df: DataFrame, least: float = 0.5) -> DataFrame:
    return df.where(F.col("confidence") >= least)


def valid_items(df: DataFrame) -> DataFrame:
    return df.where(F.col("type").isin(ITEM_TYPES) & F.col("content").isNotNull())


@query("n18_valid_items", "SELECT event_id, CASE event_type WHEN 'click' THEN 'decision' WHEN 'view' THEN 'action_item' ELSE event_type END AS type FROM events WHERE event_type IN ('click', 'view') AND event_id % 4 <> 0")
def n18(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.expr("CASE event_type WHEN 'click' THEN 'decision' WHEN 'view' THEN 'action_item' ELSE event_type END").alias("type"), F.expr("CASE WHEN event_id % 4 <> 0 THEN props END").alias("content"))
    return valid_items(items).select("event_id", "type")


# ---- the column functions, each as a query over its table

_MIXED = "CASE WHEN doc_id % 5 = 0 THEN concat(repeat('Привет мир и все остальные люди ', CAST(floor(doc_id % 3 * length(text) / 60) AS INT) + 1), text) WHEN doc_id % 5 = 1 THEN '12 34' WHEN doc_id % 5 = 2 THEN NULL ELSE text END"


@query("f1_detect_language", rf"WITH m AS (SELECT doc_id, {_MIXED} AS t FROM documents), n AS (SELECT doc_id, CAST(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS DOUBLE) AS l, CAST(length(regexp_replace(t, '[^\x{{0400}}-\x{{04FF}}]', '', 'g')) AS DOUBLE) AS c FROM m) SELECT doc_id, CASE WHEN coalesce(l, 0) = 0 THEN 'unknown' WHEN c / l >= 0.3 THEN 'ru' ELSE 'en' END AS language FROM n")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.expr(_MIXED)).alias("language"))


@query("f2_hashtags", cte("messages") + f" SELECT msg_id, nullif(array_to_string({_TAGS}, '|'), '') AS tags FROM messages")
def f2(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("msg_id", F.array_join(T.hashtags(F.col("content")), "|").alias("tags"))


@query("f3_query_keywords", r"""WITH q AS (SELECT item_id, concat('"', substr(text, 1, 12), '" « ', substr(text, 3, 9), '» “', substr(text, 5, 8), '” #tag NewYorkTimes ', text) AS t FROM benchmark), k AS (SELECT item_id, list_concat(list_concat(list_filter(list_transform(regexp_extract_all(t, '["«“]([^"»”]+)["»”]', 1), lambda x: trim(x)), lambda x: x <> ''), regexp_extract_all(t, '#([\p{L}\p{N}_]+)', 1)), list_concat(regexp_extract_all(t, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1), regexp_extract_all(t, '([\p{L}\p{N}_]{5,})', 1))) AS l FROM q), e AS (SELECT item_id, l[i] AS w, i FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM k)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(w) ORDER BY i) AS rn FROM e) SELECT item_id, string_agg(w, '|' ORDER BY i) AS keywords FROM r WHERE rn = 1 GROUP BY item_id""")
def f3(spark, sf_dir):
    text = F.expr("""concat('"', substr(text, 1, 12), '" « ', substr(text, 3, 9), '» “', substr(text, 5, 8), '” #tag NewYorkTimes ', text)""")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_keywords(text), "|").alias("keywords"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS["ru"])


@query("f4_bm25_terms", cte("queries") + rf", w AS (SELECT query_id, list_filter(regexp_split_to_array(lower(regexp_replace(query_text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: length(x) >= 2) AS ws FROM queries), f AS (SELECT query_id, ws, list_filter(ws, lambda x: x NOT IN ({_STOP})) AS fs FROM w), t AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(fs) > 0 THEN fs ELSE ws END) AS term FROM f) SELECT query_id, term, CASE WHEN length(term) >= 10 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM t")
def f4(spark, sf_dir):
    return view(spark, sf_dir, "queries").select("query_id", F.inline(T.bm25_terms(F.col("query_text"))))


@query("f8_message_link", cte("messages", "domains") + " SELECT msg_id, CASE WHEN channel_username IS NULL OR channel_username = '' THEN '' WHEN m.domain_id % 2 = 0 THEN 'https://t.me/' || channel_username || '/' || (msg_id % 9) || '/' || msg_id ELSE 'https://t.me/' || channel_username || '/' || msg_id END AS link FROM messages m LEFT JOIN domains USING (domain_id)")
def f8(spark, sf_dir):
    from ..functions.keys import message_link

    m = view(spark, sf_dir, "messages").join(view(spark, sf_dir, "domains").select("domain_id", "channel_username"), "domain_id", "left")
    return m.select("msg_id", message_link(F.col("channel_username"), F.col("msg_id"), F.when(F.col("domain_id") % 2 == 0, F.col("msg_id") % 9)).alias("link"))


@query("f9_count_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS n_tokens, regexp_extract(text, '^(?:\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])){0,20}') AS head FROM documents")
def f9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"), T.truncate_tokens(F.col("text"), 20).alias("head"))


_MARKED = "concat('### head\n**', substr(text, 1, 10), '** <x> [msg_id:  ', doc_id % 7, '] and [msg_id:3] ', text)"


@query("f10_html_refs", f"""WITH m AS (SELECT doc_id, replace(replace(replace({_MARKED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents), h AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*([^*]+)\\*\\*', '<b>\\1</b>', 'g'), '\\*([^*\\n]+)\\*', '<i>\\1</i>', 'g'), '(?m)^#{{1,6}} +', '', 'g') AS t FROM m) SELECT doc_id, regexp_replace(regexp_replace(t, '\\[msg_id:\\s*([35])\\]', '<a href="https://t.me/c/\\1">[link]</a>', 'g'), '\\[msg_id:\\s*\\d+\\]', '', 'g') AS html FROM h""")
def f10(spark, sf_dir):
    links = F.create_map(F.lit("3"), F.lit("https://t.me/c/3"), F.lit("5"), F.lit("https://t.me/c/5"))
    return table(spark, sf_dir, "documents").select("doc_id", T.html_refs(F.expr(_MARKED.replace("\n", "\\n")), links).alias("html"))


_ANSWER = """CASE doc_id % 4 WHEN 0 THEN concat('Here: {"n": ', doc_id, '} done') WHEN 1 THEN concat('```json\n{"n": ', doc_id, '}\n```') WHEN 2 THEN 'no object' ELSE '{broken' END"""


@query("f11_extract_json", """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN concat('{"n": ', doc_id, '}') END AS json, CASE WHEN doc_id % 4 < 2 THEN doc_id END AS n FROM documents""")
def f11(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.extract_json(F.expr(_ANSWER.replace("\n", "\\n"))).alias("json"))
    return found.select("doc_id", "json", F.from_json("json", "n long")["n"].alias("n"))


@query("f12_is_overview", "SELECT item_id, item_id % 3 = 0 AS overview FROM benchmark")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.is_overview(F.expr("CASE WHEN item_id % 3 = 0 THEN concat('Give me a SUMMARY of ', text) ELSE text END")).alias("overview"))


@query("f13_period_to_cutoff", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1095 DAY WHEN 2 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(1 + event_id % 30 AS INTEGER)) WHEN 3 THEN TIMESTAMP '2024-01-15 00:00:00' WHEN 4 THEN TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY END AS cutoff FROM events")
def f13(spark, sf_dir):
    from ..functions.keys import period_to_cutoff

    code = F.expr("CASE event_id % 6 WHEN 0 THEN '1w' WHEN 1 THEN '3y' WHEN 2 THEN concat(1 + event_id % 30, 'd') WHEN 3 THEN '2024-01-15' WHEN 4 THEN '3m' ELSE 'soon' END")
    return table(spark, sf_dir, "events").select("event_id", period_to_cutoff(code, now()).alias("cutoff"))


@query("f14_content_score", "SELECT doc_id, least(CAST(length(text) AS DOUBLE) / 100, 5.0::DOUBLE) AS score FROM documents")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_score(F.col("text")).alias("score"))


@query("f15_snippet", "SELECT doc_id, substr(text, 1, 500) AS snippet FROM documents")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), 500).alias("snippet"))


@query("f16_amount_to_points", "SELECT o_orderkey, CAST(floor(o_totalprice * 0.37::DOUBLE / 0.01::DOUBLE) AS BIGINT) AS points FROM orders")
def f16(spark, sf_dir):
    from ..functions.keys import amount_to_points

    return table(spark, sf_dir, "orders").select("o_orderkey", amount_to_points(F.col("o_totalprice"), F.lit(0.37)).alias("points"))


_SKIPPY = "CASE WHEN doc_id % 3 = 0 THEN concat('[SKIP] nothing\n \n', text, '\n[SKIP]') WHEN doc_id % 3 = 1 THEN '[SKIP]\n' ELSE text END"


@query("f17_skip_lines", f"SELECT doc_id, nullif(array_to_string(list_filter(string_split({_SKIPPY}, chr(10)), lambda l: NOT contains(l, '[SKIP]') AND trim(l) <> ''), chr(10)), '') AS kept FROM documents")
def f17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.skip_lines(F.expr(_SKIPPY.replace("\n", "\\n"))).alias("kept"))


@query("f7_thread_uuid", cte("messages") + f" SELECT msg_id, {THREAD_UUID_SQL.format('domain_id', 'msg_id')} AS thread_id FROM messages")
def f7(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("msg_id", thread_uuid(F.col("domain_id"), F.col("msg_id")).alias("thread_id"))


@query("a16_hashtags_backfill_agg", cte("messages") + f" SELECT msg_id, array_to_string(list_sort(list_distinct(list_transform({_TAGS}, lambda t: lower(t)))), '|') AS tags FROM messages")
def a16(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("msg_id", F.array_join(F.sort_array(T.backfilled_hashtags(F.col("content"))), "|").alias("tags"))


@query("u3_sql_functions", cte("messages") + rf" SELECT msg_id, CASE WHEN length(regexp_replace(content, '[^\p{{L}}]', '', 'g')) = 0 THEN 'unknown' ELSE 'en' END AS language, array_to_string({_TAGS}, '|') AS tags, least(CAST(length(content) AS DOUBLE) / 100, 5.0::DOUBLE) AS score, CASE msg_id % 3 WHEN 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY WHEN 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '{AS_OF}' - INTERVAL 12 DAY END AS cutoff FROM messages")
def u3(spark, sf_dir):
    from ..functions.keys import register_sql_functions

    register_sql_functions(spark)
    view(spark, sf_dir, "messages").createOrReplaceTempView("messages_view")
    return spark.sql("SELECT msg_id, detect_language(content) AS language, array_join(hashtags_of(content), '|') AS tags, content_score(content) AS score, period_to_cutoff(CASE msg_id % 3 WHEN 0 THEN '1w' WHEN 1 THEN '2024-01-15' ELSE '12D' END, timestamp_ntz'" + AS_OF + "') AS cutoff FROM messages_view")
