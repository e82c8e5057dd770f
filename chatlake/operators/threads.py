"""Conversation threads: reply chains and time groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import thread_uuid
from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import written
from .running import before_ranges, in_ranges, with_before

GAP_S = 300
KEY = ["domain_id", "msg_id"]


def sessionize(messages: DataFrame, keys: list[str], gap_s: int = GAP_S) -> DataFrame:
    """Splits each key's messages, in time order, where the gap is longer: session_start and session_no."""
    seconds = F.unix_micros(F.col("msg_date").cast("timestamp")) / 1_000_000
    dealt = in_ranges(messages, keys, seconds)
    if dealt is None:
        w = W.partitionBy(*keys).orderBy("msg_date", "msg_id")
        opens = F.coalesce((seconds - F.lag(seconds).over(w) > gap_s).cast("int"), F.lit(1))
        return messages.withColumn("_open", opens).withColumn("session_no", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_open")
    # a busy key: the first message of a range follows the last one of the ranges before
    w = W.partitionBy(*keys, "_part").orderBy("msg_date", "msg_id")
    both = with_before(dealt, before_ranges(dealt, keys, F.max(seconds), "_last", F.max), keys)
    opens = F.coalesce((seconds - F.coalesce(F.lag(seconds).over(w), "_last") > gap_s).cast("int"), F.lit(1))
    opened = written(both.withColumn("_open", opens).drop("_last"), "sessions")
    whole = with_before(opened, before_ranges(opened, keys, F.sum("_open"), "_before"), keys)
    return whole.withColumn("session_no", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))).drop("_open", "_part", "_before")


def reply_roots(messages: DataFrame, most_rounds: int = 32) -> DataFrame:
    """(domain_id, msg_id, root): the top ancestor that replies inside the batch reach, by pointer jumping.

    A reply to itself or to a message outside the batch has no parent. Each round doubles the depth and is written to the
    shared folder. A root that has a parent lies on a cycle; the smallest id of the cycle takes its place.
    """
    ids = messages.select(*KEY)
    parents = messages.where("reply_to_msg_id is not null and reply_to_msg_id <> msg_id").select("domain_id", "msg_id", F.col("reply_to_msg_id").alias("root"))
    inside = parents.join(ids.withColumnRenamed("msg_id", "root"), ["domain_id", "root"], "left_semi")
    first = ids.join(inside, KEY, "left").withColumn("top", F.col("root").isNull()).withColumn("root", F.coalesce("root", "msg_id"))
    now = written(first.withColumn("low", F.least("msg_id", "root")), "roots")
    for _ in range(most_rounds):
        jump = now.select("domain_id", F.col("msg_id").alias("root"), F.col("root").alias("next"), F.col("low").alias("next_low"))
        step = now.join(jump, ["domain_id", "root"], "left").select(*KEY, "top", F.col("root").alias("old"), F.col("next").alias("root"), F.least("low", "next_low").alias("low"))
        new = written(step, "roots")
        now = new.select(*KEY, "root", "top", "low")
        if not new.where("old <> root").take(1):
            break
    tops = now.select("domain_id", F.col("msg_id").alias("root"), F.col("top").alias("_top"), F.col("low").alias("_low"))
    return now.join(tops, ["domain_id", "root"]).select(*KEY, F.when(F.col("_top"), F.col("root")).otherwise(F.col("_low")).alias("root"))


def assign_threads(messages: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """messages with thread_root: chains by replies, the rest by time gaps within a domain."""
    rooted = messages.join(reply_roots(messages), KEY)
    child = (F.col("root") != F.col("msg_id")) | F.col("reply_to_msg_id").isNotNull()
    parents = rooted.where(child).select("domain_id", "root").distinct().withColumn("_parent", F.lit(True)).withColumnRenamed("root", "msg_id")
    marked = rooted.join(parents, KEY, "left").withColumn("_chain", child | F.coalesce("_parent", F.lit(False)))
    chains = marked.where("_chain").withColumn("thread_root", F.col("root"))
    rest = sessionize(marked.where("not _chain"), ["domain_id"], gap_s)
    first = W.partitionBy("domain_id", "session_no").orderBy("msg_date", "msg_id")
    groups = rest.withColumn("thread_root", F.first("msg_id").over(first)).drop("session_no")
    return chains.unionByName(groups).drop("_chain", "_parent", "root")


def grown_threads(labelled: DataFrame, fresh: DataFrame, gap_s: int = GAP_S) -> tuple[DataFrame, DataFrame]:
    """After new messages: the messages whose thread may have changed, new ones included, with thread_root, and the threads (domain_id,
    thread_root) that they take the place of. Whatever the order in which messages come, the threads are those of `assign_threads` over all.

    labelled: known messages with thread_root. Touched is a thread with a message that a new one replies to, that replies to a new one (a root that
    comes late), or that stands within the gap of a new one in time; only these are taken apart and put together again.
    """
    known = labelled.select(*KEY, "reply_to_msg_id", "msg_date", "thread_root")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    new = fresh.select("domain_id", F.col("msg_id").alias("_new"), F.col("reply_to_msg_id").alias("_to"), seconds("msg_date").alias("_at"))
    answered = known.join(new.select("domain_id", F.col("_to").alias("msg_id")).distinct(), KEY, "left_semi")
    answering = known.join(new.select("domain_id", F.col("_new").alias("reply_to_msg_id")), ["domain_id", "reply_to_msg_id"], "left_semi")
    # within the gap: in the same stretch of that length, or in one beside it
    stretch = F.floor(F.col("_at") / gap_s)
    timed = new.where("_at is not null").select("domain_id", "_at", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_stretch"))
    spans = timed.groupBy("domain_id", "_stretch").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    at = known.withColumn("_y", seconds("msg_date")).withColumn("_stretch", F.floor(F.col("_y") / gap_s))
    beside = at.join(spans, ["domain_id", "_stretch"]).where((F.col("_y") >= F.col("_first") - gap_s) & (F.col("_y") <= F.col("_last") + gap_s))
    thread = ["domain_id", "thread_root"]
    touched = written(answered.select(*thread).union(answering.select(*thread)).union(beside.select(*thread)).distinct(), "threads-touched")
    again = labelled.join(touched, thread, "left_semi").drop("thread_root")
    return written(assign_threads(written(again.unionByName(fresh, allowMissingColumns=True), "threads-again"), gap_s), "threads-grown"), touched


def thread_agg(assigned: DataFrame) -> DataFrame:
    """A row per thread: id, combined text in date order, first and last date, number of messages."""
    line = F.concat(F.coalesce(F.concat(F.lit("["), F.col("sender_name"), F.lit("] ")), F.lit("")), F.coalesce("content", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("msg_date", "msg_id", line.alias("line")))), lambda x: x["line"])
    out = assigned.groupBy("domain_id", "thread_root").agg(F.array_join(lines, "\n").alias("text"), F.min("msg_date").alias("first_date"), F.max("msg_date").alias("last_date"), F.count("*").alias("n_messages"))
    return out.withColumn("thread_id", thread_uuid(F.col("domain_id"), F.col("thread_root")))


def build_threads(messages: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    return thread_agg(assign_threads(messages, gap_s))


THREADS_SQL = cte("messages").replace("WITH ", "WITH RECURSIVE ", 1) + """,
up AS (
  SELECT domain_id, msg_id, msg_id AS root FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages p WHERE p.domain_id = m.domain_id AND p.msg_id = m.reply_to_msg_id AND p.msg_id <> m.msg_id)
  UNION ALL
  SELECT m.domain_id, m.msg_id, up.root FROM messages m JOIN up ON m.domain_id = up.domain_id AND m.reply_to_msg_id = up.msg_id AND m.msg_id <> up.msg_id),
r AS (SELECT m.*, up.root, up.root <> m.msg_id OR m.reply_to_msg_id IS NOT NULL AS child FROM messages m JOIN up USING (domain_id, msg_id)),
c AS (SELECT *, child OR EXISTS (SELECT 1 FROM r q WHERE q.child AND q.domain_id = r.domain_id AND q.root = r.msg_id) AS chain FROM r),
g AS (SELECT *, CASE WHEN date_diff('second', lag(msg_date) OVER (PARTITION BY domain_id ORDER BY msg_date, msg_id), msg_date) <= 300 THEN 0 ELSE 1 END AS opens FROM c WHERE NOT chain),
s AS (SELECT *, sum(opens) OVER (PARTITION BY domain_id ORDER BY msg_date, msg_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g),
t AS (SELECT domain_id, msg_id, sender_name, content, msg_date, root AS thread_root FROM c WHERE chain
  UNION ALL SELECT domain_id, msg_id, sender_name, content, msg_date, first(msg_id) OVER (PARTITION BY domain_id, session_no ORDER BY msg_date, msg_id) FROM s)"""


@query("w1_threads", THREADS_SQL + " SELECT domain_id, msg_id, thread_root FROM t")
def w1(spark, sf_dir):
    return assign_threads(view(spark, sf_dir, "messages")).select("domain_id", "msg_id", "thread_root")


@query("w2_sessionize", cte("messages") + ", g AS (SELECT *, CASE WHEN date_diff('second', lag(msg_date) OVER (PARTITION BY domain_id ORDER BY msg_date, msg_id), msg_date) <= 300 THEN 0 ELSE 1 END AS opens FROM messages) SELECT msg_id, CAST(sum(opens) OVER (PARTITION BY domain_id ORDER BY msg_date, msg_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g")
def w2(spark, sf_dir):
    return sessionize(view(spark, sf_dir, "messages"), ["domain_id"]).select("msg_id", "session_no")


@query("a14_thread_agg", THREADS_SQL + " SELECT domain_id, thread_root, string_agg(coalesce('[' || sender_name || '] ', '') || coalesce(content, ''), chr(10) ORDER BY msg_date, msg_id) AS text, min(msg_date) AS first_date, max(msg_date) AS last_date, count(*) AS n_messages FROM t GROUP BY 1, 2")
def a14(spark, sf_dir):
    return build_threads(view(spark, sf_dir, "messages")).drop("thread_id")
