"""Structured Streaming forms: cleaning, ingestion, sessions, de-duplication, payments, counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.graph import merge_graph
from ..operators.threads import GAP_S
from ..plans.mapreduce import _CLEAN, _tables_sql, enriched, ingest_part, tables_of, topics_filled
from ..plans.upkeep import mark_changed
from ..registry import SQL, query
from ..sources import messages as _messages  # noqa: F401  its queries' SQL
from ..sources.fixtures import cte, view
from ..sources.stream import stream_log, write_log
from ..sources.tables import new_path, written


def stream_clean(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """New messages -> clean messages, appended to a Parquet folder; the checkpoint takes the place of a last id."""
    return enriched(messages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INGESTED = ("messages", "threads", "vectors", "tags", "entities", "relations", "failures")


def stream_ingest(messages: DataFrame, path: str, checkpoint: str, **models) -> StreamingQuery:
    """Every micro-batch adds its clean messages, threads, vectors, tag counts and graph: a folder per table and batch, overwritten
    if the batch is run again. Messages that earlier batches have stored are left out, so that a late copy adds nothing but a topic that
    the first one lacked (M1). Of what earlier batches have seen, a batch reads the ids between its own smallest and largest: files of others are skipped.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, ["domain_id", "msg_id"]
        batch = written(batch, "ingest-batch")
        once = batch.dropDuplicates(key)
        fresh = topics_filled(once, batch)
        if number:
            low, high = batch.agg(F.min("msg_id"), F.max("msg_id")).first()
            seen = spark.read.schema("domain_id long, msg_id long, batch long").option("basePath", f"{path}/seen").parquet(f"{path}/seen")
            before = seen.where(F.col("batch") < number).where(F.col("msg_id").between(low, high) if low is not None else F.lit(False))
            fresh = fresh.join(before.select(*key), key, "left_anti")
        fresh = written(fresh, "ingest-fresh")
        part = ingest_part(fresh, **models)
        for name, table in part.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        if "topic_id" in batch.columns:
            late = batch.where("topic_id is not null").join(fresh.select(*key), key, "left_anti")
            late.groupBy(*key).agg(F.min("topic_id").alias("topic_id")).write.mode("overwrite").parquet(f"{path}/topics/batch={number}")
        fresh.select(*key).repartitionByRange(1, "msg_id").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str, summaries: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ingested batches as tables: tag counts are summed, the graph is merged, the latest batch winning on attributes, topics that came
    later are filled in, the earliest first; summaries of tags, where they are given, are marked stale by all that has come since."""
    read = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    out = {name: read(name) for name in INGESTED}
    entities = out["entities"].groupBy("domain_id", "name").agg(F.max_by(F.struct("type", "confidence"), F.struct("batch", "type")).alias("a"), F.sum("n_threads").alias("n_threads")).select("domain_id", "name", "a.*", "n_threads")
    tags = out["tags"].groupBy("domain_id", "tag").agg(F.sum("n_posts").alias("n_posts"))
    entities, relations = merge_graph(entities.limit(0), entities, out["relations"].drop("batch").limit(0), out["relations"].drop("batch"))
    messages = out["messages"].drop("batch")
    if "topic_id" in messages.columns:
        later = read("topics").groupBy("domain_id", "msg_id").agg(F.min_by("topic_id", F.struct("batch", "topic_id")).alias("topic_id"))
        messages = topics_filled(messages, later)
    merged = {name: df.drop("batch") for name, df in out.items()} | {"messages": messages, "tags": tags, "entities": entities, "relations": relations}
    return merged | ({"summaries": mark_changed(summaries, messages)} if summaries is not None else {})


def stream_threads(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Time groups of a stream: a gap of more than GAP_S ends one."""
    timed = messages.withColumn("at", F.col("msg_date").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("domain_id", F.session_window("at", f"{GAP_S} seconds").alias("w")).agg(F.count("*").alias("n_messages"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).drop("w")


def stream_dedup(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """One message per (domain, id) within the watermark, which bounds the state."""
    return messages.withColumn("at", F.col("msg_date").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["domain_id", "msg_id"])


def stream_payments(requests: DataFrame, payments: DataFrame, window_s: int = 300, share: float = 0.95, late: str = "10 minutes") -> DataFrame:
    """Requests with each payment that fits in time; unmatched ones come out, with nulls, when their window has closed."""
    r = requests.withWatermark("requested_at", late)
    p = payments.select(F.col("comment").alias("p_comment"), F.col("amount").alias("p_amount"), "paid_at", "payment_id").withWatermark("paid_at", late)
    fits = (F.col("comment") == F.col("p_comment")) & (F.col("p_amount") >= share * F.col("expected")) & (F.col("paid_at") >= F.col("requested_at")) & (F.col("paid_at") <= F.col("requested_at") + F.expr(f"INTERVAL {window_s} SECONDS"))
    return r.join(p, fits, "leftOuter").select("request_id", "payment_id")


def stream_counters(messages: DataFrame) -> DataFrame:
    """Messages and last id per domain, kept current (update mode)."""
    return messages.groupBy("domain_id").agg(F.count("*").alias("n_messages"), F.max("msg_id").alias("last_id"))


def stale_counters(tags: DataFrame, least: int = 100) -> DataFrame:
    """(domain_id, tag) rows -> per micro-batch and tag: posts seen, new posts since the last summary, and how many summaries came
    due, one with each `least` posts. Custom state per tag."""

    def count(key, batches, state):
        n = state.get[0] if state.exists else 0
        seen = sum(len(b) for b in batches)
        due, left = divmod(n + seen, least)
        state.update((left,))
        yield pd.DataFrame({"domain_id": [key[0]], "tag": [key[1]], "seen": [seen], "new_posts": [left], "due": [due]})

    return tags.groupBy("domain_id", "tag").applyInPandasWithState(count, "domain_id long, tag string, seen long, new_posts long, due long", "n long", "update", "NoTimeout")


# ---- each stream, run to the end of the given table's messages, as files

def _stream(spark: SparkSession, df: DataFrame, files: int | None = 4) -> DataFrame:
    """df as a stream of files in the shared folder, two a batch; files None: as df's tasks write them, all in one batch."""
    base = new_path(spark, "stream")
    (df if files is None else df.repartition(files)).write.parquet(base)
    reader = spark.readStream.schema(df.schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", 2)).parquet(base)


def _run(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """All rows a stream gives until its input ends."""
    where = new_path(spark, "stream-out")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", new_path(spark, "stream-check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).option("basePath", where).parquet(f"{where}/batch=*").select(*out.columns)


@query("t1_stream_clean", _CLEAN + "SELECT domain_id, msg_id, 'en' AS language FROM m")
def t1(spark, sf_dir):
    where = new_path(spark, "clean")
    stream_clean(_stream(spark, view(spark, sf_dir, "messages")), where, new_path(spark, "check")).awaitTermination()
    return spark.read.parquet(where).select("domain_id", "msg_id", "language")


@query("s2_stream_fetch", SQL["s2_incremental_fetch"])
def s2_stream(spark, sf_dir):
    m, path = view(spark, sf_dir, "messages"), new_path(spark, "log")
    write_log(m, path)
    # an offset is an entry a domain
    after = {r.domain_id: r.last for r in m.where("msg_id < 5000").groupBy("domain_id").agg(F.max("msg_id").alias("last")).collect()}
    got = _run(spark, stream_log(spark, path, "domain_id long, msg_id long, msg_date timestamp_ntz", after), "append")
    return got.where("msg_date >= timestamp_ntz'2024-01-01 12:00:00'").select("domain_id", "msg_id")


@query("t2_stream_ingest", _CLEAN + _tables_sql())
def t2(spark, sf_dir):
    m, where = view(spark, sf_dir, "messages"), new_path(spark, "ingest")
    stream_ingest(_stream(spark, m.unionByName(m)), where, new_path(spark, "check")).awaitTermination()
    return tables_of(snapshot(spark, where))


@query("t3_stream_threads", cte("messages") + ", g AS (SELECT *, CASE WHEN date_diff('second', lag(msg_date) OVER (PARTITION BY domain_id ORDER BY msg_date, msg_id), msg_date) <= 300 THEN 0 ELSE 1 END AS opens FROM messages), s AS (SELECT *, sum(opens) OVER (PARTITION BY domain_id ORDER BY msg_date, msg_id ROWS UNBOUNDED PRECEDING) AS no FROM g), t AS (SELECT domain_id, count(*) AS n_messages, max(msg_date) AS last_at FROM s GROUP BY domain_id, no) SELECT domain_id, n_messages FROM t")
def t3(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    # a message of a later day ends what is open, and its own group stays open
    end = m.orderBy(F.desc("msg_date")).limit(1).withColumn("domain_id", F.lit(-1).cast("long")).withColumn("msg_date", F.col("msg_date") + F.expr("INTERVAL 2 DAYS"))
    return _run(spark, stream_threads(_stream(spark, m.unionByName(end), None), "10 minutes"), "append").select("domain_id", "n_messages")


@query("t4_stream_dedup", cte("messages") + " SELECT domain_id, msg_id FROM messages")
def t4(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    return _run(spark, stream_dedup(_stream(spark, m.unionByName(m), None), "60 days"), "append").select("domain_id", "msg_id")


@query("t5_stream_payments", "SELECT r.event_id AS request_id, p.event_id AS payment_id FROM events r JOIN events p ON p.user_id = r.user_id AND r.event_type = 'click' AND p.event_type = 'purchase' AND p.value >= 0.95::DOUBLE * r.value AND p.ts >= r.ts AND p.ts <= r.ts + INTERVAL 6 HOURS")
def t5(spark, sf_dir):
    from ..sources.fixtures import table

    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    requests = e.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("comment"), F.col("value").alias("expected"), F.col("at").alias("requested_at"))
    payments = e.where("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), F.col("user_id").alias("comment"), F.col("value").alias("amount"), F.col("at").alias("paid_at"))
    return _run(spark, stream_payments(_stream(spark, requests, None), _stream(spark, payments, None), 6 * 3600, late="90 days"), "append").where("payment_id is not null")


@query("t6_stream_counters", cte("messages") + " SELECT domain_id, count(*) AS n_messages, max(msg_id) AS last_id FROM messages GROUP BY domain_id")
def t6(spark, sf_dir):
    out = _run(spark, stream_counters(_stream(spark, view(spark, sf_dir, "messages"))), "update")
    return out.groupBy("domain_id").agg(F.max("n_messages").alias("n_messages"), F.max("last_id").alias("last_id"))


STALE = 7


@query("t6_stale_counters", cte("messages") + rf" SELECT domain_id, tag, count(*) AS n_posts, CAST(count(*) // {STALE} AS BIGINT) AS n_due FROM (SELECT domain_id, unnest(regexp_extract_all(content, '#([\p{{L}}\p{{N}}_]+)', 1)) AS tag FROM messages) GROUP BY 1, 2")
def t6s(spark, sf_dir):
    tags = view(spark, sf_dir, "messages").select("domain_id", F.explode(T.hashtags(F.col("content"))).alias("tag"))
    out = _run(spark, stale_counters(_stream(spark, tags), STALE), "update")
    return out.groupBy("domain_id", "tag").agg(F.sum("seen").alias("n_posts"), F.sum("due").alias("n_due"))
