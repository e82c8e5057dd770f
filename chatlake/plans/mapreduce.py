"""Map-reduce over posts, digests, and whole ingestion runs."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import THREAD_UUID_SQL, message_link, thread_uuid
from ..operators.clean import drop_digest_posts, with_noise
from ..operators.graph import communities, merge_graph
from ..operators.models import Model, apply_model, extract_entities
from ..operators.similar import dedup_semantic, greedy_clusters
from ..operators.tables import posts_per_hashtag, reply_counts, representatives, top_per_key
from ..operators.threads import THREADS_SQL, assign_threads, build_threads, grown_threads, thread_agg
from ..operators.vectors import hash_embed, vector_docs
from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import new_path, written


def summarise(text: Column, sentences: int = 2) -> Column:
    """The first sentences: the default in a summarising model's place."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, sentences), " ")


def summarised(df: DataFrame, keys: list[str], text: str, sentences: int = 2, model: Model | None = None) -> DataFrame:
    """df with its text summarised: by a model (a string for each text; where it fails, and without one, the first sentences)."""
    if model is None:
        return df.withColumn(text, summarise(F.col(text), sentences))
    got = apply_model(df.select(F.struct(*keys).alias("at"), F.col(text).alias("text")), model, "at").select("at.*", F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("_said"))
    return df.join(got, keys, "left").withColumn(text, F.coalesce("_said", summarise(F.col(text), sentences))).drop("_said")


def map_reduce(posts: DataFrame, batch: int = 15, chars: int = 1500, most_tokens: int = 12_000, group: int = 4, most_rounds: int = 5, model: Model | None = None) -> DataFrame:
    """(key, id, rank, content) -> a row per key: text, n_posts, output budget.

    Batches of posts are mapped to summaries; while a key's summaries hold too many tokens, groups of them collapse. A model
    summarises whole batches and groups; by default each post gives its first sentences, and each group its first ten.
    """
    n = posts.groupBy("key").agg(F.count("*").alias("n_posts"))
    joined = lambda order, c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(c).alias("x")))), lambda s: s["x"]), sep)
    line = F.substring("content", 1, chars)
    numbered = posts.withColumn("i", F.floor((F.col("rank") - 1) / batch)).withColumn("line", line if model else summarise(line))
    parts = numbered.groupBy("key", "i").agg(joined("rank", "line", "\n").alias("text"))
    parts = summarised(parts, ["key", "i"], "text", model=model) if model else parts
    parts = parts.withColumn("text", T.skip_lines(F.col("text"))).where("text is not null")
    for _ in range(most_rounds):
        parts = written(parts, "map-reduce")
        over = parts.groupBy("key").agg(F.sum(T.count_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n")).where((F.col("tokens") > most_tokens) & (F.col("n") > 1)).select("key")
        if not over.take(1):
            break
        shrink = parts.join(over, "key", "left_semi").withColumn("g", F.floor(F.col("i") / group)).groupBy("key", "g").agg(joined("i", "text", "\n").alias("text"))
        parts = parts.join(over, "key", "left_anti").unionByName(summarised(shrink.select("key", F.col("g").alias("i"), "text"), ["key", "i"], "text", 10, model))
    budget = F.greatest(F.lit(4096), F.least(120 * F.col("n_posts"), F.lit(16_384)))
    return parts.groupBy("key").agg(joined("i", "text", "\n").alias("text")).join(n, "key").select("key", "text", "n_posts", budget.alias("output_budget"))


@query("m5_map_reduce")
def m5(spark, sf_dir):
    p = view(spark, sf_dir, "posts").select(F.col("domain_id").alias("key"), "id", "content")
    return map_reduce(top_per_key(p, ["key"], 200, F.col("id")).select("key", "id", "rank", "content"))


def digest(messages: DataFrame, configs: DataFrame, as_of: Column, domains: DataFrame | None = None, most: int = 200, threshold: float = 0.92, like: float = 0.55, model: Model | None = None) -> DataFrame:
    """Digests of all configs in one job: a row per (config_id, cluster_id), and one per config, without cluster, that combines them.

    configs: config_id, domain_id, days. Posts are scored and cut to `most` per config before any are compared. Summaries name their
    posts as `[msg_id: N]`, which become links to the domains' channels, or vanish where none is known.
    """
    window = messages.join(configs, "domain_id").where(F.col("msg_date") >= as_of - F.make_dt_interval(F.col("days")))
    clean = drop_digest_posts(with_noise(window).where("not is_noise"))
    scored = clean.join(reply_counts(messages), ["domain_id", "msg_id"], "left").withColumn("score", 3 * F.coalesce("n_replies", F.lit(0)) + T.content_score(F.col("content")))
    top = top_per_key(scored, ["config_id"], most, F.desc("score"), F.col("msg_id"))
    posts = written(top.select(F.col("config_id").alias("batch"), F.col("msg_id").alias("id"), "domain_id", "score", F.col("content").alias("text"), hash_embed(F.substring("content", 1, 2000)).alias("embedding")), "digest-posts")
    kept = posts.join(dedup_semantic(posts, threshold), ["batch", "id"], "left_semi")
    clustered = written(greedy_clusters(kept, like).join(posts.select("batch", "id", "text"), ["batch", "id"]), "digest-clusters")
    one = representatives(clustered.withColumn("cluster_id", F.struct("batch", "cluster_id")))
    said = F.concat(F.lit("- "), summarise(F.col("snippet"), 1), F.lit(" [msg_id: "), F.col("id").cast("string"), F.lit("]"))
    lines = one.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("s")))), lambda x: x["s"]), "\n").alias("summary"))
    lines = summarised(lines.select("cluster_id.*", "summary"), ["batch", "cluster_id"], "summary", model=model) if model else lines.select("cluster_id.*", "summary")
    sizes = clustered.groupBy("batch", "cluster_id").agg(F.count("*").alias("n_posts"), F.min_by("text", "position").alias("label"))
    clusters = written(sizes.join(lines, ["batch", "cluster_id"]).withColumn("label", T.snippet(F.col("label"), 80)), "digest-lines")
    # the combine step: large clusters first, under a heading each
    section = F.concat(F.lit("### "), "label", F.lit("\n"), "summary")
    order = F.struct((F.col("cluster_id") < 0).alias("misc"), (-F.col("n_posts")).alias("size"), "cluster_id", section.alias("s"))
    whole = clusters.groupBy("batch").agg(F.sum("n_posts").alias("n_posts"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["s"]), "\n\n").alias("summary")).withColumn("label", F.lit("digest")).withColumn("cluster_id", F.lit(None).cast("long"))
    whole = summarised(whole, ["batch"], "summary", model=model) if model else whole
    rows = clusters.unionByName(whole.select(*clusters.columns))
    named = domains.select("domain_id", "channel_username") if domains is not None else messages.select("domain_id", F.lit(None).cast("string").alias("channel_username")).limit(0)
    linked = posts.select("batch", "id", "domain_id").join(named, "domain_id").withColumn("link", message_link(F.col("channel_username"), F.col("id"))).where("link <> ''")
    # at most `most` posts a config
    maps = linked.groupBy("batch").agg(F.map_from_entries(F.collect_set(F.struct(F.col("id").cast("string"), "link"))).alias("links"))
    out = rows.join(maps, "batch", "left").withColumn("links", F.coalesce("links", F.create_map().cast("map<string,string>")))
    return out.select(F.col("batch").alias("config_id"), "cluster_id", "n_posts", "label", T.html_refs(F.col("summary"), F.col("links")).alias("summary"))


@query("m4_digest")
def m4(spark, sf_dir):
    from ..operators.clean import now

    m = view(spark, sf_dir, "messages")
    configs = m.select("domain_id").distinct().select((F.col("domain_id") + 100).alias("config_id"), "domain_id", F.lit(30).alias("days"))
    return digest(m, configs, now(), view(spark, sf_dir, "domains"))


def embedded(df: DataFrame, key: str, text: str, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, embedding) of each text's first 8192 characters, and (key, error) of those for which the model failed."""
    cut = df.select(key, F.substring(text, 1, 8192).alias("text"))
    if model is None:
        none = df.select(key, F.lit(None).cast("string").alias("error")).limit(0)
        return cut.select(key, hash_embed(F.col("text")).alias("embedding")), none
    got = written(apply_model(cut, model, key, "text", 4), "embedded")
    return got.where("error is null").select(key, F.from_json("value", "array<double>").alias("embedding")), got.where("error is not null").select(key, "error")


def enriched(messages: DataFrame, watch: Observation | None = None) -> DataFrame:
    """The columns that cleaning adds, for batch and stream alike. watch: counts what goes through, noise and all."""
    marked = with_noise(messages)
    if watch is not None:
        marked = marked.observe(watch, F.count(F.lit(1)).alias("n_all"), F.count_if("is_noise").alias("n_noise"), F.count_if(~F.col("is_noise")).alias("n_clean"), F.count_if(F.col("reply_to_msg_id").isNotNull()).alias("n_replies"))
    return marked.where("not is_noise").withColumn("language", T.detect_language(F.col("content"))).withColumn("hashtags", T.hashtags(F.col("content")))


def ingest_initial(messages: DataFrame, embed_model: Model | None = None, graph_model: Model | None = None, watch: Observation | None = None) -> dict[str, DataFrame]:
    """Messages -> clean messages, threads, vectors, tags, entities, relations, communities, failures: the tables of one run.

    A text for which a model fails is a row of `failures` and missing in that table; the run goes on.
    """
    out = ingest_part(messages, embed_model, graph_model, watch)
    entities, relations = merge_graph(out["entities"].limit(0), out["entities"], out["relations"].limit(0), out["relations"])
    relations = written(relations, "ingest-relations")
    return out | {"entities": entities, "relations": relations, "communities": communities(relations)}


def ingest_part(messages: DataFrame, embed_model: Model | None = None, graph_model: Model | None = None, watch: Observation | None = None) -> dict[str, DataFrame]:
    """The tables that some messages add: nothing is merged with what is known already."""
    clean = written(enriched(messages, watch), "ingest-clean")
    threads = written(build_threads(clean), "ingest-threads")
    vectors, failed = embedded(threads, "thread_id", "text", embed_model)
    entities, relations = extract_entities(threads, model=graph_model)
    return {"messages": clean, "threads": threads, "vectors": vector_docs(threads, vectors), "tags": posts_per_hashtag(clean), "entities": entities, "relations": relations, "failures": failed.withColumn("step", F.lit("embed"))}


def ingest_run(messages: DataFrame, embed_model: Model | None = None, graph_model: Model | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of `ingest_initial`, each written, and the run in one row: when it began and ended, its seconds, messages (all, noise, clean,
    replies) and n_NAME of each table. All are counted as they are written: no table is read again for it."""
    began, watch, counts = time.time(), Observation(), {}
    out = ingest_initial(messages, embed_model, graph_model, watch)
    for name, df in out.items():
        seen = Observation()
        out[name] = written(df.observe(seen, F.count(F.lit(1)).alias("n")), f"run-{name}")
        counts[f"n_{name}"] = seen.get["n"]
    ended = time.time()
    row = {"started_at": began, "finished_at": ended, "duration_s": ended - began} | watch.get | counts
    kinds = {name: "double" if name in ("started_at", "finished_at", "duration_s") else "long" for name in row}
    stats = messages.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return out, stats.withColumns({c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long")) for c in ("started_at", "finished_at")})


def topics_filled(known: DataFrame, again: DataFrame) -> DataFrame:
    """Known messages gain the topic that a message sent again has, if they had none (M1)."""
    if "topic_id" not in known.columns or "topic_id" not in again.columns:
        return known
    key = ["domain_id", "msg_id"]
    topics = again.where("topic_id is not null").groupBy(*key).agg(F.min("topic_id").alias("_topic"))
    return known.join(topics, key, "left").withColumn("topic_id", F.coalesce("topic_id", "_topic")).select(*known.columns)


def ingest_incremental(known: dict[str, DataFrame], messages: DataFrame, embed_model: Model | None = None, graph_model: Model | None = None, across: bool = False) -> dict[str, DataFrame]:
    """The known tables after new messages: M1 on messages, threads and vectors of the new ones, tag counts, G1 on the graph.

    Messages that are known already only gain a topic that they lacked. Tag summaries, where they are among the known tables, become stale where new
    messages have their tag. Communities stay as they are until the next whole run.
    """
    from .upkeep import mark_changed

    key = ["domain_id", "msg_id"]
    once = messages.dropDuplicates(key)
    if "topic_id" in messages.columns:  # of equal messages, one with a topic
        once = topics_filled(once, messages)
    fresh = once.join(known["messages"].select(*key), key, "left_anti")
    part = ingest_part(fresh, embed_model, graph_model)
    counted = known["tags"].unionByName(part["tags"]).groupBy("domain_id", "tag").agg(F.sum("n_posts").alias("n_posts"))
    entities, relations = merge_graph(known["entities"], part["entities"], known["relations"], part["relations"])
    before = known | {"messages": topics_filled(known["messages"], messages)}
    grown = {name: before[name].unionByName(part[name]) for name in ("messages", "threads", "vectors", "failures")}
    if across:
        grown |= _threads_across(known, before["messages"], part["messages"], embed_model)
    if "summaries" in known:
        grown["summaries"] = mark_changed(known["summaries"], part["messages"])
    return known | grown | {"tags": counted, "entities": entities, "relations": relations}


def _threads_across(known: dict[str, DataFrame], before: DataFrame, fresh: DataFrame, embed_model: Model | None) -> dict[str, DataFrame]:
    """threads, vectors, failures and labels (domain_id, msg_id, thread_root) of the known messages and the new ones together."""
    key = ["domain_id", "msg_id"]
    labels = known["labels"] if "labels" in known else assign_threads(before).select(*key, "thread_root")
    changed, touched = grown_threads(before.join(labels, key), fresh)
    threads = written(thread_agg(changed), "threads-made")
    vectors, failed = embedded(threads, "thread_id", "text", embed_model)
    gone = touched.select(thread_uuid(F.col("domain_id"), F.col("thread_root")).alias("thread_id"))
    kept = {name: known[name].join(gone, "thread_id", "left_anti") for name in ("threads", "vectors", "failures")}
    made = {"threads": threads, "vectors": vector_docs(threads, vectors), "failures": failed.withColumn("step", F.lit("embed"))}
    new_labels = changed.select(*key, "thread_root")
    return {name: kept[name].unionByName(made[name]) for name in kept} | {"labels": labels.join(new_labels, key, "left_anti").unionByName(new_labels)}


def _tables_sql() -> str:
    """What an ingestion gives, as (name, a, b, n): every message, the tags' counts, the tag entities."""
    tags = r"regexp_extract_all(content, '#([\p{L}\p{N}_]+)', 1)"
    return rf"SELECT 'messages' AS name, domain_id AS a, CAST(msg_id AS VARCHAR) AS b, 1 AS n FROM m UNION ALL SELECT 'tags', domain_id, tag, count(*) FROM (SELECT domain_id, unnest({tags}) AS tag FROM m) GROUP BY 2, 3 UNION ALL SELECT DISTINCT 'entities', domain_id, tag, 1 FROM (SELECT domain_id, unnest({tags}) AS tag FROM m)"


def tables_of(got: dict[str, DataFrame]) -> DataFrame:
    """(name, a, b, n) of an ingestion's messages, tags and tag entities."""
    rows = got["messages"].select(F.lit("messages").alias("name"), F.col("domain_id").alias("a"), F.col("msg_id").cast("string").alias("b"), F.lit(1).cast("long").alias("n"))
    rows = rows.unionByName(got["tags"].select(F.lit("tags").alias("name"), F.col("domain_id").alias("a"), F.col("tag").alias("b"), F.col("n_posts").alias("n")))
    return rows.unionByName(got["entities"].where("type = 'Tag'").select(F.lit("entities").alias("name"), F.col("domain_id").alias("a"), F.col("name").alias("b"), F.lit(1).cast("long").alias("n")))


_CLEAN = cte("messages") + ", m AS (SELECT * FROM messages WHERE content_type NOT IN ('sticker') AND NOT (content_type = 'poll' AND trim(coalesce(content, '')) = '') AND NOT (length(trim(coalesce(content, ''))) < 5 AND reply_to_msg_id IS NULL)) "


@query("m9_ingest_initial", _CLEAN + _tables_sql() + " UNION ALL SELECT 'in_threads', NULL, NULL, count(*) FROM m")
def m9(spark, sf_dir):
    got = ingest_initial(view(spark, sf_dir, "messages"))
    return tables_of(got).unionByName(got["threads"].select(F.lit("in_threads").alias("name"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("string").alias("b"), "n_messages").groupBy("name", "a", "b").agg(F.sum("n_messages").alias("n")))


@query("m9_ingest_incremental", _CLEAN + _tables_sql())
def m9_incremental(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    first = ingest_initial(m.where("pmod(xxhash64(msg_id div 100), 2) = 0"))
    return tables_of(ingest_incremental(first, m))


def _clean_threads(also: str = "TRUE") -> str:
    """THREADS_SQL over clean messages."""
    clean = f"clean AS (SELECT * FROM messages WHERE content_type NOT IN ('sticker') AND NOT (content_type = 'poll' AND trim(coalesce(content, '')) = '') AND NOT (length(trim(coalesce(content, ''))) < 5 AND reply_to_msg_id IS NULL) AND {also}), up AS ("
    return THREADS_SQL.replace("FROM messages", "FROM clean").replace("JOIN messages", "JOIN clean").replace("up AS (", clean, 1)


_VECTOR_DOCS = f", a AS (SELECT domain_id, thread_root, string_agg(coalesce('[' || sender_name || '] ', '') || coalesce(content, ''), chr(10) ORDER BY msg_date, msg_id) AS text, min(msg_date) AS first_date FROM t GROUP BY 1, 2) SELECT {THREAD_UUID_SQL.format('domain_id', 'thread_root')} AS thread_id, domain_id, substr(text, 1, 32000) AS content, CAST(epoch(first_date) AS BIGINT) AS msg_ts FROM a WHERE trim(text) <> ''"


@query("w1_threads_across", _clean_threads() + " SELECT domain_id, msg_id, thread_root FROM t")
def w1_across(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    known = ingest_initial(m.where("pmod(xxhash64(msg_id), 3) = 0"))
    known = ingest_incremental(known, m.where("pmod(xxhash64(msg_id), 3) = 1"), across=True)
    return ingest_incremental(known, m, across=True)["labels"]


@query("a10_ingestion_run", _CLEAN + r", e AS (SELECT DISTINCT domain_id, unnest(regexp_extract_all(content, '#([\p{L}\p{N}_]+)', 1)) AS tag FROM m) SELECT (SELECT count(*) FROM messages) AS n_all, (SELECT count(*) FROM messages) - (SELECT count(*) FROM m) AS n_noise, (SELECT count(*) FROM m) AS n_clean, (SELECT count(reply_to_msg_id) FROM messages) AS n_replies, (SELECT count(*) FROM m) AS n_messages, (SELECT count(*) FROM e) AS n_tags, true AS timed")
def a10_run(spark, sf_dir):
    stats = ingest_run(view(spark, sf_dir, "messages"))[1]
    return stats.select("n_all", "n_noise", "n_clean", "n_replies", "n_messages", "n_tags", ((F.col("duration_s") > 0) & (F.col("finished_at") > F.col("started_at"))).alias("timed"))


@query("s7_vector_docs", THREADS_SQL + _VECTOR_DOCS)
def s7(spark, sf_dir):
    threads = build_threads(view(spark, sf_dir, "messages"))
    return vector_docs(threads, threads.select("thread_id", hash_embed(F.col("text")).alias("embedding"))).select("thread_id", "domain_id", "content", "msg_ts")


def reembed(messages: DataFrame, domains: DataFrame, path: str) -> DataFrame:
    """All vectors of active domains from stored messages, written over the old table."""
    from ..operators.vectors import write_vector_docs

    active = messages.join(domains.where("is_active").select("domain_id"), "domain_id", "left_semi")
    write_vector_docs(ingest_vectors(active), path)
    return messages.sparkSession.read.parquet(path)


def ingest_vectors(messages: DataFrame) -> DataFrame:
    threads = build_threads(with_noise(messages).where("not is_noise"))
    return vector_docs(threads, threads.select("thread_id", hash_embed(F.substring("text", 1, 8192)).alias("embedding")))


@query("s9_reembed", _clean_threads("domain_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)") + _VECTOR_DOCS)
def s9(spark, sf_dir):
    return reembed(view(spark, sf_dir, "messages"), view(spark, sf_dir, "domains"), new_path(spark, "reembed")).select("thread_id", "domain_id", "content", "msg_ts")


def conversation_markdown(chat: DataFrame) -> DataFrame:
    """(conv_id, markdown): turns in order."""
    line = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.coalesce("content", F.lit("")))
    return chat.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("markdown"))


@query("s10_conversation_markdown", cte("chat") + " SELECT conv_id, string_agg('**' || role || '**: ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM chat GROUP BY conv_id")
def s10(spark, sf_dir):
    return conversation_markdown(view(spark, sf_dir, "chat"))


def packed_paragraphs(text: Column, most: int = 4096) -> Column:
    """Greedily packed paragraphs: array of pieces of at most `most` characters (a longer paragraph is cut)."""
    cut = F.flatten(F.transform(F.split(text, "\n\n"), lambda p: F.when(F.char_length(p) <= most, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    step = lambda s, p: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), p.alias("now"))).when(F.char_length(s["now"]) + 2 + F.char_length(p) <= most, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit("\n\n"), p).alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), p.alias("now")))
    return F.aggregate(cut, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda x: x.isNotNull() & (F.trim(x) != "")))


def cut_at_newlines(text: Column, most: int = 4096) -> Column:
    """Array of pieces of at most `most` characters, each cut at its last line feed, or in full length where it has none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            pieces, at, t = [], 0, t or ""
            while len(t) - at > most:
                end = t.rfind("\n", at, at + most)
                end = at + most if end <= at else end
                pieces.append(t[at:end])
                at = end + (t[end : end + 1] == "\n")
            pieces.append(t[at:])
            out.append([p for p in pieces if p.strip()])
        return pd.Series(out)

    return cut(text)


@query("s11_chunk_text")
def s11(spark, sf_dir):
    docs = view(spark, sf_dir, "posts").select("id", F.regexp_replace("content", "\n", "\n\n").alias("text"))
    return docs.select("id", F.posexplode(packed_paragraphs(F.col("text"))).alias("piece_no", "piece"))


@query("s11_chunk_lines")
def s11_lines(spark, sf_dir):
    return view(spark, sf_dir, "posts").select("id", F.posexplode(cut_at_newlines(F.col("content"))).alias("piece_no", "piece"))
