"""What is kept up to date beside the messages: summaries of tags and of communities, schemas of domains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import communities, community_brief
from ..operators.models import Model, apply_model
from ..operators.scope import schema_history
from ..operators.tables import mark_stale, posts_per_hashtag, top_per_key
from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import written
from .mapreduce import summarise

TAG = ["domain_id", "tag"]


def _said(df: DataFrame, keys: list[str], model: Model, batch: int = 1) -> DataFrame:
    """keys and what a model says (a string) of each text; texts for which it fails are missing."""
    got = apply_model(df.select(F.struct(*keys).alias("at"), "text"), model, "at", batch=batch).where("error is null")
    return got.select("at.*", F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("said"))


# ---- tags

def tag_texts(messages: DataFrame, due: DataFrame, most: int = 50, chars: int = 500) -> DataFrame:
    """(domain_id, tag, text): of each due tag the beginnings of its newest posts, with their dates."""
    tags = messages.select("domain_id", "msg_id", "msg_date", F.explode(F.array_distinct(T.hashtags(F.col("content")))).alias("tag"))
    # posts are chosen by their ids; the texts come after the cut
    newest = top_per_key(tags.join(due.select(*TAG), TAG, "left_semi"), TAG, most, F.desc("msg_date"), F.desc("msg_id")).select("domain_id", "msg_id", "tag", "rank")
    said = F.concat(F.lit("["), F.date_format("msg_date", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    bodies = newest.join(messages.select("domain_id", "msg_id", said.alias("said")), ["domain_id", "msg_id"])
    return bodies.groupBy(*TAG).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda x: x["said"]), "\n\n---\n\n").alias("text"))


def save_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (domain_id, tag): a new summary takes a stored one's place, is not stale, and its counter starts again.

    stored: domain_id, tag, summary, post_count, is_stale, new_posts, generated_at; new: the same without is_stale and new_posts.
    """
    fresh = new.select(*TAG, "summary", "post_count", F.lit(False).alias("is_stale"), F.lit(0).cast("long").alias("new_posts"), "generated_at")
    return stored.select(*fresh.columns).join(new.select(*TAG), TAG, "left_anti").unionByName(fresh)


def update_tag_summaries(messages: DataFrame, stored: DataFrame, as_of: Column, least: int = 100, most: int = 50, model: Model | None = None) -> DataFrame:
    """The stored summaries after those of tags with `least` posts or more that have none, or a stale one, are made anew.

    A tag for which the model fails stays as it is. Without a model the summary is the number of posts and the newest one's beginning.
    """
    counts = posts_per_hashtag(messages).where(F.col("n_posts") >= least)
    due = counts.join(stored.select(*TAG, "is_stale"), TAG, "left").where("is_stale is null or is_stale").select(*TAG, "n_posts")
    due = written(due, "tags-due")
    texts = tag_texts(messages, due, most)
    plain = F.concat(F.lit("#"), "tag", F.lit(": "), "n_posts", F.lit(" posts. "), summarise(F.substring_index("text", "\n\n---\n\n", 1)))
    said = _said(texts, TAG, model) if model else texts.join(due, TAG).select(*TAG, plain.alias("said"))
    new = due.join(said, TAG).select(*TAG, F.col("said").alias("summary"), F.col("n_posts").alias("post_count"), as_of.alias("generated_at"))
    return save_summaries(stored, new)


def mark_changed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored after new messages: summaries of their tags are stale, and their counters grow by the domain's new messages."""
    n = fresh.groupBy("domain_id").agg(F.count("*").alias("n"))
    changed = posts_per_hashtag(fresh).join(n, "domain_id").select(*TAG, "n")
    marked = mark_stale(stored.select(*TAG, "is_stale", "new_posts"), changed, F.col("n")).toDF(*TAG, "is_stale", "new_posts")
    return stored.drop("is_stale", "new_posts").join(marked, TAG).select(*stored.columns)


def lengths() -> Callable[[list[str]], list]:
    """A model for the registered queries: how long a text is; it fails at texts that name supplier 3."""

    def say(texts: list[str]) -> list[str]:
        if any("Supplier#000000003" in t for t in texts):
            raise ValueError("supplier 3")
        return [f"{len(t)} characters" for t in texts]

    return say


_TAGS = r"regexp_extract_all(content, '#([\p{L}\p{N}_]+)', 1)"


@query("m2_update_summaries", cte("messages") + f""", t AS (SELECT domain_id, msg_id, msg_date, content, unnest({_TAGS}) AS tag FROM messages),
n AS (SELECT domain_id, tag, count(*) AS n FROM t GROUP BY 1, 2), old AS (SELECT domain_id, tag, count(*) AS n FROM t WHERE msg_id < 3000 GROUP BY 1, 2),
ch AS (SELECT domain_id, tag, d.n FROM (SELECT DISTINCT domain_id, tag FROM t WHERE msg_id >= 3000) JOIN (SELECT domain_id, count(*) AS n FROM messages WHERE msg_id >= 3000 GROUP BY 1) d USING (domain_id)),
due AS (SELECT n.domain_id, n.tag, n.n FROM n LEFT JOIN old USING (domain_id, tag) LEFT JOIN ch USING (domain_id, tag) WHERE n.n >= 20 AND (old.n IS NULL OR ch.n IS NOT NULL)),
s AS (SELECT *, row_number() OVER (PARTITION BY domain_id, tag ORDER BY msg_date DESC, msg_id DESC) AS rank FROM (SELECT DISTINCT domain_id, msg_id, msg_date, content, tag FROM t) JOIN due USING (domain_id, tag)),
x AS (SELECT domain_id, tag, sum(22 + least(length(content), 500)) + 7 * (count(*) - 1) AS chars FROM s WHERE rank <= 50 GROUP BY 1, 2)
SELECT domain_id, tag, concat(chars, ' characters') AS summary, n AS post_count, false AS is_stale, 0 AS new_posts FROM due JOIN x USING (domain_id, tag)
UNION ALL SELECT domain_id, tag, 'old', old.n, ch.n IS NOT NULL, coalesce(ch.n, 0) FROM old LEFT JOIN ch USING (domain_id, tag) WHERE (domain_id, tag) NOT IN (SELECT (domain_id, tag) FROM due)""")
def m2_update(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    stored = posts_per_hashtag(m.where("msg_id < 3000")).select(*TAG, F.lit("old").alias("summary"), F.col("n_posts").alias("post_count"), F.lit(False).alias("is_stale"), F.lit(0).cast("long").alias("new_posts"), at.alias("generated_at"))
    marked = mark_changed(stored, m.where("msg_id >= 3000"))
    return update_tag_summaries(m, marked, F.lit("2024-02-01").cast("timestamp_ntz"), 20, model=lengths).drop("generated_at")


# ---- communities

def community_summaries(memberships: DataFrame, relations: DataFrame, model: Model | None = None) -> DataFrame:
    """(domain_id, community_id, summary, size, level): what a model says of a community's first members and relations, or where it fails,
    and without one, how many entities it has."""
    key = ["domain_id", "community_id"]
    sizes = memberships.groupBy(*key).agg(F.count("*").alias("size"))
    text = F.concat(F.lit("Members: "), "members", F.lit("\nRelations:\n"), F.coalesce("relations", F.lit("none")))
    brief = community_brief(memberships, relations).select(*key, text.alias("text"))
    said = _said(brief, key, model) if model else brief.select(*key, F.lit(None).cast("string").alias("said")).limit(0)
    plain = F.concat(F.lit("Group of "), "size", F.lit(" entities"))
    return sizes.join(said, key, "left").select(*key, F.coalesce("said", plain).alias("summary"), "size", F.lit(0).alias("level"))


def update_communities(relations: DataFrame, least: int = 3, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Communities of the whole graph in place of earlier ones: (domain_id, community_id, name), and their summaries."""
    found = written(communities(relations, least), "communities-new")
    return found, written(community_summaries(found, relations, model), "communities-said")


@query("g7_community_summaries", cte("relations") + ", mb AS (SELECT domain_id, concat('c', type) AS community_id, source AS name FROM relations UNION SELECT domain_id, concat('c', type), target FROM relations), rk AS (SELECT *, row_number() OVER (PARTITION BY domain_id, community_id ORDER BY name) AS rank FROM mb), m AS (SELECT domain_id, community_id, count(*) AS size, string_agg(name, ', ' ORDER BY name) FILTER (WHERE rank <= 30) AS members FROM rk GROUP BY 1, 2), i AS (SELECT rk.domain_id, rk.community_id, r.source, r.type, r.target, row_number() OVER (PARTITION BY rk.domain_id, rk.community_id ORDER BY source, target, type) AS rn FROM relations r JOIN rk ON rk.domain_id = r.domain_id AND rk.name = r.source AND rank <= 15 JOIN mb ON mb.domain_id = rk.domain_id AND mb.community_id = rk.community_id AND mb.name = r.target), t AS (SELECT domain_id, community_id, string_agg(concat_ws(' ', source, type, target), chr(10) ORDER BY source) AS relations FROM i WHERE rn <= 30 GROUP BY 1, 2) SELECT domain_id, community_id, size, CASE WHEN contains(members || coalesce(relations, ''), 'Supplier#000000003') THEN concat('Group of ', size, ' entities') ELSE concat(length(members) + length(coalesce(relations, 'none')) + 21, ' characters') END AS summary FROM m LEFT JOIN t USING (domain_id, community_id)")
def g7_summaries(spark, sf_dir):
    r = view(spark, sf_dir, "relations")
    kind = F.concat(F.lit("c"), "type").alias("community_id")
    mb = r.select("domain_id", kind, F.col("source").alias("name")).union(r.select("domain_id", kind, "target")).distinct()
    return community_summaries(mb, r, lengths).select("domain_id", "community_id", "size", "summary")


# ---- schemas

SCHEMA = "struct<domain_type:string,entity_types:array<struct<name:string,description:string>>,relation_types:array<struct<name:string,description:string>>>"


def capitalised() -> Callable[[list[str]], list]:
    """In a schema model's place: types by the marks that a sample has."""
    marks = (("Tag", "#"), ("Person", "@"), ("Link", "://"))

    def say(texts: list[str]) -> list[dict]:
        return [{"domain_type": "other", "entity_types": [{"name": n, "description": f"marked by {m}"} for n, m in marks if m in t], "relation_types": []} for t in texts]

    return say


def discover_schemas(messages: DataFrame, history: DataFrame | None = None, most: int = 75, chars: int = 500, seed: int = 7, model: Model | None = None) -> DataFrame:
    """The history of each domain's schemas with a new version from a sample of its messages, of which only the newest is active.

    history, result: domain_id, arrived, sample_size, schema (SCHEMA), version, is_active. The sample is the same at each run: `most` messages of 10
    characters or more in the order of a hash of their ids. Where the model fails, or gives no such object, the schema is empty, of type "other".
    """
    texts = messages.where(F.char_length(F.trim("content")) >= 10)
    chosen = top_per_key(texts.select("domain_id", "msg_id", F.substring("content", 1, chars).alias("content")), ["domain_id"], most, F.xxhash64("msg_id", F.lit(seed)), F.col("msg_id"))
    line = F.concat("rank", F.lit(". "), "content")
    sample = chosen.groupBy("domain_id").agg(F.count("*").alias("sample_size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    got = apply_model(sample, model or capitalised, "domain_id", batch=1).where("error is null").select("domain_id", F.from_json("value", SCHEMA).alias("said"))
    none = F.from_json(F.lit('{"domain_type":"other","entity_types":[],"relation_types":[]}'), SCHEMA)
    schema = F.when(F.col("said")["entity_types"].isNotNull(), F.col("said")).otherwise(none)
    new = sample.join(got, "domain_id", "left").select("domain_id", "sample_size", schema.alias("schema"))
    if history is None:
        log = new.withColumn("arrived", F.lit(1).cast("long"))
    else:
        last = history.groupBy("domain_id").agg(F.max("arrived").alias("last"))
        new = new.join(last, "domain_id", "left").withColumn("arrived", F.coalesce("last", F.lit(0)) + 1).drop("last")
        log = history.select("domain_id", "sample_size", "schema", "arrived").unionByName(new)
    return schema_history(log).select("domain_id", "arrived", "sample_size", "schema", "version", "is_active")


@query("n16_schema_discovery")
def n16_discovery(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    first = written(discover_schemas(m.where("msg_id < 3000")), "schemas")
    return discover_schemas(m, first)
