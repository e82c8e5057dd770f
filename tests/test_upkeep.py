"""Tag and community summaries, schemas, topics and stale marks over increments and streams, observed runs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chatlake.operators.graph import communities
from chatlake.plans import mapreduce, retrieval, upkeep
from chatlake.sources.fixtures import view
from chatlake.sources.tables import new_path
from chatlake.streaming import ingest

from .conftest import SF

T0 = datetime(2024, 1, 1)
MESSAGE = "domain_id long, msg_id long, reply_to_msg_id long, sender_name string, content string, content_type string, msg_date timestamp_ntz, topic_id long"


def messages(spark, rows):
    """(domain, id, text, topic)"""
    return spark.createDataFrame([(d, i, None, "u", text, "text", T0 + timedelta(seconds=1000 * i), topic) for d, i, text, topic in rows], MESSAGE)


def fails_at_three():
    def say(texts):
        if any("three" in t for t in texts):
            raise ValueError("three")
        return [t.split("\n")[0] + f" +{t.count('---')}" for t in texts]

    return say


def test_tag_summaries(spark):
    m = messages(spark, [(1, i, f"post {i} {'three ' if i % 3 == 0 else ''}#{['a', 'b', 'c'][i % 3]} #a", None) for i in range(30)] + [(2, 1, "#a once", None), (1, 99, "no tags", None)])
    stored = spark.createDataFrame([(1, "b", "old b", 4, True, 7), (1, "a", "old a", 9, True, 3), (1, "gone", "old", 1, True, 2), (2, "a", "kept", 1, False, 0)], "domain_id long, tag string, summary string, post_count long, is_stale boolean, new_posts long").withColumn("generated_at", F.lit(T0))
    got = {(r.domain_id, r.tag): r for r in upkeep.update_tag_summaries(m, stored, F.lit(T0 + timedelta(1)), 10, most=5, model=fails_at_three).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "gone"), (2, "a")}
    # ten posts: made anew from the five newest; no summary before: made; the model fails: as it was; too few posts: as it was
    assert got[1, "b"].summary.startswith("[2024-01-01") and got[1, "b"].summary.endswith("post 28 #b #a +4") and not got[1, "b"].is_stale and got[1, "b"].new_posts == 0 and got[1, "b"].post_count == 10
    assert got[1, "c"].summary.endswith("post 29 #c #a +4") and got[1, "c"].generated_at == T0 + timedelta(1)
    assert (got[1, "a"].summary, got[1, "a"].is_stale, got[1, "a"].new_posts) == ("old a", True, 3)
    assert got[1, "gone"].is_stale and got[2, "a"].summary == "kept"
    plain = upkeep.update_tag_summaries(m, stored.limit(0), F.lit(T0), 10).collect()
    assert {r.tag for r in plain} == {"a", "b", "c"} and all(r.summary.startswith(f"#{r.tag}: {r.post_count} posts. [") for r in plain)
    assert upkeep.update_tag_summaries(m.limit(0), stored, F.lit(T0), 10).count() == 4


def test_stale_marks_and_topics_of_an_increment(spark):
    first = messages(spark, [(1, 1, "first post #a", None), (1, 2, "second post #b", 5), (2, 1, "other domain #a", None)])
    again = messages(spark, [(1, 1, "first post #a", 7), (1, 1, "first post #a", None), (1, 2, "second post #b", 9), (1, 3, "third post #a #b", None), (1, 3, "third post #a #b", 4), (1, 4, "fourth post", None)])
    known = mapreduce.ingest_initial(first) | {"summaries": spark.createDataFrame([(1, "a", "s", 1, False, 2), (1, "c", "s", 1, False, 0), (2, "a", "s", 1, False, 0)], "domain_id long, tag string, summary string, post_count long, is_stale boolean, new_posts long")}
    got = mapreduce.ingest_incremental(known, again)
    assert {(r.domain_id, r.msg_id): r.topic_id for r in got["messages"].collect()} == {(1, 1): 7, (1, 2): 5, (2, 1): None, (1, 3): 4, (1, 4): None}
    # two new messages of domain 1, one of them with the tag
    assert {(r.domain_id, r.tag): (r.is_stale, r.new_posts) for r in got["summaries"].collect()} == {(1, "a"): (True, 4), (1, "c"): (False, 0), (2, "a"): (False, 0)}


def test_topics_and_stale_marks_of_a_stream(spark):
    base, where = new_path(spark, "in"), new_path(spark, "out")
    parts = [[(1, 1, "first post #a", None), (1, 2, "second post #b", 5)], [(1, 1, "first post #a", 7), (1, 5, "fifth post #a", None)], [(1, 1, "first post #a", 8), (1, 2, "second post #b", 9), (1, 5, "fifth post #a", 3)]]
    for part in parts:
        messages(spark, part).coalesce(1).write.mode("append").parquet(base)
        stream = spark.readStream.schema(MESSAGE).parquet(base)
        ingest.stream_ingest(stream, where, f"{where}-check").awaitTermination()
    summaries = spark.createDataFrame([(1, "a", "s", False, 0), (1, "z", "s", False, 0)], "domain_id long, tag string, summary string, is_stale boolean, new_posts long")
    got = ingest.snapshot(spark, where, summaries)
    assert {r.msg_id: r.topic_id for r in got["messages"].collect()} == {1: 7, 2: 5, 5: 3}
    assert {r.tag: (r.is_stale, r.new_posts) for r in got["summaries"].collect()} == {"a": (True, 3), "z": (False, 0)}
    assert {(r.tag, r.n_posts) for r in got["tags"].collect()} == {("a", 2), ("b", 1)}


def test_community_summaries(spark):
    names = {c: [f"{c}{i}" for i in range(5)] for c in "xyz"}
    rows = [(1, a, b, "T") for group in names.values() for a in group for b in group if a < b] + [(1, "x0", "y0", "T")]
    r = spark.createDataFrame(rows, "domain_id long, source string, target string, type string")

    def build():
        def say(texts):
            if any("z1" in t for t in texts):
                raise ValueError("z")
            return [t.split("\n")[0] for t in texts]

        return say

    found, said = upkeep.update_communities(r, model=build)
    got = {x.community_id: (x.summary, x.size) for x in said.collect()}
    assert got == {"x0": ("Members: x0, x1, x2, x3, x4", 5), "y0": ("Members: y0, y1, y2, y3, y4", 5), "z0": ("Group of 5 entities", 5)}
    assert sorted(map(str, found.collect())) == sorted(map(str, communities(r).collect()))
    assert {x.summary for x in upkeep.community_summaries(found, r).collect()} == {"Group of 5 entities"}


def test_schema_versions(spark):
    m = view(spark, SF, "messages")

    def build():
        return lambda texts: [{"domain_type": "t", "entity_types": [{"name": "N", "description": t[:2]}], "relation_types": []} if "1. " in t else 7 for t in texts]

    one = upkeep.discover_schemas(m, model=build).cache()
    assert {(r.version, r.is_active, r.schema.domain_type) for r in one.collect()} == {(1, True, "t")}
    assert {r.domain_id for r in one.collect()} == {r.domain_id for r in m.select("domain_id").distinct().collect()}
    two = upkeep.discover_schemas(m.where("domain_id = 3"), one, most=4, model=lambda: (lambda texts: [texts[0] * 0, *texts][9:]))
    rows = [(r.domain_id, r.version, r.is_active, r.schema.domain_type) for r in two.collect()]
    assert sorted(x for x in rows if x[0] == 3) == [(3, 1, False, "t"), (3, 2, True, "other")]
    assert all(x[1] == 1 and x[2] for x in rows if x[0] != 3)
    assert {r.sample_size for r in two.where("version = 2").collect()} == {4}


def test_runs_count_as_they_write(spark):
    m = view(spark, SF, "messages")
    tables, stats = mapreduce.ingest_run(m)
    row = stats.first()
    for name, df in tables.items():
        assert row[f"n_{name}"] == df.count()
    assert row.n_all == m.count() == row.n_noise + row.n_clean and row.n_messages == row.n_clean
    assert 0 < row.duration_s < 600 and abs((row.finished_at - row.started_at).total_seconds() - row.duration_s) < 0.01


def test_scores_of_an_evaluation_run(spark):
    inputs = retrieval._inputs(spark, SF)
    golden = inputs[2].select("query_id", F.col("query_text").alias("golden"))
    got = retrieval.eval_run(*inputs, golden, mode="fast", domains=view(spark, SF, "domains")).collect()
    assert len(got) == inputs[2].count() and all(r.latency > 0 and 0 <= r.high_precision <= 1 for r in got)
    assert any(r.n_chunks == 10 for r in got) and max(r.context_tokens for r in got) <= 16_000
