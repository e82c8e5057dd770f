"""Threads over increments, and the stream of stored messages."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatlake.operators import threads
from chatlake.plans import mapreduce
from chatlake.sources import stream
from chatlake.sources.tables import new_path, written

T0 = datetime(2024, 1, 1)
MESSAGE = "domain_id long, msg_id long, reply_to_msg_id long, sender_name string, content string, content_type string, msg_date timestamp_ntz"


def random_messages(spark, seed, n=120):
    """Chains, late roots, replies to missing and own ids, cycles, and loose messages close in time."""
    r = random.Random(seed)
    rows, at = [], 0
    for i in range(1, n + 1):
        at += r.choice([20, 100, 300, 301, 500, 2000])
        reply = r.choice([None, None, None, max(1, i - r.randint(1, 5)), min(n, i + r.randint(1, 9)), i, 10_000 + i])
        rows.append((r.randrange(2), i, reply, "u", f"message number {i}", "text", T0 + timedelta(seconds=at)))
    return spark.createDataFrame(rows, MESSAGE)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_threads_of_the_whole(spark, seed):
    m = random_messages(spark, seed)
    want = {(x.domain_id, x.msg_id): x.thread_root for x in threads.assign_threads(m).collect()}
    parts = [written(m.where(F.pmod(F.xxhash64("msg_id", F.lit(seed)), F.lit(4)) == i), "part") for i in range(4)]
    labelled = written(threads.assign_threads(parts[0]), "labelled")
    for part in parts[1:]:
        changed, touched = threads.grown_threads(labelled, part)
        known = labelled.join(touched, ["domain_id", "thread_root"], "left_anti")
        # what is touched comes back, and nothing else does
        assert known.count() + changed.count() == labelled.count() + part.count()
        labelled = written(known.unionByName(changed), "labelled")
    assert {(x.domain_id, x.msg_id): x.thread_root for x in labelled.collect()} == want
    assert len(set(want.values())) > 10


def test_only_touched_threads_are_made_anew(spark):
    rows = [(1, i, i - 1 if i % 3 else None, "u", f"message {i}", "text", T0 + timedelta(seconds=10_000 * (i // 3) + i)) for i in range(90)]
    known = written(threads.assign_threads(spark.createDataFrame(rows, MESSAGE)), "labelled")
    fresh = spark.createDataFrame([(1, 500, 31, "u", "an answer", "text", T0 + timedelta(days=90)), (2, 31, None, "u", "elsewhere", "text", T0)], MESSAGE)
    changed, touched = threads.grown_threads(known, fresh)
    assert [(x.domain_id, x.thread_root) for x in touched.collect()] == [(1, 30)]
    assert {(x.msg_id, x.thread_root) for x in changed.where("domain_id = 1").collect()} == {(30, 30), (31, 30), (32, 30), (500, 30)}


def test_ingestion_across_runs(spark):
    m = random_messages(spark, 5, 60)
    whole = mapreduce.ingest_initial(m)
    step = mapreduce.ingest_initial(m.where("msg_id % 3 = 0"))
    for part in ("msg_id % 3 = 2", "msg_id > 0"):
        step = mapreduce.ingest_incremental(step, m.where(part), across=True)
    for name, keys in (("threads", ["thread_id", "text", "n_messages"]), ("vectors", ["thread_id", "content", "embedding"]), ("messages", ["domain_id", "msg_id"])):
        a, b = (sorted(map(str, x[name].select(*keys).collect())) for x in (whole, step))
        assert a == b, name


def test_log_is_read_once(spark):
    path, out, check = new_path(spark, "log"), new_path(spark, "out"), new_path(spark, "check")
    schema = "domain_id long, msg_id long, content string"

    def run():
        stream.stream_log(spark, path, schema, {1: 2}).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(schema).parquet(out).select("domain_id", "msg_id", "content").collect()), key=str)

    rows = [(d, i, f"{d}/{i}") for d in (1, 2, None) for i in range(6)]
    frame = lambda r: spark.createDataFrame(r, schema)
    stream.write_log(frame([x for x in rows if x[1] < 4]), path)
    first = run()
    assert first == sorted([x for x in rows if x[1] < 4 and not (x[0] == 1 and x[1] <= 2)], key=str)
    assert run() == first  # a restart reads nothing twice
    stream.write_log(frame([x for x in rows if x[1] >= 4]), path)
    assert run() == sorted([x for x in rows if not (x[0] == 1 and x[1] <= 2)], key=str)


def test_partitions_by_domain(spark):
    path = new_path(spark, "log")
    stream.write_log(spark.createDataFrame([(d, i) for d in (1, 2, 3) for i in range(5)], "domain_id long, msg_id long"), path)
    from pyspark.sql.types import LongType, StructField, StructType

    reader = stream.MessageReader(StructType([StructField("domain_id", LongType()), StructField("msg_id", LongType())]), {"path": path, "after": '{"1": 4, "2": 1, "9": 7}'})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"1": 4, "2": 4, "3": 4, "9": 7}
    parts = reader.partitions(start, end)
    assert [(p.domain, p.after, p.upto) for p in parts] == [("2", 1, 4), ("3", -1, 4)]
    assert [b.to_pydict() for b in reader.read(parts[0])] == [{"domain_id": [2, 2, 2], "msg_id": [2, 3, 4]}]
    assert list(reader.read(reader.partitions(end, end)[0])) == []
