"""Mixing sources to target weights, with DataFrame operations only.

Each row gets an Efraimidis-Spirakis key, -ln(u) / quality, from a hash of its id. Within a source rows are taken in
ascending key order until their sizes, prefix-summed, fill the source's token budget; when the budget holds the source
once or more, complete epochs come first and the keys decide the rest. Prefix sums run over (source, key bucket): a source's
buckets are equal shares of its own keys' distribution, which follows from its qualities (`key_share`), and all sources together
have about the square root of all rows as the number of buckets, so that no window holds a whole source, whatever its quality.

Defined cases: a null source is a source of its own, last in order; a null text has size 0 and is taken as 0 words; rows
with equal id share a key and are ordered by size (rows without id have keys by their text); sources without words get
target 0; very long texts only count their words; an empty table gives no rows. Columns of other names pass through.
The sources' own table is ordered in one task: a row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: Qualities are told apart in so many steps when a source's keys are dealt to buckets.
QUALITY_STEPS = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: less for texts with many symbols a prose text seldom has."""
    symbols = F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>{}", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 10.0 * symbols / F.greatest(F.char_length(text), F.lit(1))), F.lit(0.1))


def uniform(row_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)


def key_share(key: Column, shares: Column) -> Column:
    """The share of a source's keys that is at most `key`: a key of quality q is exponential with rate q. Grows with key alone."""
    of_step = lambda share, i: share * (1.0 - F.exp(-key * (i + 1) / F.lit(float(QUALITY_STEPS))))
    return F.aggregate(F.transform(shares, of_step), F.lit(0.0), lambda a, x: a + x)


def source_targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(skey, source, source_size) -> the same with `target`.

    The excess above a source's cap goes to the others by weight until none is above: target = min(cap, level * weight).
    Sources fill up in order of cap / weight, so the level follows from one running sum. One row per source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    cyc = F.array(*[F.lit(w) for w in weights])
    caps = sources.withColumn("w", F.element_at(cyc, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    filling = W.orderBy(F.col("cap") / F.col("w"), "skey")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levels = caps.withColumn("level", level).withColumn("open", F.col("level") < F.col("cap") / F.col("w"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.select("skey", "source_size", F.when(F.col("open"), F.least(F.col("cap"), final * F.col("w"))).otherwise(F.col("cap")).alias("target"))


def bucketed_keys(docs: DataFrame, seed: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, skey (tells a null source), size, quality, key and bucket of each row; buckets of a source are in key order."""
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), quality_weight(text).alias("quality"), F.when(F.col(id_col).isNull(), F.md5(text.cast("binary"))).alias("loose"))
    keyed = sized.withColumn("key", -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.col("loose")), seed)) / F.col("quality")).drop("loose")
    keyed = keyed.withColumn("skey", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))))
    rows = written(keyed.withColumn("step", F.ceil(F.col("quality") * QUALITY_STEPS).cast("int")), "mix-sizes")
    steps = rows.groupBy("skey", "step").count().groupBy("skey").agg(F.sum("count").alias("of_source"), F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("steps"))
    n = max(1, math.ceil(math.sqrt(rows.count())))
    total = F.sum("of_source").over(W.partitionBy())
    each = F.transform(F.sequence(F.lit(1), F.lit(QUALITY_STEPS)), lambda i: F.coalesce(F.col("steps")[i], F.lit(0)) / F.col("of_source"))
    shapes = written(steps.select("skey", each.alias("shares"), F.greatest(F.lit(1), F.ceil(n * F.col("of_source") / total)).alias("buckets")), "mix-shapes")
    placing = key_share(F.col("key"), F.col("shares"))
    return rows.join(shapes, "skey").withColumn("bucket", F.least(F.floor(placing * F.col("buckets")), F.col("buckets") - 1).cast("int")).drop("shares", "buckets", "step")


def mix_sources(docs: DataFrame, weights: list[int], share: float, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source and key."""
    rows = bucketed_keys(docs, seed, id_col, source_col, text_col)
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.max("source").alias("source"))
    sources = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"), F.max("source").alias("source"))
    earlier = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    plan = written(offsets.join(source_targets(sources, weights, share, most), "skey"), "mix-plan")

    inside = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(plan, ["skey", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "source", "key")


def mixed_documents(docs: DataFrame, weights: list[int], share: float, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document once per time it is taken; the one that a budget cuts counts if half of it fits.

    Rows that share an id are told apart by their source, size and rank, so that each is copied as often as it was taken itself. Texts without words are not taken.
    """
    plan = mix_sources(docs, weights, share, most, seed).select("doc_id", "source", "size", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int").alias("times"))
    plan = written(plan, "mix-times")
    own, times, rank, copy = (free_name(c, docs.columns) for c in ("_id", "_times", "_rank", "_copy"))
    once = plan.groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("rows"), F.max("times").alias(times))
    # texts are shuffled once, whatever the size: ids that travel whole would not stay small
    alone = docs.join(once.where((F.col("rows") == 1) & (F.col(times) > 0)).select(own, times).hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(own))).select(*[docs[c] for c in docs.columns], times)
    several = once.where("rows > 1").select(own)
    if several.take(1):
        size = free_name("_size", docs.columns)
        among = lambda df, last: df.withColumn(rank, F.row_number().over(W.partitionBy("doc_id", "source", size).orderBy(last)))
        rows = among(docs.join(several, docs["doc_id"].eqNullSafe(F.col(own)), "left_semi").withColumn(size, word_count(F.col("text"))), F.col("text"))
        taken = among(plan.withColumnRenamed("size", size).join(several, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi"), F.desc("times"))
        taken = taken.select(F.struct("doc_id", "source", size, rank).alias("t"), F.col("times").alias(times))
        met = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("source").eqNullSafe(F.col("t.source")) & (F.col(size) == F.col(f"t.{size}")) & (F.col(rank) == F.col(f"t.{rank}")))
        alone = alone.unionByName(met.select(*docs.columns, times))
    return alone.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, [3, 1, 2], 1.5).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(greatest(0.1, 1.0::DOUBLE - 10.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>{}', ''))) / greatest(length(text), 1)), 0.1)::DOUBLE AS quality,
    (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / quality AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
c AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NOT NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source IS NOT NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min(level) FILTER (WHERE level < cap / w) AS final_low, arg_min(level, cap / w) FILTER (WHERE level < cap / w) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN level < cap / w THEN least(cap, final * w) ELSE cap END AS target FROM l, f),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, round(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
