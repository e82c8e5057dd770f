"""The trie of conversations' prefixes, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns; its members are the conversations that start with it, and its name is its smallest
member and its depth: members only get fewer downwards, so the smallest member of the nodes on a path never falls, and a path is a few
runs of depths with one smallest member each. (r runs take r conversations of growing length, r * r / 2 turns in all: no path
has more runs than the square root of twice the table.)

Sums over subtrees go by rounds over the components of the forest of parent edges, at first the whole trie:

1. A node's weight in its component is the members of all nodes of the component below it, its own included. Nodes of at least half the
   component's weight stand on one path from its top; the lowest of them is the centroid.
2. Without its centroid, a component falls into one above and one below each child, each of half the weight at most. So the rounds are the
   logarithm of all turns at most, however deep the trie is.
3. Nodes at or below the centroid add their values to the component's total; the nodes from the centroid to the top get
   this total. At the end a node's sum is that of the totals it got.

Sequences are told apart by 128 bits (two exclusive sums of XXH64 of place, role and text); texts are read once and not shuffled.

Defined cases: null roles and texts are empty; null turns come first; turns of equal number are ordered by a hash of role and text; repeated
rows are turns of their own; rows without conv_id belong to no conversation; very long texts count by their code points; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import running
from .shared import written

MOST_SHARED, GROUP = 6, 100
NO_ENDS = sha256(b"").hexdigest()


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), x1, x2 (hashes of role and text), points (the text's code points)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(i), role, text).alias(f"x{i}") for i in (1, 2)]
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *hashes, F.char_length(text).cast("long").alias("points"))
    return written(running.place(turns, ["conv_id"], ["turn", "x1", "x2"], "pos").select("conv_id", "pos", "x1", "x2", "points"), "trie-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of the first one of its hundred in place of as many of its own:
    (conv_id, depth, x1, x2, points, length), and (conv_id, length)."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = written(convs, "trie-convs")
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "x1", "x2", "points", "length")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "x1", "x2", "points", "length")
    return heads.unionByName(own), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, size: int | None = None) -> DataFrame:
    """turns with k1, k2: what tells the sequence up to each turn from others of its length."""
    rows = turns.select("conv_id", "depth", "points", "length", *[F.xxhash64(F.lit(i), "depth", "x1", "x2").alias(f"g{i}") for i in (1, 2)])
    upto = lambda *keys: W.partitionBy(*keys).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    ranges = running.in_ranges(rows, ["conv_id"], F.col("depth"), size)
    if ranges is None:
        both = [F.bit_xor(f"g{i}").over(upto("conv_id")).alias(f"k{i}") for i in (1, 2)]
        return rows.select("conv_id", "depth", "points", "length", *both)
    for i in (1, 2):
        before = running.before_ranges(ranges, ["conv_id"], F.bit_xor(f"g{i}"), "_before", F.bit_xor)
        met = running.with_before(ranges, before, ["conv_id"])
        ranges = met.withColumn(f"k{i}", F.bit_xor(f"g{i}").over(upto("conv_id", "_part")).bitwiseXOR(F.coalesce("_before", F.lit(0)))).drop("_before")
    return ranges.select("conv_id", "depth", "points", "length", "k1", "k2")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id) -> depth, k1, k2 and SHA-256 of the ids, ascending, joined by commas: one pass, whatever a node's number of ids."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        key, state, out = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            d, a, b, ids = (c.to_numpy() for c in batch.columns)
            heads = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(d)]):
                now, said = (int(d[at]), int(a[at]), int(b[at])), ",".join(map(str, ids[at:end].tolist())).encode()
                if now == key:
                    state.update(b"," + said)
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = now, sha256(said)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
                out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], schema=schema)

    order = ["depth", "k1", "k2", "conv_id"]
    return ends.select(*order).repartition("depth", "k1", "k2").sortWithinPartitions(*order).mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def member_at(runs: str, depth: Column) -> Column:
    """The smallest member of the node at a depth of a path: runs are (first depth, smallest member), downwards."""
    return F.element_at(F.filter(runs, lambda r: r["first"] <= depth), -1)["member"]


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, points, weight, runs (its path's), ends_sha256."""
    turns, convs = rebuilt(placed_turns(conversations))
    steps = written(prefixes(turns), "trie-steps")
    members = lambda: (F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    below = steps.groupBy("depth", "k1", "k2").agg(*members(), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.max("points").alias("points"))
    zero = F.lit(0).cast("long")
    root = convs.agg(*members(), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", "weight", zero.alias("points"))
    nodes = written(below.unionByName(root), "trie-keys")
    top = nodes.where("depth = 0").select(F.struct(zero.alias("first"), F.col("conv_id").alias("member")).alias("_top"))
    owned = steps.select("conv_id", "depth", "k1", "k2").join(nodes.select("depth", "k1", "k2", F.col("conv_id").alias("member")), ["depth", "k1", "k2"])
    runs = owned.groupBy("conv_id", "member").agg(F.min("depth").alias("first")).groupBy("conv_id").agg(F.collect_list(F.struct("first", "member")).alias("runs"))
    runs = runs.where(F.exists("runs", lambda r: r["member"] == F.col("conv_id")))
    named = nodes.join(runs, "conv_id", "left").join(F.broadcast(top))  # one row
    named = named.withColumn("runs", F.array_sort(F.concat(F.array("_top"), F.coalesce("runs", F.array().cast("array<struct<first:bigint,member:bigint>>"))))).drop("_top")
    named = written(named.withColumn("parent_conv_id", F.when(F.col("depth") > 0, member_at("runs", F.col("depth") - 1))), "trie-named")
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    last = steps.where("depth = length").select("depth", "k1", "k2", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    met = named.join(children, ["conv_id", "depth"], "left").join(hashed_ends(last), ["depth", "k1", "k2"], "left")
    return written(met.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "points", "weight", "runs", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-nodes")


TOP = ["top_conv", "top_depth"]


def split(state: DataFrame, values: list[str]) -> DataFrame:
    """A round: each component's nodes with its centroid (z_conv, z_depth), below and above (at the centroid both), and the component
    that they belong to from now on."""
    whole = state.groupBy(*TOP).agg(F.max("weight").alias("whole"))
    heavy = state.join(whole, TOP).where("2 * weight >= whole")
    # the path from the top: downwards depths and smallest members rise and weights fall
    centroids = heavy.groupBy(*TOP).agg(F.max("whole").alias("whole"), F.max("conv_id").alias("z_conv"), F.max("depth").alias("z_depth"), F.min("weight").alias("z_weight"))
    met = state.join(centroids, TOP)
    below = (F.col("depth") >= F.col("z_depth")) & (member_at("runs", F.col("z_depth")) == F.col("z_conv"))
    met = met.withColumn("below", below).withColumn("above", F.expr("2 * weight >= whole")).withColumn("centroid", F.expr("conv_id = z_conv and depth = z_depth"))
    new = {
        "top_conv": F.when(F.col("below"), member_at("runs", F.col("z_depth") + 1)).otherwise(F.col("top_conv")),
        "top_depth": F.when(F.col("below"), F.col("z_depth") + 1).otherwise(F.col("top_depth")),
        "weight": F.col("weight") - F.when(F.col("above") & ~F.col("below"), F.col("z_weight")).otherwise(0),
    }
    return met.select("conv_id", "depth", *[x.alias(name) for name, x in new.items()], *values, "runs", "z_conv", "z_depth", "below", "above", "centroid")


def subtree_sums(nodes: DataFrame, values: list[str], name: str = "trie") -> DataFrame:
    """conv_id, depth and, of each value (a long), its sum over the node's subtree. nodes: conv_id, depth, weight, runs and the values."""
    first = nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"))
    state, rounds = nodes.select("conv_id", "depth", "weight", *values, "runs").join(F.broadcast(first)), []  # one row
    while not rounds or state.take(1):
        rounds.append(written(split(state, values), f"{name}-round"))
        state = rounds[-1].where("not centroid").select("conv_id", "depth", *TOP, "weight", *values, "runs")
    every = reduce(DataFrame.unionByName, rounds)
    totals = every.where("below").groupBy("z_conv", "z_depth").agg(*[F.sum(v).alias(v) for v in values])
    got = every.where("above").select("conv_id", "depth", "z_conv", "z_depth").join(totals, ["z_conv", "z_depth"])
    return got.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    nodes = trie(conversations)
    values = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("points"))
    sums = subtree_sums(values, ["n_leaves", "saved_tokens"])
    return nodes.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
info AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS length
         FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
steps AS (SELECT i.conv_id, t.pos AS depth, role, text FROM info i JOIN t ON t.conv_id = i.base AND t.pos <= i.taken
          UNION ALL SELECT i.conv_id, i.taken + t.pos - i.h, role, text FROM info i JOIN t ON t.conv_id = i.conv_id WHERE t.pos > i.h),
paths AS (SELECT conv_id, depth, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
          UNION ALL SELECT conv_id, 0, '', [] FROM info),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(text)) AS points FROM paths GROUP BY path, depth),
up AS (SELECT p.conv_id AS member, p.depth, n.conv_id AS owner FROM paths p JOIN nodes n ON n.path = p.path AND n.depth = p.depth),
named AS (SELECT n.conv_id, n.depth, u.owner AS parent_conv_id, n.n_convs, (n.n_convs - 1) * n.points AS saved
          FROM nodes n LEFT JOIN up u ON u.member = n.conv_id AND u.depth = n.depth - 1),
full_nodes AS (SELECT n.*, (SELECT count(*) FROM named k WHERE k.parent_conv_id = n.conv_id AND k.depth = n.depth + 1) AS n_children FROM named n),
sums AS (SELECT u.owner AS conv_id, u.depth, CAST(count(*) FILTER (WHERE n.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
         FROM full_nodes n JOIN up u ON u.member = n.conv_id AND u.depth <= n.depth GROUP BY u.owner, u.depth),
ends AS (SELECT u.owner AS conv_id, u.depth, sha256(string_agg(CAST(i.conv_id AS VARCHAR), ',' ORDER BY i.conv_id)) AS ends_sha256
         FROM info i JOIN up u ON u.member = i.conv_id AND u.depth = i.length GROUP BY u.owner, u.depth)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.conv_id = n.conv_id AND s.depth = n.depth LEFT JOIN ends e ON e.conv_id = n.conv_id AND e.depth = n.depth
"""
