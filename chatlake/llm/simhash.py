"""SimHash near-duplicates: 64-bit fingerprints, linked at a Hamming distance of at most 3 by BK-trees.

1. A fingerprint has the bits that are set in over half of the XXH64 hashes of a text's 3-word shingles. Equal fingerprints are one
   node from here on.
2. Nodes are dealt to shards: two that differ in at most 3 bits agree in one of 4 blocks of 16 bits, so each goes to a shard for each of
   its blocks. A shard of more than MOST nodes is dealt again by the 48 bits that it leaves open, then by 36: no link is lost, and what
   many nodes share in one block doesn't make them meet. What is larger even then has several trees.
3. A shard's nodes form BK-trees of about MOST nodes at most: a node's children are keyed by their Hamming distance to it, one child a distance.
   Trees travel to the shard's blocks of queries, by broadcast while the trees of all shards together are within BROADCAST_BYTES,
   else by a shuffle. A query at distance d from a node follows only the edges from d - 3 to d + 3.
4. Of the links that a task finds it returns a forest that joins the same nodes, so that a group of like texts gives rows in
   proportion to its size. Components follow from these.

Defined cases: a null text, or one without words, has fingerprint zero and links like any other; fewer than 3 words are one shingle;
repeated rows and ties are rows of one node; very long texts are read in runs of words; a component's id is the smallest that is not null,
and null where it has none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import batches, slices, written
from .textops import U

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of a shard before it is dealt again, and of a tree; bytes of trees that may be broadcast.
MOST, BROADCAST_BYTES = 2048, 4_000_000
#: Bits that a shard leaves open, level by level; each level fixes a quarter.
OPEN_BITS = (64, 48, 36)
RUN_BYTES, RUN_SHINGLES, QUERIES = 1 << 20, 1 << 16, 1024
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about RUN_BYTES."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + RUN_BYTES)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each run of k words, repeats included, in arrays of at most RUN_SHINGLES; of fewer words, of them all."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    short = True
    for run in word_runs(text.lower()):
        held += run
        grams = map(b" ".join, zip(*(islice(held, i, None) for i in range(k))))
        while len(h := np.fromiter((xxh64_intdigest(g, SEED) for g in islice(grams, RUN_SHINGLES)), U)):
            short = False
            yield h
        held = held[-(k - 1) :] if len(held) >= k - 1 else held
    if short and held:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], U)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (a long) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(found):
        for batch in found:
            for part in slices(batch):
                texts = part.column(1).fill_null("").cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, f"id {kind}, fp long")


# ---- shards

def dealt(rows: DataFrame, open_bits: int) -> DataFrame:
    """(key, rest, fp) -> a row for each quarter of rest: a key of the old one with that quarter, and the bits that stay open."""
    width, parts = open_bits // 4, []
    for j in range(4):
        at = j * width
        block = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << at) - 1)) if j else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("rest", at + width), at) if j < 3 else F.lit(0).cast("long")
        parts.append(F.struct(F.xxhash64("key", F.lit(j), block).alias("key"), low.bitwiseOR(high).alias("rest")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("x")).select("x.key", "x.rest", "fp")


def shards(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """fp -> (key, part, fp): any two within RADIUS share a key. Parts of a key have about `most` members at most; keys of one member are gone."""
    rows, out = nodes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), None
    for level, open_bits in enumerate(OPEN_BITS):
        cut = dealt(rows, open_bits)
        sizes = written(cut.groupBy("key").count().where("count > 1"), "simhash-shards")
        last = level == len(OPEN_BITS) - 1
        met = cut.join(sizes if last else sizes.where(F.col("count") <= most), "key")
        parts = F.ceil(F.col("count") / most)
        ready = met.select("key", F.pmod(F.xxhash64("fp", F.lit(level)), parts).cast("int").alias("part"), "fp")
        out = ready if out is None else out.unionByName(ready)
        hot = sizes.where(F.col("count") > most).select("key")
        if last or not hot.take(1):
            return out
        rows = written(cut.join(hot, "key", "left_semi"), "simhash-hot")
    return out


# ---- BK-trees, many at a time

def grown(fps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of trees (offsets: where each begins) in an order with children side by side: fps, parents (-1: top), distances to them.

    All trees grow together, level by level: of the nodes below a node, the first at each distance becomes its child, the others at
    this distance go below that.
    """
    tree = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    tops = offsets[:-1][np.diff(offsets) > 0]
    index, up, edge = [tops], [np.full(len(tops), -1)], [np.zeros(len(tops), np.int64)]
    below = np.setdiff1d(np.arange(len(fps)), tops, assume_unique=True)
    number = np.empty(len(offsets) - 1, np.int64)
    number[tree[tops]] = np.arange(len(tops))
    parent, made = number[tree[below]], len(tops)
    so_far = tops
    while len(below):
        d = np.bitwise_count(fps[below] ^ fps[so_far[parent]]).astype(np.int64)
        order = np.lexsort((below, d, parent))
        below, parent, d = below[order], parent[order], d[order]
        head = np.r_[True, (parent[1:] != parent[:-1]) | (d[1:] != d[:-1])]
        index.append(below[head])
        up.append(parent[head])
        edge.append(d[head])
        so_far = np.concatenate([so_far, below[head]])
        parent = (made + np.cumsum(head) - 1)[~head]
        made += int(head.sum())
        below = below[~head]
    up, edge = np.concatenate(up), np.concatenate(edge)
    order = np.argsort(tree[so_far], kind="stable")
    place = np.empty(made, np.int64)
    place[order] = np.arange(made)
    up = np.where(up < 0, -1, place[up])[order]
    return fps[so_far[order]], up, edge[order]


def within(fps: np.ndarray, up: np.ndarray, edge: np.ndarray, top: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of all nodes within radius, in the tree whose top each query is given."""
    child = np.flatnonzero(up >= 0)
    n = np.bincount(up[child], minlength=len(fps))
    first = np.zeros(len(fps), np.int64)
    parents, at = np.unique(up[child], return_index=True)
    first[parents] = child[at]
    for start in range(0, len(queries), QUERIES):
        q = np.arange(start, min(start + QUERIES, len(queries)))
        node = top[q]
        while len(q):
            d = np.bitwise_count(queries[q] ^ fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            many = n[node]
            rows = np.repeat(np.arange(len(q)), many)
            down = first[node[rows]] + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            follow = np.abs(edge[down] - d[rows]) <= radius
            q, node = q[rows[follow]], down[follow]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels, each a smaller or the same node, after a and b are linked."""
    while True:
        one, two = labels[a], labels[b]
        if (one == two).all():
            return labels
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while ((far := labels[labels]) != labels).any():
            labels = far


def trees_of(members: DataFrame) -> DataFrame:
    """(key, part, fp) -> a tree a row: key, part, fps, up, edge."""

    def grow(found):
        for batch in found:
            for part in slices(batch):
                lists = part.column(2)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                offsets = offsets - offsets[0]
                fps, up, edge = grown(lists.flatten().to_numpy().view(U), offsets)
                local = np.where(up < 0, -1, up - np.repeat(offsets[:-1], np.diff(offsets)))
                at = pa.array(offsets, pa.int32())
                made = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((fps.view(np.int64), pa.int64()), (local, pa.int32()), (edge, pa.int8()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["key", "part", "fps", "up", "edge"])

    grouped = members.groupBy("key", "part").agg(F.collect_list("fp").alias("fps"))
    return grouped.mapInArrow(grow, "key long, part int, fps array<long>, up array<int>, edge array<byte>")


def found_links(tiles: DataFrame) -> DataFrame:
    """Rows (fps, up, edge: a tree; queries) -> (a, b), links that join what all the links of a batch join."""

    def search(found):
        for batch in found:
            for part in slices(batch):
                trees, up, edge, asked = (part.column(c) for c in range(4))
                sizes, many = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (trees, asked))
                tops = np.cumsum(sizes) - sizes
                fps, queries = trees.flatten().to_numpy().view(U), asked.flatten().to_numpy().view(U)
                up = up.flatten().to_numpy()
                up = np.where(up < 0, -1, up + np.repeat(tops, sizes))
                both, code = np.unique(np.concatenate([fps, queries]), return_inverse=True)
                labels = np.arange(len(both))
                for q, node in within(fps, up, edge.flatten().to_numpy().astype(np.int64), np.repeat(tops, many), queries):
                    labels = joined(labels, code[len(fps) + q], code[node])
                linked = np.flatnonzero(labels != np.arange(len(both)))
                yield pa.RecordBatch.from_arrays([pa.array(both[x].view(np.int64)) for x in (linked, labels[linked])], names=["a", "b"])

    return tiles.select("fps", "up", "edge", "queries").mapInArrow(search, "a long, b long")


def near_links(nodes: DataFrame, most: int = MOST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """fp (distinct) -> (a, b): a forest in which two nodes are joined if links of at most RADIUS bits join them."""
    with batches(nodes.sparkSession):
        trees = written(trees_of(shards(nodes, most)), "simhash-trees")
        blocks = trees.select("key", F.col("part").alias("block"), F.col("fps").alias("queries"))
        size = trees.agg(F.sum(F.size("fps"))).first()[0] or 0
        small = 13 * size + 16 * trees.count() <= broadcast_bytes  # a node's fingerprint, parent and distance
        tiles = blocks.join(F.broadcast(trees) if small else trees, "key").where("part <= block")
        return written(found_links(tiles).distinct(), "simhash-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id of each row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    labels = components(near_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "label").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
