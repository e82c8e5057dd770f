"""N-gram Jaccard join with signature trees.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.8; the result names each
document's connected component. Steps:

1. Each text becomes a set of 64-bit shingle hashes. Equal sets are one node from here on.
2. A node's tokens are put in one order for all (shingles that a bounded sample finds common come last; only speed depends
   on it). Linked sets share a token among the first n - ceil(0.8 n) + 1 of each, so nodes are grouped by those tokens. Groups
   with the same members count once. A group is cut into blocks of at most BLOCK nodes of neighbouring sizes.
3. A block's nodes form a signature tree: leaves hold a node's bitmap (a bit per shingle, wide
   in proportion to its size; of two widths the wider is folded), inner nodes the OR of
   the bitmaps below, the range of sizes, and the largest number of shingles that share a bit. Two trees are traversed
   together; a pair of tree nodes is dropped when the largest overlap its bitmaps and sizes allow is too small.
4. First, small groups give all surviving pairs, larger ones each node's pair with its most connected neighbour. Of these,
   again each node's pair with its most connected neighbour is verified on the whole sets, components are found, and so on
   with the pairs that still connect two of them. Then larger groups that still hold several components are traversed again, every
   pair of their blocks, now also dropping pairs of one component: no link between components is lost, and a group of
   thousands of near copies costs pairs in proportion to its size. Where blocks still have more such pairs than nodes, the nodes' whole sets
   are brought to one task, which verifies all pairs there and gives the links that connect components.

Shingles are compared by 64-bit hashes, at the end whole sets of them. Work on pairs is cut by the bytes of their bitmaps and
batches by their bytes, so that long texts cost time and not memory. Defined cases: a null text, or one without words, has an empty set and is a
component of its own; fewer than 5 words are one shingle; repeated rows are equal sets; null ids link like others and a
component's id is the smallest that is not null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .components import components
from .shared import free_name, gathered, trimmed, written
from .textops import LOWER, U, chained, chunks, mix, span_hashes, words

SHINGLE, BLOCK, SMALL = 5, 1024, 8
LEAST_BITS, MOST_BITS = 256, 65_536  # a half has 128 bits at least
SAMPLE_DOCS, SAMPLE_COMMON, SEGMENT = 4000, 4, 4096
#: Bytes of bitmaps that a traversal holds side by side, and shingles that the sample can send through the driver.
PAIR_BYTES, MOST_COMMON = 4_000_000, 200_000
#: Bytes of whole sets of a side of a part (one set can be larger).
PART_BYTES = 8_000_000
#: Numeric ids of at most so many nodes (32 bytes each) travel by broadcast; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 500_000


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = LOWER[data]
    starts, ends, doc = words(low, off)
    h = span_hashes(low, starts, ends)
    grams = chained(h, k)
    edge = np.searchsorted(doc, np.arange(len(off)))
    out = []
    for i in range(len(off) - 1):
        a, b = edge[i], edge[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(chained(h[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=U).view(np.int64)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """One bit per shingle among a power of two of bits, 4 to 8 times as many as shingles (within LEAST_BITS, MOST_BITS)."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(s)).bit_length()))
    hot = np.zeros(width, np.uint8)
    hot[(s & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(hot).tobytes()


def halved(bits: bytes) -> bytes:
    """The bitmap of half the width, which travels with blocks, since a node is in several of them."""
    return folded(np.frombuffer(bits, U)[None], 4 * len(bits)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps at a smaller width: halves are ORed."""
    while bits.shape[1] * 64 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def common_shingles(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that SAMPLE_COMMON or more of about SAMPLE_DOCS sampled texts hold, with their estimated number of texts."""
    every = max(1, -(-total // SAMPLE_DOCS))

    def shingles(batches):
        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingle_sets(data, off), np.zeros(0, U)]).view(np.int64))], names=["h"])

    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(trimmed(shingles), "h long").groupBy("h").count().where(F.col("count") >= SAMPLE_COMMON)
    found = gathered(counted.orderBy(F.desc("count"), "h").limit(MOST_COMMON))
    h, n = found["h"].view(U), found["count"] * every
    order = np.argsort(h)
    return h[order], n[order]


def nodes_of(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """uid, id, null_key, n, s1, s2, prefix, bits and half (of the bits) of each row."""

    def make(batches):
        uid = TaskContext.get().partitionId() << 34
        for batch in batches:
            for at, data, off in chunks(batch.column(1)):
                sets = shingle_sets(data, off)
                m = len(sets)
                prefixes, offsets = [], [0]
                for s in sets:
                    late = np.zeros(len(s), bool)
                    if len(common) and len(s):
                        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    p = np.concatenate([s[~late], s[late]])[: prefix_length(len(s))] if len(s) else s
                    prefixes.append(p)
                    offsets.append(offsets[-1] + len(p))
                both, maps = [digest(s) for s in sets], [bitmap(s) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, U)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + m)), batch.column(0).slice(at, m), batch.column(2).slice(at, m), pa.array([len(s) for s in sets], pa.int64()), pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int64()), lists, pa.array(maps, pa.binary()), pa.array([halved(b) for b in maps], pa.binary())], names=["uid", "id", "null_key", "n", "s1", "s2", "prefix", "bits", "half"])
                uid += m

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(make), f"uid long, id {kind}, null_key string, n long, s1 long, s2 long, prefix array<long>, bits binary, half binary")


BLOCKS = "gid long, block int, alone boolean, size int, lo long, hi long, members array<long>"


def token_blocks(sorted_tokens: DataFrame) -> DataFrame:
    """Rows in order of (token, seg, n, uid) -> blocks of the nodes that share a token."""

    def cut(batches):
        token = seg = None
        uids, sizes, parts, long_run = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, False
        out: list[tuple] = []

        def block(u, s, number, alone):
            gid = int((mix(u.view(U)).sum(dtype=U) if alone else U(token % (1 << 64))).view(np.int64))
            out.append((gid, number, alone, len(u), int(s[0]), int(s[-1]), u))

        def close():
            nonlocal parts, long_run
            whole = len(uids) <= BLOCK and not long_run and seg < 0
            if whole and len(uids) > 1:
                block(np.sort(uids), np.sort(sizes), 0, True)
            elif not whole:
                for i in range(0, len(uids), BLOCK):
                    block(uids[i : i + BLOCK], sizes[i : i + BLOCK], max(seg, 0) * 100_000 + parts, False)
                    parts += 1
            parts, long_run = 0, False

        def emit():
            made = [list(c) for c in zip(*out)] or [[] for _ in range(7)]
            arrays = [pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["gid", "block", "alone", "size", "lo", "hi", "members"])

        for batch in batches:
            t, g, n, u = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(t):
                continue
            heads = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])])
            ends = np.r_[heads[1:], len(t)]
            # only runs of two or more, the one at either end, and cut-up tokens matter
            matter = (ends - heads > 1) | (g[heads] >= 0)
            matter[[0, -1]] = True
            for a, b in zip(heads[matter].tolist(), ends[matter].tolist()):
                if t[a] != token or g[a] != seg:
                    if token is not None:
                        close()
                    token, seg, uids, sizes = int(t[a]), int(g[a]), u[a:b], n[a:b]
                else:
                    uids, sizes = np.r_[uids, u[a:b]], np.r_[sizes, n[a:b]]
                while len(uids) > 64 * BLOCK:
                    block(uids[:BLOCK], sizes[:BLOCK], max(seg, 0) * 100_000 + parts, False)
                    uids, sizes, parts, long_run = uids[BLOCK:], sizes[BLOCK:], parts + 1, True
            if len(out) > 2000:
                yield emit()
        if token is not None:
            close()
        if out:
            yield emit()

    return sorted_tokens.mapInArrow(trimmed(cut), BLOCKS)


def largest_overlaps(i: np.ndarray, j: np.ndarray, bits: np.ndarray, bits2: np.ndarray, slack: np.ndarray, slack2: np.ndarray) -> np.ndarray:
    """The bound of each pair (i, j), over so many pairs at a time that their bitmaps fit PAIR_BYTES."""
    step = max(1, PAIR_BYTES // (8 * bits.shape[1]))
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        out[at : at + step] = np.bitwise_count(bits[p] & bits2[q]).sum(axis=1) + np.minimum(slack[p], slack2[q])
    return out


class SignatureTree:
    """Levels of up to FAN children; level 0 has the nodes themselves."""

    FAN = 8

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, n, n, slack, label, label)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, slack, first, last = self.levels[-1]
            at = np.arange(0, len(bits), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def survivors(a: SignatureTree, b: SignatureTree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of nodes that may be linked, and the largest overlap they can have; i < j within one tree.

    overlap(x, y) <= shingles of x that share a bit with another of x + bits set in both; in inner nodes, the largest of
    the first, and the bits of the ORs for the second. A link needs 9 * overlap >= 4 * (|x| + |y|).
    """
    other = b or a
    depth = min(len(a.levels), len(other.levels)) - 1
    one, two = np.arange(len(a.levels[depth][0])), np.arange(len(other.levels[depth][0]))
    i, j = np.repeat(one, len(two)), np.tile(two, len(one))
    if b is None:
        i, j = i[i <= j], j[i <= j]
    for level in range(depth, -1, -1):
        bits, lo, hi, slack, first, last = a.levels[level]
        bits2, lo2, hi2, slack2, first2, last2 = other.levels[level]
        if b is None and level == 0:
            i, j = i[i < j], j[i < j]
        sizes = (5 * hi[i] >= 4 * lo2[j]) & (5 * hi2[j] >= 4 * lo[i])
        one_label = (first[i] == last[i]) & (first2[j] == last2[j]) & (first[i] == first2[j])
        i, j = i[sizes & ~one_label], j[sizes & ~one_label]
        bound = largest_overlaps(i, j, bits, bits2, slack, slack2)
        may = 9 * bound >= 4 * (lo[i] + lo2[j])
        i, j, bound = i[may], j[may], bound[may]
        if level:
            down, down2 = len(a.levels[level - 1][0]), len(other.levels[level - 1][0])
            fan = np.arange(SignatureTree.FAN)
            ci = (i[:, None, None] * SignatureTree.FAN + fan[None, :, None]).repeat(SignatureTree.FAN, 2).ravel()
            cj = (j[:, None, None] * SignatureTree.FAN + fan[None, None, :]).repeat(SignatureTree.FAN, 1).ravel()
            inside = (ci < down) & (cj < down2) & ((ci <= cj) if b is None else True)
            i, j = ci[inside], cj[inside]
    return i, j, bound


def block_hubs(i: np.ndarray, j: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a block, its neighbour of most pairs (then of the smallest uid), if that comes before the node itself."""
    ends, other = np.r_[i, j], np.r_[j, i]
    order = np.lexsort((-uid, np.bincount(ends, minlength=len(uid))))
    rank = np.empty(len(uid), np.int64)
    rank[order] = np.arange(len(uid))
    best = np.full(len(uid), -1)
    np.maximum.at(best, ends, rank[other])
    node = np.flatnonzero(best > rank)
    return node, order[best[node]]


def _runs(batches, key: int, handle):
    """Calls handle(rows) for whole runs of equal keys: numpy columns, with the runs' bounds."""
    held = None
    for batch in batches:
        if batch.num_rows:
            held = batch if held is None else pa.concat_batches([held, batch])
            k = held.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield from handle(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None:
        yield from handle(held)


class Bitmaps:
    """Bitmaps of several widths: rows and matrix of each width."""

    def __init__(self, column):
        rows = column if isinstance(column, list) else column.to_pylist()
        widths = np.array([8 * len(r) for r in rows])
        self.by = {int(w): (at := np.flatnonzero(widths == w), np.frombuffer(b"".join([rows[i] for i in at]), U).reshape(len(at), -1)) for w in np.unique(widths)}

    def within(self, first: int, last: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The part of rows first to last, numbered from there."""
        out = {}
        for w, (at, bits) in self.by.items():
            a, b = np.searchsorted(at, (first, last))
            if b > a:
                out[w] = (at[a:b] - first, bits[a:b])
        return out


def block_survivors(n: np.ndarray, label: np.ndarray, one: dict, two: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """survivors() over the widths of a block, or of two: linked nodes' widths are equal or neighbouring powers of two."""
    found = [(np.zeros(0, np.int64),) * 3]
    for w, (at, bits) in one.items():
        for v in (w, 2 * w) if two is None else (w // 2, w, 2 * w):
            if v not in (one if two is None else two):
                continue
            to, other = (one if two is None else two)[v]
            width = min(v, w)
            tree = SignatureTree(n[at], folded(bits, width), label[at])
            same = two is None and v == w
            i, j, bound = survivors(tree, None if same else SignatureTree(n[to], folded(other, width), label[to]))
            found.append((at[i], to[j], bound))
    return tuple(np.concatenate(x) for x in zip(*found))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def small_pairs(blocks: DataFrame, half: DataFrame) -> DataFrame:
    """Blocks of at most SMALL nodes -> their pairs, each once, that may be linked. half: uid, n and the bitmap that travels.

    Near copies of long texts share many tokens in many combinations: their pairs are far fewer than their blocks' members.
    """
    each = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.lit(SMALL)), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    pairs = blocks.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct()
    first = pairs.join(half.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    both = first.join(half.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")

    def check(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in range(4))
            left, right = Bitmaps(batch.column(4)), Bitmaps(batch.column(5))
            ok = np.zeros(len(a), bool)
            for w, (at, bits) in left.by.items():
                for v, (to, other) in right.by.items():
                    rows = np.intersect1d(at, to)
                    if len(rows) and max(w, v) <= 2 * min(w, v):
                        x, y = folded(bits[np.searchsorted(at, rows)], min(w, v)), folded(other[np.searchsorted(to, rows)], min(w, v))
                        slack = np.minimum(na[rows] - np.bitwise_count(x).sum(axis=1), nb[rows] - np.bitwise_count(y).sum(axis=1))
                        ok[rows] = 9 * (np.bitwise_count(x & y).sum(axis=1) + slack) >= 4 * (na[rows] + nb[rows])
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], schema=PAIRS)

    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(trimmed(check), "a long, b long")


def block_pairs(rows: DataFrame) -> DataFrame:
    """Rows (bid, uid, n, bits) of larger blocks, sorted by (bid, n, uid) -> each node's pair with its hub."""

    def traverse(part):
        k, n, uid = (part.column(c).to_numpy() for c in (0, 2, 1))
        maps = Bitmaps(part.column(3))
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        found = [(np.zeros(0, np.int64),) * 2]
        for head, end in zip(heads.tolist(), [*heads[1:].tolist(), len(k)]):
            own = uid[head:end]
            i, j, _ = block_survivors(n[head:end], own, maps.within(head, end))
            i, j = block_hubs(i, j, own)
            found.append((i + head, j + head))
        i, j = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[i], uid[j])), pa.array(np.maximum(uid[i], uid[j]))], schema=PAIRS)

    return rows.select("bid", "uid", "n", "bits").mapInArrow(trimmed(lambda batches: _runs(batches, 0, traverse)), "a long, b long")


MET = pa.schema([("part", pa.int64()), ("side", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def parts_of(uid: np.ndarray, n: np.ndarray, sides: list[np.ndarray], numbers: Iterator[int]) -> list[np.ndarray]:
    """(part, side, uid) of the nodes at places `sides`: parts of a run of each side, or of one side of two runs of it or of one alone."""
    cut = [np.split(at, np.flatnonzero(np.diff(np.cumsum(8 * n[at]) // PART_BYTES)) + 1) for at in sides]
    out = []
    for p, first in enumerate(cut[0]):
        for second in cut[1] if len(cut) > 1 else [None, *cut[0][p + 1 :]]:
            number = next(numbers)
            out += [np.stack([np.full(len(at), number), np.full(len(at), side), uid[at]], axis=1) for side, at in enumerate((first, second)) if at is not None]
    return out


def tile_pairs(rows: DataFrame) -> DataFrame:
    """Rows (tile, side, uid, n, label, bits) sorted by (tile, side, label, n) -> surviving pairs (a, b) of different labels.

    A tile with more pairs than nodes gives the nodes of these instead, for `tight_links`: (part, side, a), in parts of at most two times
    PART_BYTES of whole sets; any pair of them is in one part.
    """

    def emit(held):
        pairs = np.unique(np.concatenate(held["pairs"]), axis=0) if held["pairs"] else np.zeros((0, 2), np.int64)
        whole = np.concatenate([*held["parts"], np.zeros((0, 3), np.int64)])
        held["pairs"], held["parts"] = [], []
        none = np.r_[np.ones(len(pairs), bool), np.zeros(len(whole), bool)]
        part, side, a, b = (np.r_[x, y] for x, y in ((pairs[:, 0], whole[:, 0]), (pairs[:, 0], whole[:, 1]), (pairs[:, 0], whole[:, 2]), (pairs[:, 1], whole[:, 2])))
        yield pa.RecordBatch.from_arrays([pa.array(part, mask=none), pa.array(side.astype(np.int32), mask=none), pa.array(a), pa.array(b, mask=~none)], schema=MET)

    def traverse(part, numbers):
        held: dict[str, list[np.ndarray]] = {"pairs": [], "parts": []}
        tile, side, uid, n, label = (part.column(c).to_numpy() for c in range(5))
        maps = Bitmaps(part.column(5))
        heads = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(tile)]):
            mid = a + int(np.searchsorted(side[a:b], 1))
            if mid == b:
                i, j, _ = block_survivors(n[a:b], label[a:b], maps.within(a, b))
            else:
                # rows of the second side keep their numbers after the first's
                right = {w: (at + (mid - a), bits) for w, (at, bits) in maps.within(mid, b).items()}
                i, j, _ = block_survivors(n[a:b], label[a:b], maps.within(a, mid), right)
            differ = label[a + i] != label[a + j]
            i, j = a + i[differ], a + j[differ]
            if len(i) > b - a:
                held["parts"] += parts_of(uid, n, [np.unique(np.r_[i, j])] if mid == b else [np.unique(i), np.unique(j)], numbers)
            else:
                held["pairs"].append(np.stack([np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])], axis=1))
            if sum(map(len, held["pairs"])) + sum(map(len, held["parts"])) > 200_000:
                yield from emit(held)
        yield from emit(held)

    def run(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 34)
        yield from _runs(batches, 0, lambda part: traverse(part, numbers))

    return rows.select("tile", "side", "uid", "n", "label", "bits").mapInArrow(trimmed(run), "part long, side int, a long, b long")


def tight_links(rows: DataFrame) -> DataFrame:
    """Rows (part, side, uid, label, set) sorted by (part, side, label) -> links between labels: of all pairs of whole sets in a part (of its two sides,
    where it has two) as many as connect the labels that they connect."""

    def links(uid: np.ndarray, label: np.ndarray, sets: list[np.ndarray], mid: int):
        n = np.array([len(s) for s in sets])
        maps = Bitmaps([bitmap(s) for s in sets])
        if mid == len(uid):
            i, j, _ = block_survivors(n, label, maps.within(0, mid))
        else:
            right = {w: (at + mid, bits) for w, (at, bits) in maps.within(mid, len(uid)).items()}
            i, j, _ = block_survivors(n, label, maps.within(0, mid), right)
        order = np.argsort(i, kind="stable")
        i, j, root = i[order], j[order], label.copy()
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for a, b in zip(heads, [*heads[1:], len(i)]):
            one, to = sets[i[a]], j[a:b]
            # as many at a time as fit PAIR_BYTES
            for near in np.split(to, np.flatnonzero(np.diff(np.cumsum(8 * n[to]) // PAIR_BYTES)) + 1):
                near = near[root[near] != root[i[a]]]
                if not len(near):
                    continue
                all_of = np.concatenate([sets[x] for x in near])
                same = one[np.minimum(np.searchsorted(one, all_of), len(one) - 1)] == all_of
                both = np.add.reduceat(same.astype(np.int64), np.r_[0, np.cumsum(n[near])[:-1]])
                for x in near[100 * both >= 80 * (len(one) + n[near] - both)]:
                    if root[x] != root[i[a]]:
                        root[root == root[x]] = root[i[a]]
                        yield uid[i[a]], uid[x]

    def verify(held):
        part, side, uid, label = (held.column(c).to_numpy() for c in range(4))
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        found: list = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)]):
            sets = [np.frombuffer(x.as_buffer(), U) for x in held.column(4).slice(a, b - a)]
            found.extend(links(uid[a:b], label[a:b], sets, int(np.searchsorted(side[a:b], 1))))
        ends = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))] if len(ends) else [pa.array([], pa.int64())] * 2, schema=PAIRS)

    return rows.select("part", "side", "uid", "label", "set").mapInArrow(trimmed(lambda batches: _runs(batches, 0, verify)), "a long, b long")


def whole_sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid and set (its hashes' bytes) of the wanted nodes, made from their texts again; a node may come twice if ids repeat."""
    who = written(nodes.join(wanted, "uid", "left_semi").select("uid", "id", "n", "s1", "s2"), "join-wanted")
    ids = who.select("id").distinct()
    small = isinstance(rows.schema["id"].dataType, NumericType) and who.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if small else ids
    texts = rows.join(ids.withColumnRenamed("id", "_id"), rows["id"].eqNullSafe(F.col("_id")), "left_semi").select("text")

    def make(batches):
        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                sets = shingle_sets(data, off)
                both = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "s1", "s2", "set"])

    sets = texts.mapInArrow(trimmed(make), "n long, s1 long, s2 long, set binary")
    key = who.select("uid", "n", "s1", "s2")
    return sets.join(F.broadcast(key) if small else key, ["n", "s1", "s2"]).select("uid", "set")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets link."""
    wanted = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
    sets = written(whole_sets(rows, nodes, wanted), "join-sets")

    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), bool)
            last, one = None, None
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                if last is None or a[r] != last:
                    last, one = a[r], np.frombuffer(x.as_buffer(), U)
                two = np.frombuffer(y.as_buffer(), U)
                at = np.minimum(np.searchsorted(one, two), len(one) - 1)
                both = int((one[at] == two).sum())
                ok[r] = 100 * both >= 80 * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], schema=PAIRS)

    first = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("set_a")), "a")
    second = first.join(sets.select(F.col("uid").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return written(second.mapInArrow(trimmed(check), "a long, b long").distinct(), "join-links")


def toward_hubs(pairs: DataFrame) -> DataFrame:
    """For each node the pair with its neighbour of most pairs, if that has more than itself: one pair a node at most.

    In a group that is all alike, everyone picks the same node, and one round of verification links the group.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = written(both.groupBy("a").agg(F.count("*").alias("d")), "join-degrees")
    ranked = both.join(degrees.select(F.col("a").alias("b"), F.col("d").alias("d_b")), "b")
    best = ranked.groupBy("a").agg(F.max(F.struct("d_b", "b")).alias("best")).join(degrees, "a")
    return best.where(F.col("best") > F.struct("d", "a")).select("a", F.col("best.b").alias("b"))


class Settled:
    """The components that the links found so far make: the smallest node of each linked one."""

    def __init__(self, rows: DataFrame, nodes: DataFrame):
        self.rows, self.nodes = rows, nodes
        self.labels = rows.sparkSession.createDataFrame([], "node long, label long")

    def label(self, df: DataFrame, uid: str, name: str) -> DataFrame:
        return df.join(self.labels.select(F.col("node").alias(uid), F.col("label").alias("_l")), uid, "left").withColumn(name, F.coalesce("_l", uid)).drop("_l")

    def merge(self, found: DataFrame) -> None:
        """Labels after more links: components of the labels that these link, so that earlier links are not gone through again."""
        ends = self.label(self.label(found, "a", "la"), "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        joined = components(ends)
        moved = self.labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        self.labels = written(moved.unionByName(joined.join(self.labels, "node", "left_anti")), "join-labels")

    def settle(self, pairs: DataFrame, hub_rounds: int = 2) -> None:
        """Verifies pairs until none is left whose nodes are in two components: towards hubs first, then all."""
        left = pairs
        for turn in range(hub_rounds + 1):
            if not left.take(1):
                return
            chosen = written(toward_hubs(left) if turn < hub_rounds else left, "join-chosen")
            found = verified(chosen, self.rows, self.nodes)
            if found.take(1):
                self.merge(found)
            ordered = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            rest = left.join(ordered, ["a", "b"], "left_anti")
            left = written(self.label(self.label(rest, "a", "la"), "b", "lb").where("la <> lb").select("a", "b"), "join-left")

    def settle_parts(self, parts: DataFrame) -> None:
        """Verifies all pairs of the nodes of a part (part, side, uid), where they are."""
        named = written(self.label(parts, "uid", "label"), "join-parts")
        mixed = named.groupBy("part").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("part")
        left = written(named.join(mixed, "part", "left_semi"), "join-mixed")
        if not left.take(1):
            return
        sets = written(whole_sets(self.rows, self.nodes, left.select("uid").distinct()), "join-sets").dropDuplicates(["uid"])
        placed = left.join(sets, "uid").repartition("part").sortWithinPartitions("part", "side", "label", "uid")
        found = written(tight_links(placed).distinct(), "join-links")
        if found.take(1):
            self.merge(found)


def tiles_of(summary: DataFrame) -> DataFrame:
    """(gid, bid, lo, hi, first, last), a row per block -> the pairs of a group's blocks that can hold a link between components.

    Blocks meet by (group, band of sizes), bands a factor of 1.26 apart: a large group joins its neighbouring sizes only.
    """
    band = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / math.log(1.26)).cast("int")
    side = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("bid", "lo", "hi", "first", "last")]
    left = summary.select("gid", *side(1), F.explode(F.sequence(band("lo"), band("hi"))).alias("band"))
    right = summary.select("gid", *side(2), F.explode(F.sequence(band("lo") - 1, band("hi") + 1)).alias("band"))
    one_label = (F.col("first1") == F.col("last1")) & (F.col("first2") == F.col("last2")) & (F.col("first1") == F.col("first2"))
    met = left.join(right, ["gid", "band"]).where((F.col("bid1") <= F.col("bid2")) & (5 * F.col("hi1") >= 4 * F.col("lo2")) & (5 * F.col("hi2") >= 4 * F.col("lo1")) & ~one_label)
    return met.select("bid1", "bid2").distinct().withColumn("tile", F.monotonically_increasing_id())


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, set_rows (rows with the same set) of each row of docs, and null_key: for
    rows without id that stand for a component without ids, the SHA-256 of their text, else null."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common, common_n = common_shingles(rows, rows.count())
    keyed_rows = rows.withColumn("null_key", F.when(F.col("id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)))
    every = written(nodes_of(keyed_rows, common), "join-rows")
    # nodes: one for each set
    nodes = written(every.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("uid").alias("uid"), F.min("id").alias("id"), F.min("null_key").alias("null_key"), F.count("*").alias("rows"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("half").alias("half")), "join-nodes")
    tokens = nodes.select("uid", "n", F.explode("prefix").alias("token"))
    cut_up = {int(h.view(np.int64)): int(-(-n // SEGMENT)) for h, n in zip(common, common_n) if n > SEGMENT}
    seg = F.lit(-1)
    if cut_up:  # at most MOST_COMMON
        hot = spark.createDataFrame(list(cut_up.items()), "token long, segs int")
        tokens = tokens.join(F.broadcast(hot), "token", "left")
        seg = F.when(F.col("segs").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("uid"), F.col("segs"))).cast("int")
    keyed = tokens.select("token", seg.alias("seg"), "n", "uid").repartition("token", "seg").sortWithinPartitions("token", "seg", "n", "uid")
    blocks = written(token_blocks(keyed), "join-cuts", rows=50_000)
    alone = blocks.where("alone").groupBy("gid", "size", "lo", "hi").agg(F.first("members").alias("members")).select("gid", F.lit(0).alias("block"), "size", "lo", "hi", "members")
    blocks = written(alone.unionByName(blocks.where("not alone").select("gid", "block", "size", "lo", "hi", "members")).withColumn("bid", F.monotonically_increasing_id()), "join-blocks")
    half = nodes.select("uid", "n", F.col("half").alias("bits"))
    members = blocks.where(F.col("size") > SMALL).select("bid", F.explode("members").alias("uid")).join(half, "uid")
    hubs = block_pairs(members.repartition("bid").sortWithinPartitions("bid", "n", "uid"))
    near = written(small_pairs(blocks.where(F.col("size") <= SMALL), half).unionByName(hubs).distinct(), "join-pairs")
    settled = Settled(rows, nodes)
    settled.settle(near)

    # groups with more nodes than a small block, which still hold several components
    many = blocks.where((F.col("size") > SMALL) | (F.col("block") > 0)).select("gid").distinct()
    open_blocks = blocks.join(many, "gid", "left_semi")
    named = settled.label(open_blocks.select("gid", "bid", F.explode("members").alias("uid")), "uid", "label")
    ranges = named.groupBy("gid", "bid").agg(F.min("label").alias("first"), F.max("label").alias("last"))
    mixed = ranges.groupBy("gid").agg(F.min("first").alias("g0"), F.max("last").alias("g1")).where("g0 <> g1").select("gid")
    summary = written(open_blocks.select("gid", "bid", "lo", "hi").join(mixed, "gid", "left_semi").join(ranges.select("bid", "first", "last"), "bid"), "join-summary")
    tiles = written(tiles_of(summary), "join-tiles")
    if tiles.take(1):
        sides = tiles.select("tile", F.lit(0).alias("side"), F.col("bid1").alias("bid")).union(tiles.where("bid1 <> bid2").select("tile", F.lit(1).alias("side"), F.col("bid2").alias("bid")))
        placed = sides.join(blocks.select("bid", "members"), "bid").select("tile", "side", F.explode("members").alias("uid"))
        full = placed.join(settled.label(half, "uid", "label"), "uid")
        met = written(tile_pairs(full.repartition("tile").sortWithinPartitions("tile", "side", "label", "n", "uid")), "join-met")
        settled.settle(written(met.where("part is null").select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "join-rest"))
        settled.settle_parts(met.where("part is not null").select("part", "side", F.col("a").alias("uid")))

    # back to rows: a set's node, its label, and the label's smallest id
    sets = written(settled.label(nodes.select("s1", "s2", "n", "uid", "id", "null_key", "rows"), "uid", "label"), "join-set-labels")
    smallest = sets.groupBy("label").agg(F.min("id").alias("component_id"), F.min("null_key").alias("first_key"))
    named = written(sets.join(smallest, "label").select("s1", "s2", "n", "component_id", "first_key", "rows"), "join-named")
    out = every.select("id", "null_key", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    in_set = F.col("n") > 0
    # a row without an id stands for its component if that has no id at all and the row's text comes first by its hash
    stands = F.col("null_key").isNotNull() & (~in_set | (F.col("component_id").isNull() & (F.col("null_key") == F.col("first_key"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(in_set, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("rows", F.lit(1)).alias("set_rows"), F.when(stands, F.col("null_key")).alias("null_key"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """One document of each component. Same columns as docs.

    It is the one with the smallest id, or of a component without ids the text whose SHA-256 comes first. Rows that share that
    id and text count as one; rows that share the id with another text all stay. Without words, every text stays (null and
    equal ones without id as one).
    """
    own = free_name("_id", docs.columns)
    key = free_name("_null_key", [*docs.columns, own])
    linked = written(linked_components(docs), "join-linked")
    first = linked.where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    # texts are shuffled once, whatever the size: ids that travel whole would not stay small
    kept = docs.join(first.hint("shuffle_hash"), docs["doc_id"] == F.col(own), "left_semi")
    without = linked.where("null_key is not null").select(F.col("null_key").alias(key)).distinct()
    if without.take(1):
        nameless = docs.where("doc_id is null")
        kept = kept.unionByName(nameless.join(without, F.sha2(F.coalesce(nameless["text"], F.lit("")), 256) == F.col(key), "left_semi"))
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated.take(1) else kept


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
