"""Near-duplicate posts and greedy clusters by vector similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..sources.fixtures import table, view
from ..sources.tables import written
from .tables import top_per_key
from .vectors import BLOCK, QUERY_BYTES, unit_rows


def near_pairs(posts: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """(batch, a, b, cosine), a < b: every pair of a batch with cosine above the threshold.

    A batch is cut into blocks of about `size` rows, and a task compares two blocks by a matrix product: a batch of any size
    is spread over tasks.
    """
    rows = posts.where("embedding is not null").select("batch", "id", F.col("embedding").alias("x"))
    return _compared(rows.withColumn("bucket", F.lit(0).cast("long")), threshold, size)


def _compared(rows: DataFrame, threshold: float, size: int) -> DataFrame:
    """(batch, a, b, cosine) of the pairs above the threshold in each (batch, bucket) of rows: batch, bucket, id, x."""
    parts = rows.groupBy("batch", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("batch", "bucket", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    filed = rows.join(parts, ["batch", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def compare(batches):
        for whole in batches:
            keys = [whole.column(c).to_numpy() for c in range(4)]
            heads = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if whole.num_rows else []
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            x, ids, own = unit_rows(pa.chunked_array([whole.column(6)])), whole.column(5).to_numpy(), whole.column(4).to_numpy()
            for s, e in zip(heads, [*heads[1:], whole.num_rows]):
                lo, hi = keys[2][s], keys[3][s]
                left, right = s + np.flatnonzero(own[s:e] == lo), s + np.flatnonzero(own[s:e] == hi)
                for i in range(0, len(left), 200):
                    like = np.round(x[left[i : i + 200]] @ x[right].T, 9)
                    at, to = np.nonzero(like > threshold)
                    p, q = ids[left[i + at]], ids[right[to]]
                    once = p < q if lo == hi else np.ones(len(p), bool)
                    found.append((np.full(int(once.sum()), keys[0][s]), np.minimum(p, q)[once], np.maximum(p, q)[once], like[at, to][once]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["batch", "a", "b", "cosine"])

    def whole_groups(batches):
        """Rows in order of their group -> batches of whole groups."""
        held = None
        for batch in batches:
            if batch.num_rows:
                held = batch if held is None else pa.concat_batches([held, batch])
                last = np.all([(k := held.column(c).to_numpy()) == k[-1] for c in range(4)], axis=0)
                cut = int(np.argmax(last))
                if cut:
                    yield from compare([held.slice(0, cut)])
                    held = held.slice(cut)
        if held is not None:
            yield from compare([held])

    keys = ["batch", "bucket", "lo", "hi"]
    columns = filed.select(F.col("batch").cast("long").alias("batch"), "bucket", "lo", "hi", "own", F.col("id").cast("long").alias("id"), "x")
    return columns.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(whole_groups, "batch long, a long, b long, cosine double")


# ---- candidates by random sign bits

#: Of a row's cost: shuffling it once, in comparisons of two rows.
FILING = 300


def sign_plan(threshold: float, recall: float, rows: float, width: int, seed: int = 5, most_tables: int = 64) -> tuple[int, int, int] | None:
    """(bits, probes, tables) that find a pair of the threshold's cosine with the wished probability at the least expected cost, for a
    batch of so many rows; None where comparing all pairs costs no more.

    A row is filed in each table under its own bits and under those with one of its `probes` least certain bits turned over. How often two rows
    then share a bucket is simulated with pairs at the threshold and with independent ones; closer pairs are found more often.
    """
    rng = np.random.default_rng(seed)
    n, best, cost = 4000, None, rows / 2 + FILING * max(1.0, rows / BLOCK)
    x, y = rng.normal(size=(2, n, width))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    x = unit(x)
    y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    near = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y
    far = unit(rng.normal(size=(n, width)))
    for bits in range(2, 25):
        planes = rng.normal(size=(width, bits))
        sides = [m @ planes for m in (x, near, far)]
        for probes in range(0, min(bits, 6)):
            keys = [_buckets(s, probes) for s in sides]
            share = [np.mean((keys[0][:, :, None] == other[:, None, :]).any(axis=(1, 2))) for other in keys[1:]]
            if share[0] <= 0:
                continue
            tables = 1 if share[0] >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - share[0])))
            if tables > most_tables:
                continue
            filed = tables * (1 + probes)
            expected = rows * filed * max(share[1] / (1 + probes), 2.0**-bits) / 2 + FILING * filed
            if expected < cost:
                best, cost = (bits, probes, tables), expected
    return best


def _buckets(sides: np.ndarray, probes: int) -> np.ndarray:
    """The keys of rows, given their products with the planes: own bits first, then with one of the least certain ones turned over."""
    weights = 1 << np.arange(sides.shape[1], dtype=np.int64)
    own = (sides > 0) @ weights
    unsure = np.argsort(np.abs(sides), axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None], own[:, None] ^ weights[unsure]], axis=1)


def sign_pairs(posts: DataFrame, threshold: float, recall: float = 0.95, size: int = BLOCK, seed: int = 5, width: int | None = None) -> DataFrame:
    """(batch, a, b, cosine), a < b: pairs of a batch with cosine above the threshold, each found with the wished probability at least.

    Bits, probes and tables follow from threshold, recall and the largest batch (`sign_plan`); where they would save nothing, all pairs are
    compared. Rows of one bucket are compared by matrix products of blocks, so a hot bucket is split and not cut off.
    """
    posts = posts if "batch" in posts.columns else posts.withColumn("batch", F.lit(0).cast("long"))
    rows = posts.where("embedding is not null").select("batch", "id", F.col("embedding").alias("x"))
    largest = rows.groupBy("batch").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).agg(F.max("n"), F.max("w")).first()
    plan = sign_plan(threshold, recall, float(largest[0] or 0), width or largest[1] or 1, seed)
    if plan is None:
        return near_pairs(posts, threshold, size)
    bits, probes, tables = plan
    planes = np.random.default_rng([seed, 1]).normal(size=(width or largest[1], tables * bits))

    def file(batches):
        for batch in batches:
            sides = unit_rows(pa.chunked_array([batch.column(2)])) @ planes if batch.num_rows else np.zeros((0, tables * bits))
            keys = np.concatenate([(t << 32) | _buckets(sides[:, t * bits : (t + 1) * bits], probes) for t in range(tables)], axis=1)
            at = np.repeat(np.arange(batch.num_rows), keys.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys.ravel()), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at))], names=["batch", "bucket", "id", "x"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("batch", "id", "x")}
    filed = rows.mapInArrow(file, f"batch {kinds['batch']}, bucket long, id {kinds['id']}, x {kinds['x']}")
    return _compared(written(filed, "sign-buckets"), threshold, size).distinct()


def keep_local_best(scores: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, kept): in rounds, a row with no better undecided neighbour stays and its neighbours go. scores: id, score.

    Each round decides at least the best undecided row, so the rounds end by themselves.
    """
    edges = written(pairs.select(*by, "a", "b").union(pairs.select(*by, "b", "a")), "similar-edges")
    state = written(scores.select(*by, "id", "score", F.lit(None).cast("boolean").alias("kept")), "similar-state")
    while (live := state.where("kept is null")).take(1):
        rank = lambda df, to: df.select(*by, F.col("id").alias(to), F.struct(F.col("score"), -F.col("id")).alias(f"r_{to}"))
        between = edges.join(rank(live, "a"), [*by, "a"]).join(rank(live, "b"), [*by, "b"])
        beaten = between.where("r_b > r_a").select(*by, F.col("a").alias("id")).distinct()
        best = live.join(beaten, [*by, "id"], "left_anti").select(*by, "id")
        gone = edges.join(best.withColumnRenamed("id", "a"), [*by, "a"]).select(*by, F.col("b").alias("id")).distinct()
        verdict = best.withColumn("new", F.lit(True)).unionByName(gone.withColumn("new", F.lit(False)))
        state = written(state.join(verdict, [*by, "id"], "left").select(*by, "id", "score", F.coalesce("kept", "new").alias("kept")), "similar-state")
    return state.select(*by, "id", "kept")


#: Rows that one task holds of the lists of a round's front.
LISTED = 1_000_000


class Rounds:
    """A table of posts (batch, id, score, embedding) decided in rounds, each batch's posts in the order (score desc, id).

    A round's front is the first so many undecided posts of each batch. It is small: one task decides a batch's front, and the vectors of
    all fronts travel to the tasks that read the undecided posts. No pair is stored, and no more than a front's part of all pairs compared.
    """

    def __init__(self, posts: DataFrame, size: int):
        self.size, self.width = size, None
        self.live = self._keep(posts.select("batch", "id", "score", "embedding"))

    def _keep(self, live: DataFrame) -> DataFrame:
        live = written(live, "undecided")
        self.sizes = {r["batch"]: r["n"] for r in live.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") > self.size).collect()}
        return live

    def split(self) -> tuple[DataFrame, DataFrame]:
        """Undecided posts of batches that one task can take whole, and those of the others."""
        large = F.col("batch").isin(list(self.sizes))
        return self.live.where(~large | F.col("batch").isNull()), self.live.where(large)

    def front(self, large: DataFrame, most: int) -> DataFrame:
        """(batch, id, score, embedding, seed): the first undecided posts of each large batch, numbered; of many batches fewer each."""
        self.width = self.width or large.agg(F.max(F.size("embedding"))).first()[0] or 1
        most = max(1, min(most, QUERY_BYTES // (8 * self.width * len(self.sizes))))
        return written(top_per_key(large, ["batch"], most, F.desc("score"), F.col("id")).withColumnRenamed("rank", "seed"), "front")

    def beside(self, rows: DataFrame, front: DataFrame, threshold: float, most: int | None) -> DataFrame:
        """Rows beside those of their batch's front that are above the threshold: (batch, seed, id, score, cosine), of each Arrow batch
        at most the `most` nearest of a seed; without `most`, the ids of such rows: (batch, id)."""
        table = front.where("embedding is not null").select("batch", "seed", "id", "embedding").orderBy("batch", "seed").toArrow()
        of, matrix = table.column("batch").to_numpy(), unit_rows(table.column("embedding")) if len(table) else np.zeros((0, 1))
        sent = rows.sparkSession.sparkContext.broadcast((of, table.column("seed").to_numpy(), table.column("id").to_numpy(), matrix))

        def compare(batches):
            of, seeds, own, matrix = sent.value
            for batch in batches:
                here = batch.column(0).to_numpy()
                for b in np.unique(here).tolist():
                    at, asks = np.flatnonzero(here == b), np.flatnonzero(of == b)
                    x, ids = unit_rows(pa.chunked_array([batch.column(3).take(pa.array(at))])), batch.column(1).take(pa.array(at)).to_numpy()
                    scores, met = batch.column(2).take(pa.array(at)), np.zeros(len(at), bool)
                    for i in range(0, len(asks), 100):
                        part = asks[i : i + 100]
                        like = np.round(matrix[part] @ x.T, 9)
                        if most is None:
                            met |= (like > threshold).any(axis=0)
                            continue
                        hit = (like > threshold) & (own[part][:, None] != ids)
                        if hit.shape[1] > most:
                            order = np.lexsort((np.broadcast_to(ids, like.shape), np.broadcast_to(-scores.to_numpy(), like.shape), np.where(hit, -like, 9.0)), axis=1)
                            np.put_along_axis(hit, order[:, most:], False, axis=1)
                        p, q = np.nonzero(hit)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), b, np.int64)), pa.array(seeds[part[p]]), pa.array(ids[q]), scores.take(pa.array(q)), pa.array(like[p, q])], names=["batch", "seed", "id", "score", "cosine"])
                    if most is None:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(met.sum()), b, np.int64)), pa.array(ids[met])], names=["batch", "id"])

        return rows.where("embedding is not null").mapInArrow(compare, "batch long, id long" if most is None else "batch long, seed long, id long, score double, cosine double")

    def drop(self, *decided: DataFrame) -> None:
        for some in decided:
            self.live = self.live.join(some.select("batch", "id"), ["batch", "id"], "left_anti")
        self.live = self._keep(self.live)


def _plain(posts: DataFrame) -> DataFrame:
    return posts.select(F.col("batch").cast("long").alias("batch"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), "embedding")


def dedup_in_blocks(posts: DataFrame, threshold: float, size: int = BLOCK, recall: float = 1.0) -> DataFrame:
    """(batch, id, kept): the verdicts of `dedup_semantic` for batches of any size.

    Of equal vectors only the best post is compared: whatever becomes of it, its copies go. While the kept posts of a front of about `size`
    remove much of a batch, it goes in such rounds; where posts are mostly unlike, their few near pairs are listed and decided.
    recall: with less than 1, a near pair is found with this probability at least (`sign_pairs`), for a work that does not grow
    with the square of a batch.
    """
    posts = written(_plain(posts), "similar-posts")
    alone = F.when(F.coalesce(F.forall("embedding", lambda x: x == 0), F.lit(True)) | F.lit(threshold >= 1), F.col("id"))
    first = posts.groupBy("batch", "embedding", alone.alias("alone")).agg(F.max_by("id", F.struct(F.col("score"), -F.col("id"))).alias("id")).select("batch", "id")
    some = written(posts.join(first, ["batch", "id"], "left_semi"), "similar-firsts")
    verdict = keep_local_best(some, sign_pairs(some, threshold, recall, size), ("batch",)) if recall < 1 else _dedup_in_rounds(some, threshold, size)
    return posts.select("batch", "id").join(verdict, ["batch", "id"], "left").select("batch", "id", F.coalesce("kept", F.lit(False)).alias("kept"))


def _dedup_in_rounds(posts: DataFrame, threshold: float, size: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of posts of a batch in order those that no kept one before them removes."""
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        known = pdf["embedding"].notna().to_numpy()
        near, alive = _matrix(pdf[known]) if known.any() else np.zeros((0, 1)), np.ones(int(known.sum()), bool)
        for i in range(len(alive)):
            if alive[i]:
                alive[i + 1 :] &= np.round(near[i + 1 :] @ near[i], 9) <= threshold
        kept = np.ones(len(pdf), bool)
        kept[known] = alive
        return pdf.assign(kept=kept)[["batch", "id", "kept"]]

    decide = lambda df: written(df.select("batch", "id", "score", "embedding").groupBy("batch").applyInPandas(run, "batch long, id long, kept boolean"), "similar-verdicts")
    rounds, done = Rounds(posts, size), None
    while True:
        small, large = rounds.split()
        if not rounds.sizes:
            last = decide(small)
            return last if done is None else done.unionByName(last)
        before = sum(rounds.sizes.values())
        front = rounds.front(large, size)
        verdict = decide(front)
        kept = front.join(verdict.where("kept"), ["batch", "id"], "left_semi")
        gone = written(rounds.beside(large.join(verdict, ["batch", "id"], "left_anti"), kept, threshold, None), "similar-gone").withColumn("kept", F.lit(False))
        done = verdict.unionByName(gone) if done is None else done.unionByName(verdict).unionByName(gone)
        rounds.drop(verdict, gone)
        if rounds.sizes and sum(rounds.sizes.values()) > 0.9 * before:
            rest = keep_local_best(rounds.live, near_pairs(rounds.live, threshold, size), ("batch",))
            return done.unionByName(rest)


def clusters_in_blocks(posts: DataFrame, threshold: float, most: int = 25, least: int = 3, size: int = BLOCK) -> DataFrame:
    """(batch, id, cluster_id, position): the clusters of `greedy_clusters` for batches of any size.

    In rounds: of each post of a front its nearest undecided posts are listed, and one task a batch goes through the lists in the front's order, up to
    the first that is cut off and whose other posts are taken. A front's length falls when it was not reached to the end, down to where
    the lists always suffice: a round then decides all of its front. Batches of at most `size` posts are decided in one piece.
    """
    least_front = max(1, min(size, math.isqrt(LISTED // most)))

    def decided(key, seeds: np.ndarray, ids: np.ndarray, longest: int | None) -> pa.Table:
        """Lists in order, each headed by its own seed."""
        heads = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
        names, at = np.unique(ids, return_inverse=True)
        free, out = np.ones(len(names), bool), []
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(seeds)]):
            if not free[at[s]]:
                continue
            near = at[s + 1 : e]
            taken = near[free[near]][: most - 1]
            if longest is not None and len(taken) < most - 1 and len(near) >= longest:
                break
            taken = np.r_[at[s], taken]
            free[taken] = False
            out += [(names[taken], np.full(len(taken), ids[s]), np.arange(len(taken)))]
        new = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"batch": pa.array([key[0].as_py()] * len(new[0]), pa.int64()), "id": new[0], "seed": new[1], "position": new[2]})

    def whole(key, rows):
        rows = rows.sort_by([("score", "descending"), ("id", "ascending")])
        known = np.flatnonzero(rows.column("embedding").is_valid().to_numpy(zero_copy_only=False))
        ids, x = rows.column("id").to_numpy(), unit_rows(rows.column("embedding").take(pa.array(known))) if len(known) else np.zeros((0, 1))
        seeds, listed, place = [], [], {int(k): i for i, k in enumerate(known)}
        for i in range(len(ids)):
            near = np.zeros(0, np.int64)
            if i in place:
                like = np.round(x @ x[place[i]], 9)
                like[place[i]] = -2.0
                near = np.flatnonzero(like > threshold)
                near = known[near[np.argsort(-like[near], kind="stable")]]
            listed.append(np.r_[ids[i], ids[near]])
            seeds.append(np.full(len(near) + 1, i))
        return decided(key, np.concatenate(seeds), np.concatenate(listed), None)

    def in_order(longest: int):
        def run(key, rows):
            rows = rows.sort_by([("seed", "ascending"), ("cosine", "descending"), ("score", "descending"), ("id", "ascending")])
            return decided(key, rows.column("seed").to_numpy(), rows.column("id").to_numpy(), longest)

        return run

    posts = written(_plain(posts), "cluster-posts")
    form = "batch long, id long, seed long, position long"
    rounds, done, length = Rounds(posts, size), None, size
    while True:
        small, large = rounds.split()
        if not rounds.sizes:
            last = written(small.select("batch", "id", "score", "embedding").groupBy("batch").applyInArrow(whole, form), "clusters")
            done = last if done is None else done.unionByName(last)
            break
        front = rounds.front(large, length)
        longest = max(most, LISTED // length)
        heads = front.select("batch", "seed", "id", "score", F.lit(9.0).alias("cosine"))
        lists = top_per_key(rounds.beside(large, front, threshold, longest), ["batch", "seed"], longest, F.desc("cosine"), F.desc("score"), F.col("id")).drop("rank")
        new = written(heads.unionByName(lists).groupBy("batch").applyInArrow(in_order(longest), form), "clusters")
        missed = front.join(new, ["batch", "id"], "left_anti").count()
        length = max(least_front, length // 2) if missed > front.count() // 2 else min(size, length * 2)
        done = new if done is None else done.unionByName(new)
        rounds.drop(new)
    order = posts.select("batch", F.col("id").alias("seed"), F.struct(F.col("score"), -F.col("id")).alias("r"))
    big = done.groupBy("batch", "seed").count().where(F.col("count") >= least).join(order, ["batch", "seed"])
    numbers = big.select("batch", "seed", (F.row_number().over(W.partitionBy("batch").orderBy(F.desc("r"))).cast("long") - 1).alias("cluster_id"))
    return done.join(numbers, ["batch", "seed"], "left").select("batch", "id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"), "position")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    m = np.stack(pdf["embedding"].to_numpy()).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def dedup_semantic(posts: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(batch, id): each batch's posts without near copies, in the order (score desc, id): a kept post removes later ones.

    A batch is one digest's posts after its cut, which one task compares; `dedup_in_blocks` is for whole tables.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        near = _matrix(pdf)
        alive = np.ones(len(pdf), bool)
        for i in range(len(pdf)):
            if alive[i]:
                alive[i + 1 :] &= near[i + 1 :] @ near[i] <= threshold
        return pdf.loc[alive, ["batch", "id"]]

    return posts.select("batch", "id", "score", "embedding").groupBy("batch").applyInPandas(run, "batch long, id long")


def greedy_clusters(posts: DataFrame, threshold: float = 0.55, most: int = 25, least: int = 3) -> DataFrame:
    """(batch, id, cluster_id, position): seeds in order of score take their nearest unassigned posts; small ones are cluster -1.

    One task clusters a batch, a digest's posts after its cut; `clusters_in_blocks` is for whole tables.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        near = _matrix(pdf)
        cluster, position, n = np.full(len(pdf), -2), np.zeros(len(pdf), int), 0
        for i in range(len(pdf)):
            if cluster[i] != -2:
                continue
            like = near @ near[i]
            free = np.flatnonzero((cluster == -2) & (like > threshold) & (np.arange(len(pdf)) != i))
            taken = np.r_[i, free[np.argsort(-like[free], kind="stable")][: most - 1]]
            big = len(taken) >= least
            cluster[taken], position[taken] = (n if big else -1), np.arange(len(taken))
            n += big
        return pdf.assign(cluster_id=cluster, position=position)[["batch", "id", "cluster_id", "position"]]

    return posts.select("batch", "id", "score", "embedding").groupBy("batch").applyInPandas(run, "batch long, id long, cluster_id long, position long")


def _posts(spark, sf_dir, score: Column) -> DataFrame:
    v = view(spark, sf_dir, "vectors").join(table(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id"))
    return v.select(F.col("channel_id").cast("long").alias("batch"), "id", score.alias("score"), "embedding")


@query("d4_dedup_semantic")
def d4(spark, sf_dir):
    return dedup_in_blocks(_posts(spark, sf_dir, F.least(F.char_length("text") / 100, F.lit(5.0))), 0.35).where("kept").select("batch", "id")


@query("d4_dedup_semantic_scalable")
def d4s(spark, sf_dir):
    v = _posts(spark, sf_dir, F.least(F.char_length("text") / 100, F.lit(5.0)))
    return dedup_in_blocks(v.withColumn("batch", F.lit(0).cast("long")), 0.35).select("id", "kept")


def near_copies(spark, sf_dir: str) -> DataFrame:
    """Every post's vector, and of each a copy under an id of its own whose numbers are moved by up to a fifth of a unit row's mean."""
    v = _posts(spark, sf_dir, F.least(F.char_length("text") / 100, F.lit(5.0))).withColumn("batch", F.lit(0).cast("long"))
    moved = F.transform("embedding", lambda x, i: (x + (F.pmod(F.xxhash64("id", i), F.lit(1001)) / 1000 - 0.5) * 0.05).cast("float"))
    return v.unionByName(v.select("batch", (-F.col("id") - 1).alias("id"), (F.col("score") - 1).alias("score"), moved.alias("embedding")))


@query("d4_dedup_near_copies")
def d4c(spark, sf_dir):
    return dedup_in_blocks(near_copies(spark, sf_dir), 0.92, recall=0.97).select("id", "kept")


@query("c1_greedy_clusters")
def c1(spark, sf_dir):
    return clusters_in_blocks(_posts(spark, sf_dir, F.least(F.char_length("text") / 100, F.lit(5.0))), 0.3)
