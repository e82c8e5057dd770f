"""A stored inverted index: BM25 over blocks of postings, of which a search reads what may enter its top k.

Documents are dealt to ranges of 64. A block holds the postings of a term in a range: a mask with a bit for each document that has the
term, the largest frequency and the smallest length among them (so the largest gain they can have, whatever the mean length), and the hits
(slot, frequency, length; each packed in a number). A range has a row of its own, without a term: ids and lengths by slot, and their sums.

Blocks are stored by bucket of their term's hash and sorted by term inside, so a search opens its terms' buckets and the
pages of its terms. It reads the masks and bounds of its terms' blocks first: they give each term's number of documents, each query's number of
matches (the bits of the ORed masks), and the most that a document of each range can score. The best ranges are scored;
of the others only those that can still reach the k-th score found are read. While the queries' weights fit a table of some MB, the blocks are
read once instead and brought together by range, and the counts of documents are multiplied by that table.

New documents make new ranges, so an increment is appended without a look at earlier postings; a document with an id that is there already
replaces it: the old one's bit goes into a mask of what is gone. `merge` writes all again in one piece, without those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import batches, new_path, written
from .tables import top_per_key

K1, B = 1.2, 0.75
#: Documents of a range: the bits of a mask.
RANGE = 64
#: Up to so many query terms are sought by a list; more by a join.
MOST_TERMS, FEW = 5000, 100
#: Buckets of a stored index; ranges of each query that are scored first; a fixed point that keeps 13 digits of a gain.
BUCKETS, FIRST, POINT = 64, 8, float(1 << 44)
#: Numbers of a table that a task multiplies: 16 MB.
_CELLS = 2_000_000
#: A hit: 6 bits of slot, 29 of frequency, 29 of length.
HITS = "array<bigint>"
_TF, _DL, _29 = 6, 35, (1 << 29) - 1
_FIELDS = "term string, range long, mask long, max_tf int, min_dl int, packed " + HITS + ", ids array<{}>, dls array<int>, n long, known long, words long"


_POSTINGS = r", w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS ws FROM posts), f5 AS (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM w), post AS (SELECT id, term, CAST(dl AS BIGINT) AS dl, count(*) AS tf FROM f5 GROUP BY 1, 2, 3)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS["ru"])
_TERMS = rf", qw AS (SELECT query_id, list_filter(regexp_split_to_array(lower(regexp_replace(query_text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: length(x) >= 2) AS ws FROM queries), qf AS (SELECT query_id, ws, list_filter(ws, lambda x: x NOT IN ({_STOP})) AS fs FROM qw), qd AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(fs) > 0 THEN fs ELSE ws END) AS term FROM qf), qt AS (SELECT query_id, term, CASE WHEN length(term) >= 10 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM qd)"
_BM25 = _POSTINGS + _TERMS + ", st AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)::DOUBLE) AS avgdl FROM w), dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY 1), g AS (SELECT query_id, id, term, boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS g FROM post JOIN qt USING (term) JOIN dfs USING (term), st), sc AS (SELECT query_id, id, round(sum(g ORDER BY term), 4) AS score FROM g GROUP BY 1, 2), bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_matches FROM sc)"
BM25_SQL = cte("posts", "queries") + _BM25


def block_rows(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """id, content -> blocks and ranges, only the wanted terms' blocks where these are given. To be written before it is used twice."""
    kind = docs.schema["id"].dataType.simpleString()

    def pack(found):
        at = TaskContext.get().partitionId() << 24  # in units of a range
        for batch in found:
            m = batch.num_rows
            if not m:
                continue
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            doc, flat, dl = _words(batch.column(1))
            if wanted is not None:
                kept = pc.is_in(flat, value_set=pa.array(wanted, pa.string()))
                doc, flat = doc[kept.to_numpy(zero_copy_only=False)], flat.filter(kept)
            coded = flat.dictionary_encode()
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * m + doc, return_counts=True)
            code, doc = key // max(m, 1), key % max(m, 1)
            heads = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] // RANGE != doc[:-1] // RANGE)]) if len(key) else np.zeros(0, np.int64)
            masks = np.left_shift(np.uint64(1), (doc % RANGE).astype(np.uint64))
            reduced = lambda f, x: f.reduceat(x, heads) if len(heads) else x[:0]
            hits = pa.array(doc % RANGE | tf << _TF | dl[doc] << _DL, pa.int64())
            none = lambda n, kind: pa.nulls(n, kind)
            n, parts = len(heads), -(-m // RANGE)
            blocks = [coded.dictionary.take(pa.array(code[heads])), pa.array(at + doc[heads] // RANGE), pa.array(reduced(np.bitwise_or, masks).view(np.int64)), pa.array(reduced(np.maximum, tf), pa.int32()), pa.array(reduced(np.minimum, dl[doc]), pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[heads, len(key)], pa.int32()), hits)]
            edges = np.r_[np.arange(0, m, RANGE), m]
            ids, dls = (pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x) for x in (batch.column(0), pa.array(dl, pa.int32(), mask=~known)))
            sums = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), edges[:-1]))
            ranges = [none(parts, pa.string()), pa.array(at + np.arange(parts)), none(parts, pa.int64()), none(parts, pa.int32()), none(parts, pa.int32()), none(parts, pa.list_(pa.int64())), ids, dls, pa.array(np.diff(edges)), sums(known), sums(dl)]
            names = ["term", "range", "mask", "max_tf", "min_dl", "packed", "ids", "dls", "n", "known", "words"]
            yield pa.RecordBatch.from_arrays([*blocks, none(n, ids.type), none(n, dls.type), *[none(n, pa.int64())] * 3], names=names)
            yield pa.RecordBatch.from_arrays(ranges, names=names)
            at += parts

    return docs.select("id", _apart().alias("words")).mapInArrow(pack, _FIELDS.format(kind))


def _apart() -> Column:
    """A text's words with one blank between them: the runs that terms() finds, without an array of them."""
    return F.regexp_replace(F.lower("content"), T.WORD.replace("[", "[^", 1), " ")


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts of words with blanks between them: each word's text and the word, and the texts' numbers of words."""
    split = pc.split_pattern(texts, " ")
    flat, doc = split.flatten(), np.repeat(np.arange(len(texts)), split.value_lengths().fill_null(0).to_numpy())
    there = pc.not_equal(flat, "")
    doc = doc[there.to_numpy(zero_copy_only=False)]
    return doc, flat.filter(there), np.bincount(doc, minlength=len(texts)).astype(np.int64)


def _bucket(term: Column, buckets: int) -> Column:
    """Of a term; ranges are in bucket -1, masks of what is gone in -2."""
    return F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(buckets))).otherwise(-1).cast("int")


def _store(rows: DataFrame, path: str, buckets: int) -> None:
    placed = rows.withColumn("bucket", _bucket(F.col("term"), buckets)) if "bucket" not in rows.columns else rows
    placed.repartition("bucket", F.pmod("range", F.lit(4))).sortWithinPartitions("bucket", "term", "range").write.mode("append").partitionBy("bucket").parquet(path)


def _rows(spark: SparkSession, path: str, id_kind: str) -> DataFrame:
    """The stored rows, with the hits also as structs of slot, tf and dl."""
    rows = spark.read.schema(_FIELDS.format(id_kind) + ", bucket int").parquet(path)
    return rows.withColumn("hits", F.transform("packed", lambda h: F.struct(*_parts(h))))


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The index of docs (id, content) at a new path."""
    spark = docs.sparkSession
    with batches(spark):
        made = written(block_rows(docs), "index-rows")
    _store(made, path, buckets)
    return _rows(spark, path, docs.schema["id"].dataType.simpleString())


def append(docs: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """docs added to the index at path; of an id that is there already, the new document counts. buckets: as it was written with."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    old = _rows(spark, path, kind)
    with batches(spark):
        made = written(block_rows(docs), "index-rows")
    ranges = old.where("bucket = -1")
    after = (ranges.agg(F.max("range")).first()[0] or 0) + 1
    slots = _slots(old).join(docs.select("id").distinct(), "id", "left_semi")
    gone = slots.groupBy("range").agg(F.bit_or(_bit("slot")).alias("mask"))
    # before the new rows are there: what is gone of the old ones, and the lengths that go with it
    marks = written(gone.select(F.lit(None).cast("string").alias("term"), "range", "mask", *_nulls(kind), F.lit(-2).alias("bucket")), "index-gone")
    moved = made.withColumn("range", F.col("range") + after).withColumn("bucket", _bucket(F.col("term"), buckets))
    _store(moved.unionByName(marks), path, buckets)
    return _rows(spark, path, kind)


def _nulls(kind: str) -> list[Column]:
    typed = {"max_tf": "int", "min_dl": "int", "packed": HITS, "ids": f"array<{kind}>", "dls": "array<int>", "n": "long", "known": "long", "words": "long"}
    return [F.lit(None).cast(t).alias(name) for name, t in typed.items()]


def _gone(index: DataFrame) -> DataFrame:
    return index.where("bucket = -2").groupBy("range").agg(F.bit_or("mask").alias("gone"))


def _lives(mask: str | Column = "mask") -> Column:
    return (F.col(mask) if isinstance(mask, str) else mask).bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0).cast("long"))))


def _bit(slot: Column | str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(slot) if isinstance(slot, str) else slot).cast("int"))


def _slot(hit: Column) -> Column:
    return hit.bitwiseAND(F.lit(RANGE - 1).cast("long")).cast("int")


def _parts(hit: Column) -> list[Column]:
    tf, dl = F.shiftright(hit, _TF).bitwiseAND(F.lit(_29).cast("long")), F.shiftrightunsigned(hit, _DL)
    return [_slot(hit).cast("tinyint").alias("slot"), tf.cast("int").alias("tf"), dl.cast("int").alias("dl")]


def _live_hits() -> Column:
    return F.filter("packed", lambda h: _lives(_bit(_slot(h))) != 0)


def _slots(index: DataFrame) -> DataFrame:
    """id, range, slot of the documents that are there."""
    each = index.where("bucket = -1").join(_gone(index), "range", "left").select("range", "gone", F.posexplode("ids").alias("slot", "id"))
    return each.where(_lives(_bit("slot")) != 0).select("id", "range", "slot")


def _lost(index: DataFrame) -> DataFrame:
    """range, n, known, words of the documents that are gone."""
    each = index.where("bucket = -1").join(_gone(index), "range").select("range", "gone", F.posexplode("dls").alias("slot", "dl"))
    return each.where(_bit("slot").bitwiseAND(F.col("gone")) != 0).groupBy("range").agg(F.count("*").alias("_n"), F.count("dl").alias("_known"), F.sum("dl").alias("_words"))


def merge(spark: SparkSession, path: str, to: str, id_kind: str = "bigint", buckets: int = BUCKETS) -> DataFrame:
    """The index at path in one piece at another path: blocks of all increments beside each other by term and range, none of replaced documents."""
    index = _rows(spark, path, id_kind).drop("hits")
    met = index.where("bucket >= -1").join(_gone(index), "range", "left").join(_lost(index), "range", "left")
    for name in ("n", "known", "words"):
        met = met.withColumn(name, F.col(name) - F.coalesce(f"_{name}", F.lit(0)))
    met = met.withColumn("mask", _lives()).withColumn("packed", _live_hits())
    # the range rows keep their slots; their masks stay, without the lengths that are taken off here
    kept = met.where("term is null or mask <> 0").select(*index.columns)
    marks = index.where("bucket = -2").withColumn("n", F.lit(0).cast("long"))
    _store(kept.unionByName(marks), to, buckets)
    return _rows(spark, to, id_kind)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.inline(T.bm25_terms(F.col("query_text"))))


def gain(weight: Column, tf: Column, dl: Column, mean: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl.cast("double") / mean))


def _totals(index: DataFrame, stored: bool) -> tuple[int, float]:
    """Documents, and their mean length."""
    sums = ["n", "known", "words"]
    n, known, words = (x or 0 for x in index.where("bucket = -1" if stored else "term is null").agg(*[F.sum(x) for x in sums]).first())
    if stored and index.where("bucket = -2 and n is null").take(1):  # of merged ones the sums are free already
        marks = index.where("bucket = -1 or (bucket = -2 and n is null)")
        a, b, c = (x or 0 for x in _lost(marks).agg(*[F.sum(f"_{x}") for x in sums]).first())
        n, known, words = n - a, known - b, words - c
    return n, words / known if known and words else 1.0


def search(index: DataFrame, queries: DataFrame, most: int, first: int = FIRST, cells: int = 2 * _CELLS) -> DataFrame:
    """(query_id, id, score, rank, total_matches): the best `most` of an OR-search of each query. Scores are rounded to 4 decimals.

    index: of write_index or append, or written block_rows of the queries' terms.

    While the queries' weights by term are a table of at most so many cells, their terms' blocks are brought together by range, and the counts of a
    range's documents are multiplied by it; more queries read bounds first, and then the ranges that can matter.
    """
    stored = "bucket" in index.columns
    q = written(query_terms(queries), "index-terms")
    wanted = [r.term for r in q.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    blocks = index.where("term is not null")
    if stored and len(wanted) <= MOST_TERMS:
        blocks = blocks.where(F.col("bucket").isin([r.b for r in q.select(_bucket(F.col("term"), BUCKETS).alias("b")).distinct().collect()]))
    # a list reaches the scan while it is short
    blocks = blocks.where(F.col("term").isin(wanted)) if len(wanted) <= FEW else blocks.join(q.select("term").distinct(), "term", "left_semi")
    n, mean = _totals(index, stored)
    gone = _gone(index) if stored else None
    if rows := _asked(q, cells):
        ranges = index.where("bucket = -1" if stored else "term is null").select("range", "ids")
        ranges = ranges.join(gone, "range", "left") if stored else ranges.withColumn("gone", F.lit(None).cast("long"))
        return _answers(_regrouped(blocks.select("term", "range", "packed"), ranges, rows), q, rows, n, mean, most)
    alive = lambda df: df.join(gone, "range", "left").withColumn("mask", _lives()).where("mask <> 0") if stored else df.withColumn("gone", F.lit(0).cast("long"))
    heads = written(alive(blocks.select("term", "range", "mask", "max_tf", "min_dl")), "index-heads")
    df = heads.groupBy("term").agg(F.sum(F.bit_count("mask")).cast("double").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = written(q.join(df, "term").select("query_id", "term", (F.col("boost") * idf).alias("w")), "index-weights")
    bound = gain(F.col("w"), F.col("max_tf"), F.col("min_dl"), mean)
    ranges = heads.join(weights, "term").groupBy("query_id", "range").agg(F.bit_count(F.bit_or("mask")).cast("long").alias("matches"), F.sum(bound).alias("upper"))
    ranges = written(ranges, "index-ranges")
    totals = ranges.groupBy("query_id").agg(F.sum("matches").alias("total_matches"))
    ids = index.where("bucket = -1" if stored else "term is null").select("range", "ids")

    def scored(chosen: DataFrame) -> DataFrame:
        met = blocks.select("term", "range", "packed").join(weights, "term").join(chosen.select("query_id", "range"), ["query_id", "range"])
        if stored:
            met = met.join(gone, "range", "left")
            met = met.select("query_id", "range", "w", _live_hits().alias("packed"))
        each = met.select("query_id", "range", "w", F.explode("packed").alias("hit"))
        each = each.select("query_id", "range", "w", *_parts(F.col("hit")))
        fixed = F.floor(gain(F.col("w"), F.col("tf"), F.col("dl"), mean) * POINT + 0.5)
        sums = each.groupBy("query_id", "range", "slot").agg(F.round(F.sum(fixed) / POINT, 4).alias("score"))
        return sums.join(ids, "range").select("query_id", F.element_at("ids", F.col("slot").cast("int") + 1).alias("id"), "score")

    best = written(top_per_key(ranges, ["query_id"], first, F.desc("upper"), F.col("range")).select("query_id", "range"), "index-first")
    found = written(scored(best), "index-found")
    floor = top_per_key(found, ["query_id"], most, F.desc("score"), F.col("id")).where(F.col("rank") == most).select("query_id", F.col("score").alias("floor"))
    rest = ranges.join(best, ["query_id", "range"], "left_anti").join(floor, "query_id", "left").where("floor is null or upper + 0.001 >= floor")
    every = found.unionByName(scored(rest))
    return top_per_key(every, ["query_id"], most, F.desc("score"), F.col("id")).join(totals, "query_id")


_COUNTS = "id {}, dl int, codes array<int>, tfs array<int>"


def _counted(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, dl, codes, tfs) of each text: its words, and of the wanted ones the places in the list and the frequencies. Written."""
    def count(found):
        names, terms = ["id", "dl", "codes", "tfs"], pa.array(wanted, pa.string())
        for batch in found:
            m, texts = batch.num_rows, batch.column(1)
            if not m:
                continue
            doc, flat, dl = _words(texts)
            code = pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
            key, tf = np.unique((doc * len(wanted) + code)[code >= 0], return_counts=True)
            edges = pa.array(np.searchsorted(key, np.arange(m + 1) * len(wanted)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (key % len(wanted), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False)), *lists], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    with batches(docs.sparkSession):
        return written(docs.select("id", _apart().alias("words")).mapInArrow(count, _COUNTS.format(kind)), "index-counts")


def _scan(counts: DataFrame, weights: np.ndarray, asked: list, mean: float, most: int, kinds: tuple[str, str]) -> DataFrame:
    """(query_id, id, fixed, matches): of each task the documents that may be among a query's best, as sums of fixed points, and a row without id for
    its number of matches. weights: a row per term, a column per query.

    The product of the documents' gains and the weights says which documents can be among the best so far; these are summed up exactly. Of equal
    sums the smallest ids stay, and what is less than one rounding below the last of the best.
    """
    n_terms, n_queries = weights.shape
    rows = max(1, min(512, _CELLS // n_terms, _CELLS // n_queries))
    slack = int(1e-4 * POINT) + 2

    def best(q, fixed, ids):
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64)
        order = np.lexsort((place, -fixed, q))
        q, fixed, ids, at = q[order], fixed[order], ids.take(pa.array(order)), np.arange(len(order))
        since = lambda new: at - np.maximum.accumulate(np.where(new, at, 0))
        head = np.r_[True, q[1:] != q[:-1]][: len(q)]
        floor = np.full(n_queries, -1, np.int64)
        last = since(head) == most - 1
        floor[q[last]] = fixed[last]
        keep = (since(head | np.r_[True, fixed[1:] != fixed[:-1]][: len(q)]) < most) & (fixed >= floor[q] - slack)
        return q[keep], fixed[keep], ids.filter(pa.array(keep)), floor

    def score(found):
        wide, kind = np.ascontiguousarray(weights), None
        matches = np.zeros(n_queries, np.int64)
        floor, held, waiting = np.full(n_queries, -1, np.int64), [], 0
        for batch in found:
            kind = batch.schema.field(0).type
            ids, counts_of = batch.column(0), batch.column(2).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            codes, tfs = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            norm = K1 * (1 - B + B * batch.column(1).fill_null(0).to_numpy().astype(float) / mean)
            edges = np.r_[0, np.cumsum(counts_of)]
            for start in range(0, batch.num_rows, rows):
                end = min(start + rows, batch.num_rows)
                cut = slice(edges[start], edges[end])
                doc, code, tf = np.repeat(np.arange(end - start), counts_of[start:end]), codes[cut], tfs[cut].astype(float)
                gains = np.zeros((end - start, n_terms))
                gains[doc, code] = tf * (K1 + 1) / (tf + norm[start + doc])
                near = gains @ wide
                matches += (near > 0).sum(axis=0)
                least = floor / POINT
                if end - start > most:
                    least = np.maximum(least, np.partition(near, end - start - most, axis=0)[end - start - most])
                d, q = np.nonzero((near > 0) & (near >= least - 2e-4))
                for i in range(0, len(d), 10_000):
                    dd, qq = d[i : i + 10_000], q[i : i + 10_000]
                    size = counts_of[start + dd]
                    owner = np.repeat(np.arange(len(dd)), size)
                    spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[start + dd], size)
                    w, f = wide[codes[spot], qq[owner]], tfs[spot].astype(float)
                    points = np.floor(w * f * (K1 + 1) / (f + norm[start + dd[owner]]) * POINT + 0.5).astype(np.int64)
                    heads = np.cumsum(size) - size
                    held.append((qq, np.add.reduceat(points, heads), ids.take(pa.array(start + dd))))
                    waiting += len(dd)
                if waiting > n_queries * most:
                    *kept, floor = best(*_joined(held))
                    held, waiting = [kept], 0
        if kind is None:
            return
        queries = pa.array(asked)
        if held:
            q, fixed, ids, _ = best(*_joined(held))
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), ids, pa.array(fixed), pa.nulls(len(q), pa.int64())], names=["query_id", "id", "fixed", "matches"])
        yield pa.RecordBatch.from_arrays([queries, pa.nulls(n_queries, kind), pa.nulls(n_queries, pa.int64()), pa.array(matches)], names=["query_id", "id", "fixed", "matches"])

    with batches(counts.sparkSession):
        return written(counts.mapInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, fixed long, matches long"), "index-found")


def _joined(held: list) -> tuple:
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])


def search_texts(docs: DataFrame, queries: DataFrame, most: int, cells: int = 2 * _CELLS) -> DataFrame:
    """search() of texts without a stored index.

    While the queries' weights by term are a table of at most so many cells, the texts are gone through once, and their counts of the
    queries' terms are multiplied by it; of more queries, blocks are made of their terms.
    """
    q = written(query_terms(queries), "index-terms")
    rows = _asked(q, cells)
    if not rows:
        wanted = [r.term for r in q.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        with batches(docs.sparkSession):
            made = written(block_rows(docs.select("id", "content"), wanted if len(wanted) <= MOST_TERMS else None), "index-rows")
        return search(made, queries, most, cells=cells)
    counts = _counted(docs.select("id", "content"), sorted({r.term for r in rows}))
    n, known, words = (x or 0 for x in counts.agg(F.count("*"), F.count("dl"), F.sum("dl")).first())
    return _answers(counts, q, rows, n, words / known if known and words else 1.0, most)


def _asked(q: DataFrame, cells: int) -> list | None:
    """The queries' terms, where a table of terms by queries has at most so many cells."""
    rows = q.select("query_id", "term", "boost").limit(cells + 1).collect()
    return rows if len({r.term for r in rows}) * len({r.query_id for r in rows}) <= cells else None


def _regrouped(blocks: DataFrame, ranges: DataFrame, rows: list) -> DataFrame:
    """_counted from blocks: of the documents that have a wanted term. ranges: range, ids, gone."""
    wanted, kind = sorted({r.term for r in rows}), ranges.schema["ids"].dataType.elementType.simpleString()
    met = blocks.groupBy("range").agg(F.collect_list(F.struct("term", "packed")).alias("blocks")).join(ranges, "range")

    def turn(found):
        terms = pa.array(wanted, pa.string())
        for batch in found:
            listed, ids = batch.column(0), batch.column(1)
            each, gone = listed.flatten(), batch.column(2).fill_null(0).to_numpy()
            code = pc.index_in(pc.struct_field(each, "term"), value_set=terms).to_numpy().astype(np.int64)
            hits = pc.struct_field(each, "packed")
            size = hits.value_lengths().to_numpy()
            place, code = np.repeat(np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy()), size), np.repeat(code, size)
            hit = hits.flatten().to_numpy()
            there = (gone[place] >> (hit & RANGE - 1)) & 1 == 0
            place, code, hit = place[there], code[there], hit[there]
            doc = place * RANGE + (hit & RANGE - 1)
            order = np.lexsort((code, doc))
            doc, code, hit, place = doc[order], code[order], hit[order], place[order]
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
            edges = pa.array(np.r_[heads, len(doc)], pa.int32())
            sizes = ids.value_lengths().to_numpy().astype(np.int64)
            spot = (np.cumsum(sizes) - sizes)[place[heads]] + (hit[heads] & RANGE - 1)
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (code, hit >> _TF & _29)]
            yield pa.RecordBatch.from_arrays([ids.flatten().take(pa.array(spot)), pa.array(hit[heads] >> _DL & _29, pa.int32()), *lists], names=["id", "dl", "codes", "tfs"])

    with batches(blocks.sparkSession):
        return written(met.select("blocks", "ids", "gone").mapInArrow(turn, _COUNTS.format(kind)), "index-counts")


def _answers(counts: DataFrame, q: DataFrame, rows: list, n: int, mean: float, most: int) -> DataFrame:
    """The best of each query from _counted documents; n, mean: of all documents."""
    wanted, asked = sorted({r.term for r in rows}), list(dict.fromkeys(r.query_id for r in rows))
    df = dict(counts.select(F.explode("codes").alias("code")).groupBy("code").count().collect())
    at, place = {t: i for i, t in enumerate(wanted)}, {x: i for i, x in enumerate(asked)}
    weights = np.zeros((len(wanted), len(asked)))
    for r in rows:
        if f := df.get(at[r.term]):
            weights[at[r.term], place[r.query_id]] += r.boost * math.log(1 + (n - f + 0.5) / (f + 0.5))
    found = _scan(counts, weights, asked, mean, most, (q.schema["query_id"].dataType.simpleString(), counts.schema["id"].dataType.simpleString()))
    totals = found.where("fixed is null").groupBy("query_id").agg(F.sum("matches").alias("total_matches"))
    scored = found.where("fixed is not null").select("query_id", "id", F.round(F.col("fixed") / POINT, 4).alias("score"))
    return top_per_key(scored, ["query_id"], most, F.desc("score"), F.col("id")).join(totals, "query_id")


def _stored(spark, sf_dir):
    """The posts in two increments: those of odd ids, with a third of the others as they were before, then all of even ids."""
    posts, path = view(spark, sf_dir, "posts").select("id", "content"), new_path(spark, "index")
    before = posts.where("id % 2 = 0 and id % 3 = 0").withColumn("content", F.lit("an earlier text, entirely"))
    write_index(posts.where("id % 2 <> 0").unionByName(before), path)
    return append(posts.where("id % 2 = 0"), path)


@query("r1_stored_index", BM25_SQL + " SELECT query_id, id, score, rank, total_matches FROM bm WHERE rank <= 10")
def r1_stored(spark, sf_dir):
    return search(_stored(spark, sf_dir), view(spark, sf_dir, "queries"), 10)
