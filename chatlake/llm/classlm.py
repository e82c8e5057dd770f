"""Language-model scores from Brown class-based bigrams.

Training counts every token of the training documents (by 64-bit hash). The CLUSTERED most frequent words and the end of
a document are assigned to classes by the exchange algorithm: each word moves to the class that raises the likelihood of the
class bigrams most, until no word moves (each move raises it, so this ends). Every other training word then goes to the class of the largest gain, taken over its
neighbours' classes (other such words are one class there) as counted for the whole corpus; each pair counts by itself. The model's
probability of a token is

    P(class | class before) * (c + 0.1) / (N_class + 0.1 * V_class)

with additively smoothed transitions, counted over all training words' classes. Words that training has not are one word, a class
of its own, so that after every class the probabilities of all words sum to 1. There are
CLASSES classes, more (the fourth root) for a vocabulary beyond a million words. The KEPT most frequent words' counts and classes
travel to the tasks; those of all other words, without a bound, are joined to the documents' rare words by a shuffle. The driver
sees at most (CLUSTERED + 2)^2 numbers and the KEPT words.

Defined cases: a null text is one end token; very long texts are scored whole, in one row; words of equal count are ordered by
their hash; rows with equal ids are scored each by itself; without training rows all words
are unknown and c = 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, id_remainder, written
from .textops import LOWER, U, chunks, counts_per, span_hashes, words

END = np.uint64(0x656E64)
CLUSTERED, CLASSES, KEPT, ALPHA = 2000, 32, 100_000, 0.1


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the words, with an end token after each document."""
    low = LOWER[data]
    starts, ends, doc = words(low, off)
    n = len(off) - 1
    sizes = counts_per(doc, n)
    # where a document's words stand among all tokens
    at = np.arange(len(doc)) + doc
    h = np.full(len(doc) + n, END, U)
    h[at] = span_hashes(low, starts, ends)
    return h, np.repeat(np.arange(n), sizes + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def token_counts(texts: DataFrame, most: int = 1_500_000) -> DataFrame:
    """(text) -> h, c for every distinct token; tasks add up their own counts first."""

    def count(batches):
        held, size = [], 0

        def emit():
            keys, n = _merge(held)
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], names=["h", "n"])

        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                held.append(np.unique(tokens(data, off)[0], return_counts=True))
                size += len(held[-1][0])
                if size > most:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from emit()
                        held, size = [], 0
        if held:
            yield from emit()

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most `most` tokens: all with a count above a limit read off a histogram."""
    level = F.floor(F.log2(F.col("c")) * 16).cast("int")
    bands = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, limit = 0, None
    for row in bands:
        total += row["count"]
        if total > most:
            break
        limit = row["level"]
    if limit is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    got = gathered(counts.where(level >= limit).select("h", "c"))
    order = np.lexsort((got["h"], -got["c"]))
    return got["h"][order].view(U), got["c"][order]


def word_bigrams(texts: DataFrame, clustered: np.ndarray) -> np.ndarray:
    """How often each clustered word (the rest is one more) follows another; each text starts after an end."""
    w = len(clustered) + 1
    order = np.argsort(clustered)
    ranked, end = clustered[order], int(np.flatnonzero(clustered == END)[0])

    def count(batches):
        total = np.zeros(w * w, np.int64)
        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                now = looked_up(ranked, order, tokens(data, off)[0], w - 1)
                total += np.bincount(np.r_[end, now[:-1]] * w + now, minlength=w * w)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    rows = gathered(texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    out = np.zeros(w * w)
    out[rows["pair"]] = rows["n"]
    return out.reshape(w, w)


def looked_up(ranked: np.ndarray, order: np.ndarray, h: np.ndarray, otherwise: int) -> np.ndarray:
    if not len(ranked):
        return np.full(len(h), otherwise, np.int64)
    at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
    return np.where(ranked[at] == h, order[at], otherwise)


def exchange(bigrams: np.ndarray, classes: int, fixed: int = 1) -> np.ndarray:
    """Class of each word. Words come in order of frequency; the last `fixed` are classes of their own.

    The likelihood of class bigrams is sum h(n(c, d)) - 2 sum h(n(c)) + constant, with h(x) = x ln x. One word at a time is
    taken out of its class and put where that sum gains most.
    """
    w = len(bigrams)
    free = w - fixed
    classes = max(1, min(classes, free))
    of = np.r_[np.arange(free) % classes, classes + np.arange(fixed)]
    k = classes + fixed
    member = np.zeros((w, k))
    member[np.arange(w), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # word -> class after it, class before it
    g = member.T @ right
    uni = bigrams.sum(axis=1)
    n = member.T @ uni
    xlx = lambda x: x * np.log(np.maximum(x, 1e-12))
    moved, least = 1, 1e-12 * max(1.0, float(xlx(uni.sum())))  # gains below roundings are none
    while moved:
        moved = 0
        for v in range(free):
            c, r, l, s = of[v], right[v].copy(), left[v].copy(), bigrams[v, v]
            r[c] -= s
            l[c] -= s  # without the word itself
            g[c, :] -= r
            g[:, c] -= l
            g[c, c] -= s
            n[c] -= uni[v]
            hg = xlx(g)
            gain = (xlx(g + r[None, :]) - hg).sum(axis=1) + (xlx(g + l[:, None]) - hg).sum(axis=0)
            d = np.arange(k)
            own = g[d, d]
            gain += xlx(own + r + l + s) - xlx(own + r) - xlx(own + l) + xlx(own)
            gain -= 2 * (xlx(n + uni[v]) - xlx(n))
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[c] + least:
                best = c
            g[best, :] += r
            g[:, best] += l
            g[best, best] += s
            n[best] += uni[v]
            if best != c:
                moved += 1
                of[v] = best
                right[:, c] -= bigrams[:, v]
                right[:, best] += bigrams[:, v]
                left[:, c] -= bigrams[v, :]
                left[:, best] += bigrams[v, :]
    return of


def class_model(pairs: np.ndarray, count: np.ndarray, words_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 transitions (class before, class), and log10 of each class's emission denominator.

    pairs: counts of neighbouring classes; count and words_in: each class's tokens and words. The last class is the unknown word's.
    """
    moves = np.log10((pairs + ALPHA) / (pairs.sum(axis=1, keepdims=True) + ALPHA * len(pairs)))
    words_in = words_in.astype(float)
    words_in[-1] += 1
    return moves, np.log10(np.maximum(count + ALPHA * words_in, ALPHA))


def tail_classes(texts: DataFrame, head: np.ndarray, of: np.ndarray, bigrams: np.ndarray) -> DataFrame:
    """h, c, cls of every word outside the head, by the gain of its pairs with its neighbours' classes."""
    rest, order = int(of.max()), np.argsort(head)
    k, ranked = rest + 1, head[order]
    member = np.zeros((len(of), k))
    member[np.arange(len(of)), of] = 1
    g = member.T @ bigrams @ member
    # a pair's count, by the class before (first k rows) or after (last k) and the word's class
    pair, size = np.r_[g[:, :rest], g[:rest].T], bigrams.sum(axis=1) @ member[:, :rest]
    xlx = lambda x: x * np.log(np.maximum(x, 1e-12))
    end_class = int(of[np.flatnonzero(head == END)[0]])

    def contexts(batches):
        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                h, _ = tokens(data, off)
                cls = of[looked_up(ranked, order, h, len(head))]
                at = np.flatnonzero(cls == rest)
                if not len(at):
                    continue
                own, index = np.unique(h[at], return_inverse=True)
                # an end follows every word, so the next token is of the same text
                both = np.r_[index * 2 * k + np.r_[end_class, cls[:-1]][at], index * 2 * k + k + cls[at + 1]]
                keys, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own[keys // (2 * k)].view(np.int64)), pa.array(keys % (2 * k)), pa.array(n)], names=["h", "slot", "n"])

    def assign(batches):
        for batch in batches:
            codes, many = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            if not len(many):
                continue
            heads = np.cumsum(many) - many
            slot, n = codes >> 40, codes & ((1 << 40) - 1)
            gain = np.add.reduceat(xlx(pair[slot] + n[:, None]) - xlx(pair)[slot], heads, axis=0)
            c = np.add.reduceat(np.where(slot < k, n, 0), heads)
            gain -= 2 * (xlx(size + c[:, None]) - xlx(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c), pa.array(gain.argmax(axis=1).astype(np.int64))], names=["h", "c", "cls"])

    counted = texts.mapInArrow(contexts, "h long, slot long, n long").groupBy("h", "slot").agg(F.sum("n").alias("n"))
    return counted.groupBy("h").agg(F.collect_list(F.shiftleft("slot", 40).bitwiseOR(F.col("n"))).alias("codes")).mapInArrow(assign, "h long, c long, cls long")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 10, clustered: int = CLUSTERED, classes: int = CLASSES, kept: int = KEPT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (id_remainder(id_col, held_out) == 0).alias("held_out"))
    training = rows.where("not held_out").select("text")
    counts = written(token_counts(training), "lm-counts")
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top, top_counts = frequent(counts, kept)
    if len(top) < min(clustered, stats.v):  # a band of equal counts passes `kept`
        got = gathered(counts.orderBy(F.desc("c"), "h").limit(clustered).select("h", "c"))
        top, top_counts = got["h"].view(U), got["c"]
    if not (top == END).any():  # no training rows, or more tokens than `kept` as frequent as the end
        n_end = counts.where(F.col("h") == int(END.view(np.int64))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        top, top_counts = np.r_[top, END], np.r_[top_counts, n_end]
    chosen = np.unique(np.r_[np.arange(min(clustered, len(top))), np.flatnonzero(top == END)])
    words_, word_counts = top[chosen], top_counts[chosen]
    bigrams = word_bigrams(training, words_)
    of = exchange(bigrams, max(classes, int(stats.v**0.25)))
    tail = written(tail_classes(training, words_, of, bigrams), "lm-tail")
    rest, end_class = int(of.max()), int(of[np.flatnonzero(words_ == END)[0]])
    k = rest + 1
    by_hash = np.argsort(top)
    ranked, logs, known = top[by_hash], np.log10(top_counts[by_hash] + ALPHA), top_counts[by_hash] > 0
    class_of = np.full(len(top), rest)
    class_of[chosen] = of[:-1]
    class_of = class_of[by_hash]
    near = tail.where(F.col("c") >= int(top_counts[top != END].min() if (top != END).any() else 1 << 62))
    if len(top) > len(words_):
        got = near.join(spark.createDataFrame([(int(x),) for x in top.view(np.int64)], "h long"), "h", "left_semi").select("h", "cls")
        got = gathered(got)
        class_of[np.searchsorted(ranked, got["h"].view(U))] = got["cls"]
    everyone = np.arange(len(top))

    def place_words(batches):
        row = TaskContext.get().partitionId() << 34
        for batch in batches:
            held = np.array(batch.column(2).to_pylist(), bool)
            for at, data, off in chunks(batch.column(1)):
                n = len(off) - 1
                h, doc = tokens(data, off)
                place = looked_up(ranked, everyone, h, -1)
                found = place >= 0
                cls = np.where(found, class_of[place], rest).astype(np.int32)
                ids, uid = batch.column(0).slice(at, n), np.arange(row, row + n)
                row += n
                sizes = counts_per(doc, n)
                starts = np.cumsum(sizes) - sizes
                n_known = np.bincount(doc[found], known[place[found]], n).astype(np.int64)
                none = lambda kind, size: pa.nulls(size, kind)
                lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(uid), none(pa.int64(), n), none(pa.list_(pa.int32()), n), ids, pa.array(held[at : at + n]), pa.array(sizes), pa.array(n_known), pa.array(np.bincount(doc[~found], minlength=n)), pa.array(np.bincount(doc, np.where(found, logs[place], 0.0), n)), lists(cls, np.r_[starts, len(cls)])], names=names)
                # rare words, once per document with their places
                rare = np.flatnonzero(~found)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                heads = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(order) else order
                m = len(heads)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(uid[doc[order][heads]]), pa.array(h[order][heads].view(np.int64)), lists(order - starts[doc[order]], np.r_[heads, len(order)]), none(ids.type, m), none(pa.bool_(), m), *[none(t, m) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()))]], names=names)

    names = ["uid", "h", "at", "id", "held_out", "n_tokens", "n_known", "n_rare", "logs", "cls"]
    kind = docs.schema[id_col].dataType.simpleString()
    both = written(rows.mapInArrow(place_words, f"uid long, h long, at array<int>, id {kind}, held_out boolean, n_tokens long, n_known long, n_rare long, logs double, cls array<int>"), "lm-rows")
    joined = both.where("h is not null").select("uid", "h", "at").join(tail, "h").withColumn("n", F.size("at"))
    rare = joined.groupBy("uid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + ALPHA)).alias("rare_logs"), F.flatten(F.collect_list(F.expr("transform(at, p -> shiftleft(cls, 32) | p)"))).alias("codes"))
    named = both.where("h is null").drop("h", "at").join(rare, "uid", "left")
    rare_known = F.coalesce("rare_known", F.lit(0))
    logs_ = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + (F.col("n_rare") - rare_known) * math.log10(ALPHA)

    def fill(batches):
        for batch in batches:
            cls, codes = batch.column(5), batch.column(6)
            flat, many = cls.flatten().to_numpy().copy(), cls.value_lengths().to_numpy()
            starts, own = np.cumsum(many) - many, codes.value_lengths().fill_null(0).to_numpy()
            code = codes.flatten().to_numpy()
            flat[np.repeat(starts, own) + (code & 0xFFFFFFFF)] = code >> 32
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(np.r_[starts, len(flat)].astype(np.int32)), pa.array(flat))], names=[*batch.schema.names[:5], "cls"])

    filled = named.select("id", "held_out", "n_tokens", (F.col("n_known") + rare_known).alias("n_known"), logs_.alias("logs"), "cls", "codes")
    sequences = written(filled.mapInArrow(fill, f"id {kind}, held_out boolean, n_tokens long, n_known long, logs double, cls array<int>"), "lm-sequences")

    def transitions(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            c = batch.column(0).flatten().to_numpy().astype(np.int64)
            if len(c):
                total += np.bincount(np.r_[end_class, c[:-1]] * k + c, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = gathered(sequences.where("not held_out").select("cls").mapInArrow(transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    g = np.zeros(k * k)
    g[got["pair"]] = got["n"]
    n_class, v_class = np.bincount(of[:-1], word_counts, k), np.bincount(of[:-1], minlength=k).astype(float)
    for r in tail.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        n_class[r.cls] += r.c
        v_class[r.cls] += r.v
    moves, emitted = class_model(g.reshape(k, k), n_class, v_class)
    moves = moves.ravel()

    def score(batches):
        for batch in batches:
            c, many = batch.column(5).flatten().to_numpy().astype(np.int64), batch.column(5).value_lengths().to_numpy()
            if not len(many):
                continue
            steps = moves[np.r_[end_class, c[:-1]] * k + c] - emitted[c]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.add.reduceat(steps, np.cumsum(many) - many))], names=[*batch.schema.names[:5], "steps"])

    out = sequences.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, logs double, steps double")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(stats.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(stats.n + ALPHA * (stats.v + 1))).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("logs") + F.col("steps")) / F.col("n_tokens")).alias("perplexity"),
    )


def op10_class_lm(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
