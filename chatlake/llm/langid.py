"""Language identification by inferring each document's mixture of languages.

Training counts, for every language, the 4-byte grams of its documents (ASCII lower-cased, hashed to BUCKETS). A document's
units are its words (in pieces of PIECE bytes where they are longer, so that scripts without spaces have units, too): a unit's
likelihood in a language is the product over the grams that start in it. Expectation maximisation estimates the proportions of the
languages until no proportion moves by more than TOLERANCE; it runs for growing sets of languages (the best, the best two, ...;
all whose next one has a share in the fit of all languages), and the set with the largest likelihood less (set size / 2) *
ln(units) is selected. The language with the largest proportion in it is the prediction and that proportion the score.

The model has a row per language and bucket at most (128 KB a language); it is what the driver holds, and its size does not
depend on the number of documents. Training uses every labelled row it is given. Defined cases: a null text, or one without a
letter, is `und` with score 0, as is every text when nothing is labelled; very long texts are read whole, in segments; of equally
likely languages the first in code-point order wins; repeated rows count as often as they occur; an empty table gives no rows;
extra columns are ignored, or pass through whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, gathered, id_remainder, slices, trimmed, written
from .textops import LOWER, U, chunks, words

BITS = 15
BUCKETS = 1 << BITS
#: EM ends when no proportion moves by more; ROUNDS only guards against a cycle of roundings.
TOLERANCE, ROUNDS = 2e-3, 1000
PIECE, SEGMENT = 16, 1_000_000
_PLAIN_LETTER = re.compile("[A-Za-z]")


def gram_ids(data: np.ndarray) -> np.ndarray:
    """The bucket of the 4 bytes from each position; beyond the end there are spaces."""
    low = np.r_[LOWER[data], np.full(3, 32, np.uint8)].astype(np.uint32)
    n = len(data)
    code = low[:n] << 24 | low[1 : n + 1] << 16 | low[2 : n + 2] << 8 | low[3 : n + 3]
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - BITS)).astype(np.int32)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, text) -> lang, bucket, n."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def emit():
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at, data, off in chunks(batch.column(1)):
                here = langs[at : at + len(off) - 1]
                ids = gram_ids(data)
                names, index = np.unique(here.astype(str), return_inverse=True)
                if len(names) * BUCKETS <= 4_000_000:
                    owner = np.repeat(index, np.diff(off))
                    both = np.bincount(owner * BUCKETS + ids, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                else:
                    both = [sum(np.bincount(ids[off[i] : off[i + 1]], minlength=BUCKETS) for i in np.flatnonzero(index == k)) for k in range(len(names))]
                for name, row in zip(names, both):
                    held[str(name)] = held[str(name)] + row if str(name) in held else np.asarray(row, np.int64)
            if len(held) > 200:
                yield from emit()
        yield from emit()

    parts = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and a (BUCKETS, languages) table of log probabilities."""
    rows = gathered(gram_counts(labelled.where("lang is not null and text is not null")))
    langs = sorted(set(rows["lang"].tolist()))
    table = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        own = rows["lang"] == lang
        table[rows["bucket"][own], k] = rows["n"][own]
    table += smooth
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _fit(ll: np.ndarray, heads: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM on each document's units; start holds 0 for the languages left out. -> proportions, log likelihood."""
    top = ll.max(axis=1)
    p = np.exp(ll - top[:, None])
    mix = start.copy()
    # documents that still move, with their units
    live, units, at, n = np.arange(len(heads)), p, heads, sizes
    for _ in range(ROUNDS):
        joint = units * np.repeat(mix[live], n, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(joint, at, axis=0) / n[:, None]
        moves = np.abs(new - mix[live]).max(axis=1) > TOLERANCE
        mix[live] = new
        if not moves.any():
            break
        if moves.mean() < 0.7:
            units, live, n = units[np.repeat(moves, n)], live[moves], n[moves]
            at = np.cumsum(n) - n
    like = np.log(np.maximum((p * np.repeat(mix, sizes, axis=0)).sum(axis=1), 1e-30)) + top
    return mix, np.add.reduceat(like, heads)


def units_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit's grams start, and its document: the byte before a word (if in the text), or a further piece of it."""
    starts, ends, doc = words(data, off)
    begin = np.maximum.accumulate(np.maximum(starts - 1, off[doc])) if len(starts) else starts
    extra = np.maximum(ends - starts - 1, 0) // PIECE
    if extra.any():
        own = np.repeat(np.arange(len(starts)), extra + 1)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(extra + 1) - (extra + 1), extra + 1)
        begin, doc = np.where(nth > 0, starts[own] + nth * PIECE, begin[own]), doc[own]
    return begin, doc


def likelihoods(data: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log likelihood of each unit in each language, over so many bytes at a time that a long text fits."""
    out = np.zeros((len(begin), table.shape[1]), np.float32)
    step = max(10_000, SEGMENT * 4 // max(1, table.shape[1]))
    edges = np.r_[begin, len(data)]
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + step, side="right")) - 1)
        a, b = edges[i], edges[j]
        ids = gram_ids(data[a : b + 3])[: b - a]
        out[i:j] = np.add.reduceat(table[ids], begin[i:j] - a, axis=0)
        i = j
    return out


def mixtures(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages for each text; zeros for one without words."""
    n, k = len(off) - 1, table.shape[1]
    out = np.zeros((n, k), np.float32)
    begin, doc = units_of(data, off)
    if not len(begin) or not k:
        return out
    ll = likelihoods(data, begin, table)
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.r_[heads, len(doc)])
    with_words = doc[heads]
    full, _ = _fit(ll, heads, sizes, np.full((len(heads), k), 1 / k, np.float32))
    alone = np.add.reduceat(ll.astype(float), heads, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros((len(heads), k), np.float32)
    chosen[np.arange(len(heads)), best] = 1
    value = alone.max(axis=1) - 0.5 * np.log(sizes)
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        # a further language can only pay if the full fit gives it a share
        some = np.flatnonzero(full[np.arange(len(heads)), order[:, size - 1]] > 0.01)
        if not len(some):
            break
        allowed = np.zeros((len(some), k), np.float32)
        np.put_along_axis(allowed, order[some, :size], 1 / size, axis=1)
        take = np.repeat(np.isin(np.arange(len(heads)), some), sizes)
        own_sizes = sizes[some]
        got, like = _fit(ll[take], np.r_[0, np.cumsum(own_sizes)[:-1]], own_sizes, allowed)
        penalised = like - 0.5 * size * np.log(own_sizes)
        better = penalised > value[some]
        chosen[some[better]] = got[better]
        value[some[better]] = penalised[better]
    out[with_words] = chosen
    return out


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and languages (the selected set's proportions), or lang_pred_1, ... where taken."""
    langs, table = model
    names = np.array([*langs, "und"], object)
    most = max(100_000, int(2_000_000 / max(1, len(langs))))
    own_text = text_col not in keep
    place = len(keep) if own_text else keep.index(text_col)
    made = [free_name(c, keep) for c in ("lang_pred", "score", "languages")]

    def predict(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(place)
            lettered = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            parts = [mixtures(data, off, table) for _, data, off in chunks(texts, most)]
            share = np.concatenate(parts) if parts else np.zeros((0, len(langs)), np.float32)
            best = share.argmax(axis=1) if len(langs) else np.zeros(len(share), int)
            score = share.max(axis=1) if len(langs) else np.zeros(len(share))
            known = lettered & (score > 0)
            sets = [[(langs[j], float(row[j])) for j in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(share, known)]
            columns = [pa.array(names[np.where(known, best, len(langs))], pa.string()), pa.array(np.where(known, np.minimum(score, 1), 0).astype(float)), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*batch.schema.names[: len(keep)], *made])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    columns = [F.col(f"`{c}`") for c in keep] + [F.col(text_col).alias(free_name("_text", keep))] * own_text
    return docs.select(*columns).mapInArrow(trimmed(predict), f"{kept}, {made[0]} string, {made[1]} double, {made[2]} map<string,double>")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", id_remainder("doc_id", 3) == 1)
    model = train(docs.where("not held_out"))
    return predicted(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def well_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents with a language: letters, and a main language of at least that share. Same columns as docs."""
    model = train(docs.where(id_remainder("doc_id", 3) != 1).select("lang", "text"))
    judged = predicted(docs, model, docs.columns)
    lang, score = (F.col(f"`{c}`") for c in judged.columns[len(docs.columns) :][:2])
    # where nothing is labelled, only texts without letters go
    ok = (lang != "und") & (score >= least) if model[0] else F.col("text").rlike(r"\p{L}")
    return judged.where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
