"""Alignment of two tokenizers' tokens by the bytes that they cover, and counts of the token pairs that end together.

A document's tokens of A (byte-level BPE) and of B (SentencePiece) cover the same bytes, those of a space and the text. Two sorted lists
of ends are merged: where both end is a link of the two tokens and a cut between groups. The merge is done for all documents of a batch in
lockstep: one NumPy state vector holds the pointers into A and B, a step compares the ends at all of them, emits links and cuts where
they are equal, and advances the pointers of the smaller ones, or both; what has come to its end is compacted away. Long
documents are lanes of LANE tokens of A each, which begin at a byte and not at a link, so that no step waits for one document.

How often a pair is linked is counted over all documents. The KEPT most frequent pairs' counts travel to the tasks, documents' links of
other pairs are joined with theirs by a shuffle; what a document needs of them is kept from the first pass, which alone tokenises.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from them (say by the space mark of B in the text), have no
tokens: zeros and no groups; null, equal and repeated ids are rows like others; very long texts are aligned whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK
from .shared import batches, gathered, slices, store, trimmed, written
from .tokenfiles import _OTHER_SPACE, WordCachedEncoder, load_tokenizer

#: Tokens of A in a lane; bytes of text that a task aligns at once (MB); pairs whose counts travel to tasks.
LANE, SLICE_MB, KEPT = 512, 0.5, 100_000
_SHIFT = 32


def byte_of_char() -> dict[str, int]:
    """What byte-level BPE files write for a byte: printable Latin-1 characters stand for themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update((chr(0x100 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return out


class SpacedEncoder(WordCachedEncoder):
    """Of texts that begin with a space of their own: the first word is like any other."""

    def cuts(self, text: str) -> list[str]:
        rest = super().cuts(text[1:]) if text[1:] and text[1] not in " \n" else None
        # where the text falls at every space, its first word is a cut as well
        return super().cuts(text) if rest is None or _OTHER_SPACE.search(text[1]) else ["", *rest]


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        tokenizer = load_tokenizer(path_a)
        self.a, self.b = SpacedEncoder(tokenizer, 300_000), sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_of_char()
        entries = json.loads(tokenizer.to_str())["model"]["vocab"]
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        sp = self.b
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        wide = max(len(self.bytes_a), len(self.bytes_b))
        self.said = np.array([f"{i}{mark}" for mark in ",|;" for i in range(wide)], object)
        self.wide = wide

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text; none where their bytes are not those of a space and the text."""
        whole = [" " + t for t in texts]
        ids_a = [np.frombuffer(x, "<u4").tolist() for x in self.a.encode(whole)]
        ids_b = self.b.encode(texts, num_threads=1)
        for i, t in enumerate(whole):
            want = t.encode()
            if not texts[i] or b"".join(map(self.bytes_a.__getitem__, ids_a[i])) != want or b"".join(map(self.bytes_b.__getitem__, ids_b[i])) != want:
                ids_a[i] = ids_b[i] = []
        return [np.array(x, np.int64) for x in ids_a], [np.array(x, np.int64) for x in ids_b]


@store
def aligner_for(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, to_a: np.ndarray, at_b: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and B whose ends are equal, over all lanes: lane k has A from at_a[k] to to_a[k], B from at_b[k] to to_b[k]."""
    live = (at_a < to_a) & (at_b < to_b)
    i, j, last_i, last_j = at_a[live], at_b[live], to_a[live], to_b[live]
    found_a, found_b = [i[:0]], [j[:0]]
    while len(i):
        one, two = ends_a[i], ends_b[j]
        equal = one == two
        found_a.append(i[equal])
        found_b.append(j[equal])
        i, j = i + (one <= two), j + (two <= one)
        live = (i < last_i) & (j < last_j)
        if not live.all():
            i, j, last_i, last_j = i[live], j[live], last_i[live], last_j[live]
    return np.concatenate(found_a), np.concatenate(found_b)


def links(lengths_a: np.ndarray, lengths_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(positions in A, in B) of the tokens that end together, in order. lengths: of all documents' tokens on end; docs: where each begins, and the last ends."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    # lanes: LANE tokens of A of a document, and of B what ends after the lane before and not after this one
    n = np.diff(docs_a)
    lanes = -(-n // lane)
    doc = np.repeat(np.arange(len(n)), lanes)
    at_a = docs_a[:-1][doc] + lane * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    to_a = np.minimum(at_a + lane, docs_a[1:][doc])
    before = np.where(at_a > 0, ends_a[at_a - 1], 0) if len(at_a) else at_a
    at_b = np.searchsorted(ends_b, before, side="right")
    to_b = np.searchsorted(ends_b, ends_a[to_a - 1], side="right") if len(to_a) else to_a
    a, b = lockstep(ends_a, ends_b, at_a, to_a, at_b, to_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """uid, id, n_a, n_b, n_groups, groups_sha256, pairs and times (distinct linked pairs, id of A * 2^32 + id of B, and how often), and on
    request groups (of a_ids, b_ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    group = pa.list_(pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]))

    def make(found):
        aligner, uid = aligner_for(path_a, path_b), TaskContext.get().partitionId() << 34
        for batch in found:
            for part in slices(batch, SLICE_MB):
                ids_a, ids_b = aligner.tokens([t or "" for t in part.column(1).to_pylist()])
                docs_a, docs_b = (np.r_[0, np.cumsum([len(x) for x in ids])] for ids in (ids_a, ids_b))
                all_a, all_b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (ids_a, ids_b))
                a, b = links(aligner.length_a[all_a], aligner.length_b[all_b], docs_a, docs_b)
                bounds = np.searchsorted(a, docs_a)  # a document's links
                code = (all_a[a] << _SHIFT) | all_b[b]
                # decimals in order: a token of A after the tokens of B of the groups before its own, one of B after A's up to its own
                said = np.empty(len(all_a) + len(all_b), np.int64)
                group_a, group_b = np.searchsorted(a, np.arange(len(all_a))), np.searchsorted(b, np.arange(len(all_b)))
                mark_a, mark_b = np.zeros(len(all_a), np.int64), np.zeros(len(all_b), np.int64)
                mark_a[a], mark_b[b] = 1, 2
                said[np.arange(len(all_a)) + np.r_[0, b + 1][group_a]] = all_a + aligner.wide * mark_a
                said[np.arange(len(all_b)) + (a + 1)[group_b]] = all_b + aligner.wide * mark_b
                rows = []
                for k in range(part.num_rows):
                    pairs, times = np.unique(code[bounds[k] : bounds[k + 1]], return_counts=True)
                    text = "".join(aligner.said[said[docs_a[k] + docs_b[k] : docs_a[k + 1] + docs_b[k + 1]]].tolist())[:-1]
                    rows.append((len(ids_a[k]), len(ids_b[k]), int(bounds[k + 1] - bounds[k]), sha256(text.encode()).hexdigest() if text else "", pairs, times))
                columns = list(zip(*rows))
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())))]
                if with_groups:
                    cuts = [[{"a_ids": all_a[x:y], "b_ids": all_b[v:w]} for x, y, v, w in zip(np.r_[docs_a[k], a[s:e] + 1], a[s:e] + 1, np.r_[docs_b[k], b[s:e] + 1], b[s:e] + 1)] for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]
                    made.append(pa.array(cuts, group))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + part.num_rows)), part.column(0), *made], names=["uid", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", *["groups"] * with_groups])
                uid += part.num_rows

    schema = f"uid long, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    schema += ", groups array<struct<a_ids: array<int>, b_ids: array<int>>>" * with_groups
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(make, aligner_for), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links of it in all documents), best (n is its B id's highest)."""

    def add_up(found):
        for batch in found:
            pairs, where = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(where, batch.column(1).flatten().to_numpy(), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    counts = written(rows.select("pairs", "times").mapInArrow(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))  # a row for each id of B at most
    return written(counts.join(F.broadcast(highest), of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "align-best")


def tallied(rows: DataFrame, counts: DataFrame, kept: int = KEPT) -> DataFrame:
    """uid, n_best, count_sum of each row of aligned(); counts: of pair_counts()."""
    known = gathered(counts.orderBy(F.desc("n"), "pair").limit(kept))
    order = np.argsort(known["pair"])
    pair, n, best = known["pair"][order], known["n"][order], known["best"][order].astype(bool)
    known = rows.sparkSession.sparkContext.broadcast((pair, n, best))

    def tally(found):
        pair, n, best = known.value
        for batch in found:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy().astype(np.int64)
            values, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(off))
            at = np.minimum(np.searchsorted(pair, values), max(0, len(pair) - 1))
            has = pair[at] == values if len(pair) else np.zeros(len(values), bool)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, doc[has], np.where(best[at[has]], times[has], 0))
            np.add.at(total, doc[has], times[has] * n[at[has]])
            rest = np.r_[0, np.cumsum(np.bincount(doc[~has], minlength=batch.num_rows))]
            others = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x)) for x in (values[~has], times[~has])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total), *others], names=["uid", "n_best", "count_sum", "rest", "times"])

    first = written(rows.select("uid", "pairs", "times").mapInArrow(tally, "uid long, n_best long, count_sum long, rest array<long>, times array<long>"), "align-tally")
    rest = first.where(F.size("rest") > 0).select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("pair"), "x.times")
    met = rest.join(counts, "pair").select("uid", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return first.select("uid", "n_best", "count_sum").unionByName(met).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """A row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(aligned(docs, path_a, path_b, id_col, text_col), "align-rows")
    with batches(docs.sparkSession):
        sums = written(tallied(rows, pair_counts(rows), kept), "align-sums")
    return rows.join(sums, "uid").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op13_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return aligned_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
