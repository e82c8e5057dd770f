"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane. Lanes 0 to 7 are 64 bits of BLAKE2b, summed modulo 2**64: equal multisets, and only those, have equal sums, in
any order. Lanes 8 to 135 are summed modulo 2**32: each word triple of the paragraph adds +1 or -1 to every lane by the bits
of its hash, so that the lanes' dot products estimate how many triples two documents share. Paragraphs are inserted or
deleted by adding or subtracting their vectors; `op7` makes the edited text's fingerprint so.

Defined cases: a null text is the empty text, a single empty paragraph; equal texts have equal fingerprints and likeness 1;
texts without words are like only their equals; null ids come after all others, in order of a hash of their text; rows with equal
ids follow each other by text; very long texts are hashed whole, in bounded parts; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices
from .textops import U, chained, chunks, mix, span_hashes, sums_per, words

EXACT, LANES, K = 8, 128, 3
#: Rows of a run of neighbours; beyond MOST_RUNS runs (whose cuts the driver holds) they grow, and are still streamed.
RUN, MOST_RUNS = 2000, 100_000


def _signs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of signs in each lane, for each text, and its number of triples (a shorter paragraph counts as one run)."""
    n = len(off) - 1
    starts, ends, doc = words(data, off)
    if not len(starts):
        return np.zeros((n, LANES), np.int64), np.zeros(n, np.int64)
    # the paragraph of a word: line feeds before it, and its text
    line = np.cumsum(data == 10)[starts] + doc
    h = span_hashes(data, starts, ends)
    runs = chained(h, K)
    full = line[: len(runs)] == line[K - 1 :] if len(runs) else np.zeros(0, bool)
    heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    sizes = np.diff(np.r_[heads, len(line)])
    short = heads[sizes < K]
    joined = h[short] + U(1)
    for j in range(1, K - 1):
        more = sizes[sizes < K] > j
        joined[more] = mix(joined[more] * U(5) + h[short[more] + j])
    grams, owner = np.concatenate([runs[full], mix(joined)]), np.concatenate([doc[: len(runs)][full], doc[short]])
    order = np.argsort(owner, kind="stable")
    grams, owner = grams[order], owner[order]
    total = np.zeros((n, LANES), np.int64)
    many = np.bincount(owner, minlength=n)
    for part in range(LANES // 64):
        h64 = mix(grams + U((part + 1) * 0xA24BAED4963EE407 % (1 << 64)))
        for i in range(0, len(h64), 65_536):
            bits = np.unpackbits(h64[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
            own = owner[i : i + 65_536]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[at], part * 64 : part * 64 + 64] += np.add.reduceat(bits, at, axis=0)
    return 2 * total - many[:, None], many


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints' exact lanes (uint64) and likeness lanes (uint32) of each text's paragraphs."""
    exact, soft = np.zeros((len(texts), EXACT), U), np.zeros((len(texts), LANES), np.uint32)
    for at, data, off in chunks(pa.array(texts, pa.large_string())):
        n = len(off) - 1
        soft[at : at + n] = _signs(data, off)[0].astype(np.uint32)
        for i in range(at, at + n):
            digests = b"".join([blake2b(p, digest_size=8 * EXACT).digest() for p in texts[i].encode("utf-8", "surrogatepass").split(b"\n")])
            exact[i] = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=U)
    return exact, soft


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """1 - |a - b|^2 / (|a|^2 + |b|^2) over the likeness lanes, in 0 to 1; 1 where the fingerprints are equal."""
    signed = lambda x: x.astype(np.int32).astype(np.float64)
    gap, norm = (signed(a - b) ** 2).sum(axis=1), (signed(a) ** 2).sum(axis=1) + (signed(b) ** 2).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        got = np.where(norm > 0, 1 - gap / norm, 0.0)
    return np.where(same, 1.0, np.clip(got, 0.0, 1.0))


def hexed(exact: np.ndarray, soft: np.ndarray) -> list[str]:
    return [a.astype("<u8").tobytes().hex() + b.astype("<u4").tobytes().hex() for a, b in zip(exact, soft)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row."""

    def make(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            made = hexed(*vectors([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def split_at_edit(text: str, follower: str) -> tuple[str, str, str]:
    """What stays as whole paragraphs, and the old and new text after it."""
    k = len(text) // 3
    cut = len(text) - k
    keep = text.rfind("\n", 0, cut) + 1
    return text[:keep], text[keep:], text[keep:cut] + follower[:k]


def compared(texts: list[str], followers: list[str]) -> dict[str, list]:
    parts = [split_at_edit(t, f) for t, f in zip(texts, followers)]
    exact, soft = vectors([*texts, followers[-1]])
    old, new = vectors([p[1] for p in parts]), vectors([p[2] for p in parts])
    exact_edited, soft_edited = exact[:-1] - old[0] + new[0], soft[:-1] - old[1] + new[1]
    # a run's next document is the row that follows; the last one's was hashed beside them
    exact_next, soft_next = exact[1:], soft[1:]
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [sha256((keep + fresh).encode("utf-8", "surrogatepass")).hexdigest() for keep, _, fresh in parts],
        "fingerprint": hexed(exact[:-1], soft[:-1]),
        "edited_fingerprint": hexed(exact_edited, soft_edited),
        "near_edited": likeness(soft[:-1], soft_edited, (exact[:-1] == exact_edited).all(axis=1)).tolist(),
        "near_next": likeness(soft[:-1], soft_next, (exact[:-1] == exact_next).all(axis=1)).tolist(),
    }


def passed(cuts: list[int], key):
    """How many of the ascending cuts are at most key: a binary search, as many steps as the number of cuts has bits."""
    if not cuts:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    found = F.lit(0)
    # the largest position whose cut is at most key; element p - 1 is the p-th cut
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    return F.coalesce(F.aggregate(steps, found, lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at)), F.lit(0))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row beside its edited text and the next row, in descending order of id, the first after the last.

    Rows go to runs of neighbouring ids; a run also gets the first row of the run after it, so that every pair of
    neighbours is in one task. One row per run is sent twice, and a few numbers per run pass through the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    totals = rows.agg(F.count("*").alias("n"), F.count("key").alias("keys")).first()
    if not totals.n:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    runs = max(1, min(MOST_RUNS, totals.keys // RUN))
    cuts = rows.where("key is not null").approxQuantile("key", [i / runs for i in range(1, runs)], 0.2 / runs) if runs > 1 else []
    cuts = sorted({int(c) for c in cuts})
    run = F.lit(len(cuts)) - passed(cuts, F.col("key"))
    tie = F.lit(0).cast("long")
    if totals.keys < totals.n:  # rows without id: runs of their own, equal ranges of their texts' hashes
        loose = max(1, min(MOST_RUNS, (totals.n - totals.keys) // RUN))
        tie = F.when(F.col("key").isNull(), F.xxhash64("text")).otherwise(0)
        share = (tie.cast("double") / 2.0**63 + 1.0) / 2.0
        run = F.when(F.col("key").isNull(), len(cuts) + 1 + F.least(F.floor(share * loose), F.lit(loose - 1))).otherwise(run)
    keyed = rows.select(run.cast("int").alias("run"), "key", tie.alias("tie"), "text")
    # a run's first row has its largest id, or without ids the smallest hash
    firsts = sorted((r.run, r.key, r.tie) for r in keyed.groupBy("run").agg(F.max("key").alias("key"), F.min("tie").alias("tie")).collect())
    heads = spark.createDataFrame([(*first, firsts[i - 1][0]) for i, first in enumerate(firsts)], "run int, key long, tie long, to_run int")
    head = heads.select(F.col("run").alias("h_run"), F.col("key").alias("h_key"), F.col("tie").alias("h_tie"), "to_run")
    # a row a run: at most 2 * MOST_RUNS of them
    met = keyed.join(F.broadcast(head), (F.col("run") == F.col("h_run")) & F.col("key").eqNullSafe(F.col("h_key")) & (F.col("tie") == F.col("h_tie")))
    guests = met.select(F.col("to_run").alias("run"), "key", "tie", "text", F.lit(1).alias("guest"))
    everyone = keyed.withColumn("guest", F.lit(0)).unionByName(guests)
    ordered = everyone.repartitionByRange(max(len(firsts), 1), "run").sortWithinPartitions("run", "guest", F.col("key").desc_nulls_last(), "tie", "text").select("run", "key", "text", "guest")

    def compare(batches):
        held, run_now = None, None  # the last row whose next one is still to come
        for batch in (part for whole in batches for part in slices(whole, 1)):
            table = batch.to_pydict()
            keys, texts, followers = [], [], []
            for run_id, key, text, guest in zip(table["run"], table["key"], table["text"], table["guest"]):
                text = text or ""
                if run_id != run_now:
                    held, run_now = None, run_id
                if held is not None:
                    keys.append(held[0])
                    texts.append(held[1])
                    followers.append(text)
                held = None if guest else (key, text)
            i, n_rows = 0, len(keys)
            while i < n_rows:  # neighbours follow each other within a run; a new run breaks the chain
                j = i + 1
                while j < n_rows and followers[j - 1] is texts[j]:
                    j += 1
                out = compared(texts[i:j], followers[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(out["n_chars"], pa.int64()), *[pa.array(out[c], pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[pa.array(out[c], pa.float64()) for c in ("near_edited", "near_next")]], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                i = j

    return ordered.mapInArrow(compare, schema.replace(f"id {kind}", "id long", 1)).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
