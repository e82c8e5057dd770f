"""Quality rules at host level.

Each text is measured and held against base rules and soft rules (symbols a word, repeated lines, mean word length). Failures
are counted by host, each host's failure rate is shrunk towards all hosts' by a beta prior fitted to the hosts' rates (method of
moments, weighted by documents), and the verdict on the host is joined back to its documents:

- rejected, if most of its documents fail beyond doubt (the shrunk rate less SURE standard deviations of its posterior is above
  HOST_LIMIT): all its documents go;
- trusted, if its shrunk rate is below TRUST times the rate over all documents: its soft failures are forgiven;
- otherwise a soft failure counts like a base failure.

A document that fails a base rule always goes. Word triples and lines are compared by 64-bit hashes. Defined cases: a null text
has no words and fails; a null host is a host of its own; very long texts are measured whole, in bounded batches; repeated rows
count as often as they occur, ties do not arise; an empty table gives no rows; extra columns are ignored, or pass through
`good_documents` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, trimmed, written
from .textops import U, chained, chunks, code_points, counts_per, mix, span_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
HOST_LIMIT, SURE, TRUST = 0.5, 2.0, 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measured beside these, for the soft rules.
ALL = (*MEASURES, "n_lines")


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for each entry whose (owner, hash) occurs elsewhere, too."""
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ALL for each text."""
    n = len(off) - 1
    starts, ends, doc = words(data, off)
    points = np.r_[0, np.cumsum(code_points(data))]
    out = np.zeros((n, len(ALL)), np.int64)
    out[:, 0] = counts_per(doc, n)
    out[:, 1] = np.bincount(doc, points[ends] - points[starts], n)
    symbols = np.r_[0, np.cumsum(SYMBOLS[data])]
    out[:, 2] = symbols[off[1:]] - symbols[off[:-1]]
    if not len(starts):
        return out
    # lines: from a text's start or after a line feed; those with a word, hashed whole
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.r_[off[:-1][off[:-1] < len(data)], breaks + 1])
    line_starts = line_starts[line_starts < len(data)]
    text_ends = off[1:][np.searchsorted(off[1:], line_starts, side="right")]
    line_ends = np.minimum(text_ends, np.r_[breaks, len(data)][np.searchsorted(breaks, line_starts)])
    has_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(off, line_starts, side="right") - 1
    lines = mix(span_hashes(data, line_starts, line_ends) + line_doc.astype(U) * U(0xC2B2AE3D27D4EB4F))
    distinct_doc = line_doc[np.unique(lines, return_index=True)[1]]
    out[:, 5] = counts_per(line_doc, n)
    out[:, 3] = out[:, 5] - counts_per(distinct_doc, n)
    h = span_hashes(data, starts, ends)
    runs = chained(h, 3)
    if len(runs):
        inside = doc[: len(runs)] == doc[2:]
        at = np.flatnonzero(inside)
        twice = at[_repeated(runs[at], doc[at])]
        covered = np.zeros(len(h), bool)
        for j in range(3):
            covered[twice + j] = True
        out[:, 4] = np.bincount(doc[covered], minlength=n)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", whole: bool = False) -> DataFrame:
    """id, host, the measures, base_failed and soft_failed of each row; with `whole`, the columns of docs (c0, c1, ...) for the id."""
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if whole else [F.col(id_col).alias("id")]
    rows = docs.select(*kept, F.col(host_col).cast("string").alias("host"), *[] if whole else [F.col(text_col).alias("measured_text")])
    place = docs.columns.index(text_col) if whole else 2
    n = len(kept) + 1

    def measure(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            made = [measures(data, off) for _, data, off in chunks(batch.column(place))]
            all_rows = np.concatenate(made) if made else np.zeros((0, len(ALL)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(all_rows[:, i]) for i in range(len(ALL))]], names=[*batch.schema.names[:n], *ALL])

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:n]]
    out = rows.mapInArrow(trimmed(measure), ", ".join([*fields, *[f"{m} long" for m in ALL]]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("n_words")) | (3 * F.col("n_dup_lines") > F.col("n_lines")) | (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 40 * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("soft_failed", soft)
    return out if whole else out.withColumnRenamed("id", id_col)


def host_key(host: str = "host"):
    """A key that tells a null host from any name."""
    return F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT, trust: float = TRUST) -> DataFrame:
    """host_key, host_docs, host_failures, host_rate (shrunk), host_rejected, host_trusted; one row per host."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = written(rows.groupBy(host_key().alias("host_key")).agg(F.count("*").alias("host_docs"), F.sum(failed).alias("host_failures")), "quality-counts")
    rate = F.col("host_failures") / F.col("host_docs")
    t = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failures").alias("f"), F.count("*").alias("hosts"), F.sum(F.col("host_failures") * rate).alias("f2")).first()
    if not t.n:
        return hosts.select("*", F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_rejected"), F.lit(False).alias("host_trusted"))
    # mean and variance of the rates, weighted by documents; the variance less what chance alone gives
    mean = t.f / t.n
    between = max(t.f2 / t.n - mean * mean - mean * (1 - mean) * t.hosts / t.n, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    shrunk = (F.col("host_failures") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    spread = F.sqrt(shrunk * (1 - shrunk) / (F.col("host_docs") + F.lit(strength + 1)))
    return hosts.select("*", shrunk.alias("host_rate"), (shrunk - SURE * spread > limit).alias("host_rejected"), (shrunk < trust * mean).alias("host_trusted"))


def with_verdicts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows of `measured` with host_rate and kept; hosts: of `host_verdicts`."""
    judged = rows.withColumn("host_key", host_key()).join(hosts, "host_key", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & (~F.col("soft_failed") | F.col("host_trusted")))


def judged_quality(docs: DataFrame, limit: float = HOST_LIMIT, trust: float = TRUST, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, host, ALL, base_failed, soft_failed, host_rate, kept."""
    rows = written(measured(docs, id_col, host_col, text_col), "quality-rows")
    hosts = written(host_verdicts(rows, limit, trust), "quality-hosts")
    return with_verdicts(rows, hosts).select(id_col, "host", *ALL, "base_failed", "soft_failed", "host_rate", "kept")


def good_documents(docs: DataFrame, limit: float = HOST_LIMIT, trust: float = TRUST) -> DataFrame:
    """The documents that neither a rule nor their host's verdict rejects. Same columns as docs.

    Texts are measured for the hosts' counts, and again where they pass: that costs less than a second copy of all texts.
    """
    hosts = written(host_verdicts(measured(docs), limit, trust), "quality-hosts")
    return with_verdicts(measured(docs, whole=True), hosts).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged_quality(docs).select("doc_id", *MEASURES, "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
b AS (SELECT doc_id, source, text, ws, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM b WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
p AS (SELECT doc_id, CAST(count(DISTINCT i + j) AS BIGINT) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT b.doc_id, source, n_words, word_chars, n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM b LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR 3 * n_dup_lines > n_lines OR word_chars < 3 * n_words OR word_chars > 40 * n_words AS soft_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft_failed)::INT)::DOUBLE AS x FROM f GROUP BY source),
q AS (SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) AS sq, count(*) AS hosts, sum(n) AS n FROM h),
s AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * hosts / n, 1e-6) - 1, 2.0), 1e6) AS k FROM q),
z AS (SELECT source, n, mean, k, (x + mean * k) / (n + k) AS rate FROM h, s),
v AS (SELECT source, rate - 2 * sqrt(rate * (1 - rate) / (n + k + 1)) > 0.5 AS rejected, rate < 0.5 * mean AS trusted FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AND (NOT soft_failed OR trusted) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
