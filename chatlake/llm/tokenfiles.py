"""Token ids in Arrow stream-format files of fixed-size-list batches.

A shard holds the ids of a range of documents, end to end, cut into rows of equal length: `ids` is a
fixed_size_list<uint16, L> (uint32 for a vocabulary of more than 65,536) and `mask` a fixed_size_list<uint8, L / 8> of bits,
0 on the padding of the shard's last row. Every batch
but the last has the same number of rows, so row r of a shard is found by arithmetic, and a memory map gives it without
a copy (`TokenShard`). A second stream beside it lists the shard's documents: doc_id and number of ids.

Documents go to shards by ranges of doc_id; a window over the shards' totals, one row per shard, gives each document's
start. Defined cases: a null text is empty and still has its end id; null ids come first; rows with equal ids lie
in one shard, ordered by text; very long texts are encoded whole and span rows and batches; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import committed, reader
from .shared import new_path, written

LENGTH, BATCH_ROWS, END_ID = 2048, 64, 2
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class _Known(dict):
    """Ids of cuts. A cut that is not known yet gives None, and waits to be learnt with others."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, cut: str) -> None:
        self.waiting.append(cut)
        self[cut] = None


class WordCachedEncoder:
    """Ids of whole texts, as little-endian uint32 bytes.

    The pre-tokenizer always starts a piece at a single space or line feed between two other characters, so a text is cut
    there, and each distinct cut is encoded by the library once while it is remembered.
    """

    def __init__(self, tokenizer, most: int = 1_500_000):
        self.tokenizer, self.most, self.known = tokenizer, most, _Known()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.known.waiting = self.known.waiting, []
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            self.known.update(zip(part, self._ids([c if c[:1] == "\n" else " " + c for c in part])))

    def cuts(self, text: str) -> list[str]:
        """A text's first cut, then the others, without the space that they start with."""
        single = not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n")
        if single and not _OTHER_SPACE.search(text):
            return text.replace("\n", " \n").split(" ")
        head, *rest = _CUT.split(text)
        return [head, *[x if x[0] == "\n" else x[1:] for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) >= self.most:
            self.known = _Known()
        get, rows = self.known.__getitem__, [self.cuts(t) if t else [] for t in texts]
        parts = [list(map(get, row[1:])) for row in rows]
        if self.known.waiting:
            self._learn()
        heads, out = self._ids([row[0] for row in rows if row]), []
        heads.reverse()
        for row, part in zip(rows, parts):
            if None in part:
                part = [self.known[c] if p is None else p for p, c in zip(part, row[1:])]
            out.append((heads.pop() if row else b"") + b"".join(part))
        return out


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=1)
def encoder_for(path: str) -> WordCachedEncoder:
    """One encoder per worker process: what a task learns, the next one knows."""
    return WordCachedEncoder(load_tokenizer(path))


class ShardWriter:
    """Appends ids to a stream of equal-length rows."""

    def __init__(self, out, wide: bool, length: int = LENGTH, rows: int = BATCH_ROWS):
        self.length, self.rows, self.held, self.kind = length, rows, bytearray(), np.dtype("<u4" if wide else "<u2")
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.stream = pa.ipc.new_stream(out, self.schema)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(len(ids)) < real, bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((ids, self.length), (mask, self.length // 8))]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: bytes) -> None:
        """ids: little-endian uint32."""
        self.held += np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        size = self.length * self.rows
        step = self.kind.itemsize * size
        while len(self.held) >= step:
            self._batch(np.frombuffer(bytes(self.held[:step]), self.kind), size)
            del self.held[:step]

    def close(self) -> None:
        real = len(self.held) // self.kind.itemsize
        if real:
            ids = np.zeros(-(-real // self.length) * self.length, self.kind)
            ids[:real] = np.frombuffer(bytes(self.held), self.kind)
            self._batch(ids, real)
        self.stream.close()


class TokenShard:
    """Random access to a shard: row(i) gives ids and mask bits, views of the file's bytes where the file system can map it."""

    def __init__(self, url: str):
        local = url.removeprefix("file://")
        source = pa.memory_map(local) if local.startswith("/") else reader(url)
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = self.batches[0].num_rows if self.batches else 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, at = self.batches[i // self.rows], i % self.rows
        return tuple(batch.column(c)[at].values.to_numpy(zero_copy_only=True) for c in (0, 1))

    def mask(self, i: int) -> np.ndarray:
        return np.unpackbits(self.row(i)[1], bitorder="little").astype(bool)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)


DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Writes the shards; returns the manifest: shard, file, docs, tokens, start."""

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        encoder = encoder_for(tokenizer_path)
        shard = TaskContext.get().partitionId()
        name, end, n_docs, n_ids = f"shard-{shard:06d}", np.array([end_id], "<u4").tobytes(), 0, 0
        with committed(f"{folder}/{name}.arrows") as ids_out, committed(f"{folder}/{name}.docs.arrows") as docs_out:
            wide = encoder.tokenizer.get_vocab_size() > 65_536
            ids, listed = ShardWriter(ids_out, wide, length), pa.ipc.new_stream(docs_out, DOCS)
            while batch is not None:
                encoded = [x + end for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
                for x in encoded:
                    ids.add(x)
                sizes = [len(x) // 4 for x in encoded]
                listed.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
                n_docs, n_ids = n_docs + len(sizes), n_ids + sum(sizes)
                batch = next(batches, None)
            ids.close()
            listed.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "docs": [n_docs], "tokens": [n_ids]}, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ranged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(ranged.mapInArrow(write, "shard int, file string, docs long, tokens long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids (little-endian uint32)."""
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = iter(pa.ipc.open_stream(reader(f"{folder}/{name}.arrows")))
                held = b""
                for docs in pa.ipc.open_stream(reader(f"{folder}/{name}.docs.arrows")):
                    sizes, crcs, starts = docs.column(1).to_pylist(), [], []
                    for n in sizes:
                        crc, left = 0, 4 * n
                        while left:
                            if not held:
                                held = memoryview(next(rows).column(0).flatten().to_numpy(zero_copy_only=True).astype("<u4")).cast("B")
                            crc = zlib.crc32(held[:left], crc)
                            left, held = max(0, left - len(held)), held[left:]
                        crcs.append(crc)
                        starts.append(start)
                        start += n
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts, pa.int64()), docs.column(1), pa.array(crcs, pa.int64())], schema=fields)

    # a number of its own keeps adaptive execution from putting all shards into one task
    spread = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder), folder)
