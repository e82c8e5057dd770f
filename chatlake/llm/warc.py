"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Records are gzip members of their own. The reader checks each member (gzip checksum), its version line, its length and the block
and payload digests that it names (SHA-256, SHA-1, MD5; of HTTP responses the body's). After a failed check it looks for the next
valid member or the next version line (inside the member, too), goes on there, and logs the skipped bytes as a gap row with the reason.
Files are read as streams: a reader holds one record and a window of the file, whatever the file's length. A record's length is believed
only once the bytes where it says to end are a record's end; they are looked at without what stands before them, so a damaged
length loads nothing.

Defined cases: a null payload is empty; a null id or URL is written as `-` and read as null; rows with one id are each written;
of equal payloads the smallest id is the response, and rows that share that id all are; very long payloads are one record each;
an empty table gives an archive folder without records; extra columns are ignored. A task's records form files of about
FILE_BYTES, each renamed into place when whole; the manifest names those of the attempts that count. Members of several records
give each of them; records of other writers have their `record_id` and no page_id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import committed, reader
from .shared import new_path, slices, written

LEAST_REVISIT = 100
VERSION = b"WARC/1.1"
HEAD, END = re.compile(rb"WARC/1\.[01]\r\n"), b"\r\n\r\n"
ENDS = re.compile(rb"\r\n(?=\r\n)")  # with two bytes to come: they may be a part of the next
FILE_BYTES, WINDOW = 256_000_000, 1 << 20
#: Payloads with at least this share of all rows are heavy: 1 / share of them at most.
HEAVY = 1 / 1000


def record_plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """id, url, payload, digest and refers_to: the smallest id among equal payloads, where it is another row's.

    Payloads shared by many rows are joined by broadcast (1 / HEAVY rows at most); the rest by their digest.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = written(rows.select("id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("bytes")), "warc-digests")
    groups = digests.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    groups = written(groups, "warc-groups")
    total = digests.count()
    hot = groups.where(F.col("n") >= max(2, total * HEAVY))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    if hot.take(1):
        keyed = keyed.join(F.broadcast(hot.select("digest", F.col("first_id").alias("hot_id"))), "digest", "left")
    else:
        keyed = keyed.withColumn("hot_id", F.lit(None).cast(pages.schema[id_col].dataType))
    # rows that are settled, and those no group can have, spread over all tasks
    settled = F.col("hot_id").isNotNull() | (F.length("payload") < least)
    keyed = keyed.withColumn("join_key", F.when(settled, F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))).otherwise(F.col("digest")))
    cold = groups.where(F.col("n") < max(2, total * HEAVY)).select(F.col("digest").alias("join_key"), F.col("first_id").alias("cold_id"))
    joined = keyed.join(cold, "join_key", "left")
    first = F.coalesce("hot_id", "cold_id")
    return joined.select("id", "url", "payload", "digest", F.when(first != F.col("id"), first).alias("refers_to"))


def record_bytes(row_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'-' if row_id is None else row_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url) if url is not None else '-'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_warc(plan: DataFrame, folder: str, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes files of about file_bytes below folder; returns the manifest (file, records, bytes)."""

    def write(batches):
        part, n = TaskContext.get().partitionId(), 0
        rows = (row for whole in batches for batch in slices(whole) for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            name, records, size = f"part-{part:06d}-{n:05d}.warc{'.gz' * compress}", 0, 0
            with committed(f"{folder}/{name}") as out:
                while row is not None and size < file_bytes:
                    data = record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                    if compress:
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = packer.compress(data) + packer.flush()
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    row = next(rows, None)
            n += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]}, MANIFEST)

    return written(plan.select("id", "url", "payload", "digest", "refers_to").mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


class Window:
    """Bytes of a file, or of a buffer, read as far as they are asked for."""

    def __init__(self, source):
        self.file = source if hasattr(source, "read_at") else pa.BufferReader(source)
        self.size, self.start, self.held = self.file.size(), 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """n bytes from offset, fewer at the end of the file."""
        n = max(0, min(n, self.size - offset))
        if offset < self.start or offset + n > self.start + len(self.held):
            self.start, self.held = offset, self.file.read_at(max(n, min(WINDOW, self.size - offset)), offset)
        return self.held[offset - self.start : offset - self.start + n]

    def ends(self, offset: int) -> bool:
        """True if a record's last bytes end at offset."""
        if offset > self.size:
            return False
        inside = self.start <= offset - len(END) and offset <= self.start + len(self.held)
        return (self.at(offset - len(END), len(END)) if inside else self.file.read_at(len(END), offset - len(END))) == END

    def find(self, sought: re.Pattern, offset: int) -> int:
        """The first match of a pattern of at most 32 bytes, or the file's end."""
        while offset < self.size:
            part = self.at(offset, WINDOW)
            if hit := sought.search(part):
                return offset + hit.start()
            offset += max(1, len(part) - 32) if offset + len(part) < self.size else len(part)
        return self.size


class Plain:
    """The bytes of an uncompressed archive from an offset on."""

    def __init__(self, window: Window, offset: int):
        self.window, self.offset = window, offset

    def peek(self, n: int) -> bytes:
        return self.window.at(self.offset, n)

    def ends(self, n: int) -> bool:
        return self.window.ends(self.offset + n)

    def skip(self, n: int) -> None:
        self.offset += n


class Member:
    """The bytes of the gzip member at an offset, unpacked as far as they are asked for."""

    def __init__(self, window: Window, offset: int):
        self.window, self.offset, self.unpack, self.held, self.whole = window, offset, zlib.decompressobj(31), bytearray(), False
        self.past, self.ahead = 0, None  # bytes that were skipped; a copy that unpacks what is far ahead and keeps nothing of it

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and not self.whole:
            left = self.unpack.unconsumed_tail
            data = left or self.window.at(self.offset, 1 << 16)
            more = self.unpack.decompress(data, WINDOW)
            if not (data or more or self.unpack.eof):
                raise zlib.error("cut")
            self.held += more
            self.offset += 0 if left else len(data)
            if self.unpack.eof:
                self.offset -= len(self.unpack.unused_data)
                self.whole = True
        return bytes(self.held[:n])

    def ends(self, n: int) -> bool:
        """True if a record's last bytes end n bytes on. What is far ahead is unpacked once, and only the places of such bytes are kept."""
        if n <= len(self.held) + WINDOW or self.whole:
            return self.peek(n)[n - len(END) :] == END
        if self.ahead is None:
            self.ahead, self.from_, self.seen, self.last, self.places = self.unpack.copy(), self.offset, self.past + len(self.held), bytes(self.held[-3:]), array("q")
        while self.seen < self.past + n and not self.ahead.eof:
            left = self.ahead.unconsumed_tail
            data = left or self.window.file.read_at(min(1 << 16, self.window.size - self.from_), self.from_)
            more = self.ahead.decompress(data, WINDOW)
            if not (data or more or self.ahead.eof):
                raise zlib.error("cut")
            both = self.last + more
            self.places.extend(self.seen - len(self.last) + hit.end() + 2 for hit in ENDS.finditer(both))
            self.from_, self.seen, self.last = self.from_ + (0 if left else len(data)), self.seen + len(more), both[-3:]
        at = bisect_left(self.places, self.past + n)
        return at < len(self.places) and self.places[at] == self.past + n

    def skip(self, n: int) -> None:
        self.past += min(n, len(self.held))
        del self.held[:n]

    def seek(self, sought: re.Pattern) -> bool:
        """Skips to the next match of a pattern of at most 32 bytes; False if there is none."""
        while True:
            part = self.peek(WINDOW)
            if hit := sought.search(part):
                self.skip(hit.start())
                return True
            if len(part) < WINDOW:
                return False
            self.skip(WINDOW - 32)


def _differs(digest: str, data: bytes) -> bool:
    """True if data doesn't have the digest, as `algorithm:value` in hex or base32; algorithms that are not known pass."""
    kind, _, value = digest.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return False
    got = hashlib.new(kind.lower(), data).digest()
    return value.lower() != got.hex() and value.upper().rstrip("=") != base64.b32encode(got).decode().rstrip("=")


def body_of(head: dict[str, str], block: bytes) -> bytes | None:
    """The payload: the block, or an HTTP message's body; None where that is sent in chunks."""
    if not head.get("content-type", "").startswith("application/http"):
        return block
    top, _, body = block.partition(b"\r\n\r\n")
    return None if b"transfer-encoding: chunked" in top.lower() else body


def _record(stream) -> tuple[dict[str, str], bytes] | str:
    """Headers and block of the record that the stream begins with, or what is wrong with it."""
    if not HEAD.match(stream.peek(10)):
        return "no version line"
    n = 4096
    while (end := (top := stream.peek(n)).find(b"\r\n\r\n")) < 0:
        if len(top) < n or n > 64 * WINDOW:
            return "headers do not end"
        n *= 4
    head: dict[str, str] = {}
    for line in top[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    if len(length) > 18 or not stream.ends(end + 8 + int(length)):
        return "block is cut or followed by other bytes"
    whole = stream.peek(end + 8 + int(length))
    block = whole[end + 4 : -4]
    if _differs(head.get("warc-block-digest", ""), block):
        return "block digest differs"
    payload = body_of(head, block) if head.get("warc-type") in ("response", "resource") else None
    if payload is not None and _differs(head.get("warc-payload-digest", ""), payload):
        return "payload digest differs"
    stream.skip(len(whole))
    return head, block


def _of_member(window: Window, at: int) -> Iterator[tuple[dict[str, str], bytes] | str | int]:
    """A member's records, then where it ends, or what is wrong; the last record only once the checksum fits.

    After a damaged record it goes on at the member's next version line."""
    stream, last, wrong = Member(window, at), None, ""
    try:
        while stream.peek(1):
            found = _record(stream)
            if isinstance(found, str):
                wrong = wrong or found
                stream.skip(1)
                if not stream.seek(HEAD):
                    break
                continue
            if last is not None:
                yield last
            last = found
        while wrong and not stream.whole:  # to the checksum
            stream.skip(len(stream.peek(WINDOW)))
    except zlib.error:
        yield wrong or "gzip member is damaged"
        return
    if last is not None:
        yield last
    yield wrong or (stream.offset if last is not None else "no version line")


NEXT = re.compile(rb"\x1f\x8b\x08|" + HEAD.pattern)


def salvage(source) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(offset, length, headers, block, ""), or (offset, length, None, b"", reason) for skipped bytes, in file order.

    source: bytes, or a file with size() and read_at(). Of a member's records the last has its length, the others 0.
    """
    window = Window(source)
    at, bad, why = 0, None, ""
    while at < window.size:
        if window.at(at, 2) == b"\x1f\x8b":
            held, end, wrong = None, None, ""
            for found in _of_member(window, at):
                if isinstance(found, tuple):
                    if bad is not None:
                        yield bad, at - bad, None, b"", why
                        bad = None
                    if held:
                        yield at, 0, *held, ""
                    held = found
                elif isinstance(found, int):
                    end = found
                else:
                    wrong = found
            if held:
                yield at, 0 if end is None else end - at, *held, ""
        else:
            stream = Plain(window, at)
            found = _record(stream)
            end, wrong = (None, found) if isinstance(found, str) else (stream.offset, "")
            if end is not None:
                if bad is not None:
                    yield bad, at - bad, None, b"", why
                    bad = None
                yield at, end - at, *found, ""
        if end is not None:
            at = end
            continue
        if bad is None:
            bad, why = at, wrong
        at = window.find(NEXT, at + 1)
    if bad is not None:
        yield bad, window.size - bad, None, b"", why


FIELDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("is_gap", pa.bool_()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None, blocks: bool = True) -> DataFrame:
    """A row per record and per gap: file, offset, length, is_gap, reason, headers, block (null unless asked for), payload_bytes, payload_digest.

    Reads the files of the manifest, or all `*.warc*` of the folder, a task a few files each.
    """

    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with ExitStack() as stack:
                    for at, length, head, block, why in salvage(stack.enter_context(reader(file))):
                        payload = None if head is None else body_of(head, block)
                        rows.append((file, at, length, head is None, why or None, list((head or {}).items()), block if blocks and head is not None else None, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest()))
                        size += len(block) * blocks + 500
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)

    if manifest is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    else:
        files = manifest.select(F.concat(F.lit(f"{folder}/"), "file").alias("path"))
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(read, "file string, offset long, length long, is_gap boolean, reason string, headers map<string,string>, block binary, payload_bytes long, payload_digest string")


def archived(spark: SparkSession, folder: str, id_type: str = "long", manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The records (page_id, record_id, payload_bytes, payload_digest, record_type, refers_to, url), and the log of quarantined gaps
    (file, offset, length, reason); both come from one pass over the files, kept in the shared folder."""
    rows = written(read_warc(spark, folder, manifest, blocks=False), "warc-read")
    urn = lambda name: F.regexp_extract(F.col("headers")[name], "^<urn:page:(.*)>$", 1).try_cast(id_type)
    kind = F.col("headers")["warc-type"]
    revisit = kind == "revisit"
    records = rows.where("not is_gap").select(
        urn("warc-record-id").alias("page_id"),
        F.col("headers")["warc-record-id"].alias("record_id"),
        F.when(revisit, F.col("headers")["warc-payload-length"].try_cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        kind.alias("record_type"),
        urn("warc-refers-to").alias("refers_to"),
        F.nullif(F.col("headers")["warc-target-uri"], F.lit("-")).alias("url"),
    )
    return records, written(rows.where("is_gap").select("file", "offset", "length", "reason"), "warc-gaps")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_path(spark, "warc")
    manifest = write_warc(record_plan(pages, "page_id", "url", "html"), folder)
    records, _ = archived(spark, folder, manifest=manifest)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM g
"""
