"""A stream of stored messages whose offset is each domain's last id: Spark's checkpoint takes the place of a table of last ids.

The messages lie in a folder a domain (`domain_id=7/*.parquet`, as `partitionBy` writes them). The newest id of a domain is read from its
files' footers; a batch is a partition for each domain that has more, which reads the row groups above the last offset. Ids
grow within a domain: a message with an id below the offset of its domain, however late it is written, is not read.
The offset has an entry a domain.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NONE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Part(InputPartition):
    domain: str
    after: int
    upto: int
    files: list[str]


class MessageReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.footers: dict[str, int] = {}

    def _files(self) -> dict[str, list[str]]:
        """Paths of each domain's files."""
        system, root = fs.FileSystem.from_uri(self.options["path"])
        out: dict[str, list[str]] = defaultdict(list)
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder, _, name = info.path.rpartition("/")
            if info.is_file and name.endswith(".parquet") and name[0] not in "_." and "/domain_id=" in f"/{folder}":
                out[folder.rpartition("domain_id=")[2]].append(info.path)
        return out

    def _last(self, path: str) -> int:
        """A file's largest id, from its footer alone."""
        if path not in self.footers:
            system, _ = fs.FileSystem.from_uri(self.options["path"])
            meta = pq.read_metadata(path, filesystem=system)
            at = meta.schema.names.index("msg_id")
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
            self.footers[path] = max((s.max for s in stats if s is not None and s.has_min_max), default=-1)
        return self.footers[path]

    def initialOffset(self) -> dict:
        return json.loads(self.options.get("after", "{}"))

    def latestOffset(self) -> dict:
        newest = {domain: max(map(self._last, files)) for domain, files in self._files().items()}
        return self.initialOffset() | {d: max(n, self.initialOffset().get(d, n)) for d, n in newest.items()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = self._files()
        out = []
        for domain, upto in sorted(end.items()):
            after = start.get(domain, -1)
            if upto > after and (own := [f for f in files.get(domain, []) if self._last(f) > after]):
                out.append(Part(domain, after, upto, own))
        return out or [Part("", 0, 0, [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = fs.FileSystem.from_uri(self.options["path"])
        wanted = to_arrow_schema(self.schema, prefers_large_types=False)
        stored = [f.name for f in wanted if f.name != "domain_id"]
        for path in partition.files:
            table = pq.read_table(path, filesystem=system, columns=stored, partitioning=None, filters=[("msg_id", ">", partition.after), ("msg_id", "<=", partition.upto)])
            domain = None if partition.domain == NONE else int(partition.domain)
            table = table.append_column("domain_id", pa.array([domain] * len(table), pa.int64())).select(wanted.names).cast(wanted)
            yield from table.to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        pass


class MessageLog(DataSource):
    """format("message_log"): options path, schema (DDL, with domain_id and msg_id) and after, a JSON object of domains' last ids."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> MessageReader:
        return MessageReader(schema, self.options)


def write_log(messages: DataFrame, path: str) -> None:
    """messages appended to the log at path, sorted by id, so that a reader skips the row groups it knows."""
    messages.repartition("domain_id").sortWithinPartitions("domain_id", "msg_id").write.mode("append").partitionBy("domain_id").parquet(path)


def stream_log(spark: SparkSession, path: str, schema: str, after: dict[int, int] | None = None) -> DataFrame:
    spark.dataSource.register(MessageLog)
    offsets = json.dumps({NONE if d is None else str(d): n for d, n in (after or {}).items()})
    return spark.readStream.format("message_log").option("path", path).option("schema", schema).option("after", offsets).load()
