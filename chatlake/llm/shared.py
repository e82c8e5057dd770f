"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import new_path

__all__ = ["batches", "free_name", "gathered", "id_remainder", "new_path", "slices", "store", "trimmed", "written"]

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches(spark: SparkSession, rows: int = 10_000, mb: int = 4) -> Iterator[None]:
    """Actions inside hand Python workers at most so many rows and MB at a time. The session's own settings come back."""
    before = {key: spark.conf.get(key) for key in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, f"{mb}m")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str, rows: int = 10_000, mb: int = 4) -> DataFrame:
    """df as a Parquet table in the shared folder, made in batches of at most so many rows and MB."""
    with batches(df.sparkSession, rows, mb):
        return tables.written(df, name)


def gathered(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size in the driver, by Arrow: rows of Python objects would take ten times the memory."""
    with batches(df.sparkSession):
        table = df.toArrow()
    return {name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False) for name in table.column_names}


def slices(batch: pa.RecordBatch, mb: float = 4) -> Iterator[pa.RecordBatch]:
    """A batch of the session's size in parts of about so many MB: bounds what a task makes of it at once."""
    step = max(1, int(batch.num_rows * mb * 1_000_000 / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def free_name(name: str, taken: list[str]) -> str:
    """name, or the first of name_1, name_2, ... that is not taken; Spark compares names without case."""
    low, n, out = {c.lower() for c in taken}, 0, name
    while out.lower() in low:
        n += 1
        out = f"{name}_{n}"
    return out


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


_stores: list = []


def store(make: Callable) -> Callable:
    """make, whose last result a worker process keeps for its next task, until a task of another operator needs the room."""
    kept = functools.lru_cache(maxsize=1)(make)
    _stores.append(kept)
    return kept


def trimmed(task: Callable, keep: Callable | None = None) -> Callable:
    """A function on batches that first drops what other operators' tasks left in its worker process, but for `keep`, and gives free
    memory back to the system then and in the end: executors' workers outlive their tasks."""

    def give_back() -> None:
        dropped = [kept.cache_clear() for kept in _stores if kept is not keep and kept.cache_info().currsize]
        if dropped:
            gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    def run(batches):
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
