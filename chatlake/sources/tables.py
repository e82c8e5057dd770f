"""Tables in the folder that the driver and every executor share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on one machine (tests) a new temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chatlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def whole_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of inputs that are shuffled by one key as shuffled by that key, though adaptive execution may give each input other partitions:
    a window or an aggregation after it then meets a key in two tasks and gives rows twice. Since plans are made after a query has returned, this setting stays."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def new_path(spark: SparkSession, name: str) -> str:
    whole_unions(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "{rows}", "spark.sql.execution.arrow.maxBytesPerBatch": "{mb}m"}


@contextmanager
def batches(spark: SparkSession, rows: int = 10_000, mb: int = 4) -> Iterator[None]:
    """Actions inside hand Python workers at most so many rows and MB at a time. The session's own settings come back."""
    before = {key: spark.conf.get(key) for key in _BATCH}
    for key, value in _BATCH.items():
        spark.conf.set(key, value.format(rows=rows, mb=mb))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
