import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    """Rows as sorted tuples, floats rounded."""
    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        return f"{float(v):.5f}"

    return sorted(tuple(cell(v) for v in r) for r in rows)


def same(df, duck, sql):
    columns = sorted(df.columns)
    want = duck.sql(sql)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
