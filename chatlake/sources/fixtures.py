"""Message-archive tables, derived from the given tables: the same expressions serve Spark and SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"

#: name: (table, expressions as alias -> SQL). sec(x) stands for 2024-01-01 plus x seconds.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "messages": (
        "conversations",
        {
            "domain_id": "conv_id % 7",
            "msg_id": "conv_id * 100 + turn",
            "reply_to_msg_id": "CASE WHEN turn % 4 = 1 OR (turn = 2 AND conv_id % 5 = 0) THEN conv_id * 100 + turn - 1 WHEN turn % 4 = 3 AND conv_id % 3 = 0 THEN conv_id * 100 + 99 END",
            "sender_name": "CASE WHEN turn = 0 THEN NULL ELSE role END",
            "content": "concat(text, ' #', role, CASE WHEN conv_id % 2 = 0 THEN ' #even' ELSE '' END)",
            "content_type": "CASE WHEN conv_id % 11 = 0 THEN 'sticker' WHEN conv_id % 13 = 0 THEN 'poll' ELSE 'text' END",
            "msg_date": "sec(conv_id * 1800 + turn * 200)",
        },
    ),
    "posts": ("documents", {"id": "doc_id", "domain_id": "abs(doc_id % 20)", "content": "text", "language": "lang", "msg_date": "sec(doc_id * 600)"}),
    "vectors": ("embeddings", {"id": "vec_id", "channel_id": "label", "embedding": "embedding", "msg_ts": "1704067200 + vec_id * 600"}),
    # every question, whole; and as vectors every row whose id is divisible by 100, against all rows
    "queries": ("benchmark", {"query_id": "item_id", "query_text": "text"}),
    "query_vectors": ("embeddings WHERE vec_id % 100 = 0", {"query_id": "vec_id", "q": "embedding"}),
    "domains": (
        "customer",
        {
            "domain_id": "CAST(c_custkey AS BIGINT)",
            "owner_id": "CAST(c_nationkey AS BIGINT)",
            "channel_username": "lower(c_name)",
            "pinned": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 4 = 0 END",
            "is_active": "c_custkey % 10 <> 0",
            "message_count": "CAST(floor(c_acctbal) AS BIGINT)",
            "next_sync_at": "sec(c_custkey * 3600)",
        },
    ),
    "grps": ("region", {"group_id": "CAST(r_regionkey AS BIGINT)", "name": "r_name", "is_active": "r_regionkey <> 4"}),
    "members": ("customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'", {"group_id": "CAST(n_regionkey AS BIGINT)", "domain_id": "CAST(c_custkey AS BIGINT)"}),
    "entities": ("supplier", {"domain_id": "CAST(s_nationkey AS BIGINT)", "name": "s_name", "type": "CASE WHEN s_suppkey % 3 = 0 THEN 'Vendor' ELSE 'Supplier' END", "confidence": "CAST(s_suppkey % 10 AS DOUBLE) / 10", "source_quote": "concat('quote of ', s_name)"}),
    "ledger": (
        "events",
        {
            "tx_id": "event_id",
            "telegram_id": "user_id",
            "api_key_id": "CAST(user_id % 5 AS BIGINT)",
            "amount": "CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) ELSE -CAST(floor(value * 10) AS BIGINT) END",
            "type": "CASE WHEN event_type = 'purchase' THEN 'topup' WHEN event_type = 'signup' THEN 'bonus' ELSE 'usage' END",
            "endpoint": "event_type",
            "created_at": "ts",
        },
    ),
    "runs": ("orders", {"run_id": "CAST(o_orderkey AS BIGINT)", "config_id": "CAST(o_custkey AS BIGINT)", "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END", "completed_at": "o_orderdate"}),
    "chat": ("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "content": "text", "token_count": "CAST(length(text) AS DOUBLE) / 4"}),
}
RELATIONS = "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS domain_id, s_name AS source, concat('Part#', CAST(l_partkey % 50 AS VARCHAR(10))) AS target, l_returnflag AS type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _seconds(text: str, form: str) -> str:
    return re.sub(r"\bsec\(((?:[^()]|\([^()]*\))*)\)", lambda m: form.format(m[1]), text)


def spark_sql(text: str) -> str:
    return _seconds(text, "(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {}))")


def duck_sql(text: str) -> str:
    return _seconds(text, "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({}))")


def _select(name: str) -> str:
    if name == "relations":
        return RELATIONS
    source, columns = VIEWS[name]
    return "SELECT " + ", ".join(f"{e} AS {a}" for a, e in columns.items()) + f" FROM {source}"


def cte(*names: str) -> str:
    """WITH clause of the named views, for SQL."""
    return "WITH " + ", ".join(f"{n} AS ({duck_sql(_select(n))})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or relations, as a DataFrame."""
    text = spark_sql(_select(name))
    tables = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text))
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"given_{t}")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 given_\2", text))
