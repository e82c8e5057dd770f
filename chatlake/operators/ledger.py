"""Credits: balances, usage and payment matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.fixtures import cte, table, view
from .running import running_sum


def ledger_balance(ledger: DataFrame) -> DataFrame:
    """Running balance per user, and whether the transaction takes it below 0."""
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    out = running_sum(ledger, ["telegram_id"], ["created_at", "tx_id"], "amount", "balance_after", by=seconds)
    return out.withColumn("overdrawn", (F.col("balance_after") < 0) & (F.col("amount") < 0))


@query("w3_ledger_balance", cte("ledger") + ", b AS (SELECT tx_id, amount, CAST(sum(amount) OVER (PARTITION BY telegram_id ORDER BY created_at, tx_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after FROM ledger) SELECT tx_id, balance_after, balance_after < 0 AND amount < 0 AS overdrawn FROM b")
def w3(spark, sf_dir):
    return ledger_balance(view(spark, sf_dir, "ledger")).select("tx_id", "balance_after", "overdrawn")


def usage_by_endpoint(ledger: DataFrame) -> DataFrame:
    return ledger.where("type = 'usage'").groupBy("endpoint").agg(F.count("*").alias("n_calls"), F.sum(F.abs("amount")).alias("spent"))


@query("a6_usage_by_endpoint", cte("ledger") + " SELECT endpoint, count(*) AS n_calls, CAST(sum(abs(amount)) AS BIGINT) AS spent FROM ledger WHERE type = 'usage' GROUP BY endpoint")
def a6(spark, sf_dir):
    return usage_by_endpoint(view(spark, sf_dir, "ledger"))


@query("a7_topup_total", cte("ledger") + " SELECT CAST(coalesce(sum(amount) FILTER (WHERE type IN ('topup', 'bonus')), 0) AS BIGINT) AS total FROM ledger")
def a7(spark, sf_dir):
    return view(spark, sf_dir, "ledger").agg(F.coalesce(F.sum(F.when(F.col("type").isin("topup", "bonus"), F.col("amount"))), F.lit(0)).alias("total"))


def balance_rebuild(users: DataFrame, keys: DataFrame) -> DataFrame:
    """Per user, the sums of the keys' balances and spending; 0 without a key."""
    per = keys.groupBy("user_id").agg(F.sum("balance").alias("balance"), F.sum("spent").alias("spent"))
    return users.join(per, "user_id", "left").select("user_id", F.coalesce("balance", F.lit(0)).alias("balance"), F.coalesce("spent", F.lit(0)).alias("spent"))


@query("a8_balance_rebuild", "SELECT CAST(c_custkey AS BIGINT) AS user_id, CAST(coalesce((SELECT sum(o_orderkey % 100) FROM orders WHERE o_custkey = c_custkey), 0) AS BIGINT) AS balance, CAST(coalesce((SELECT sum(o_orderkey % 7) FROM orders WHERE o_custkey = c_custkey), 0) AS BIGINT) AS spent FROM customer")
def a8(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("user_id"), (F.col("o_orderkey") % 100).cast("long").alias("balance"), (F.col("o_orderkey") % 7).cast("long").alias("spent"))
    return balance_rebuild(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id")), keys)


def ledger_owner(transactions: DataFrame, keys: DataFrame) -> DataFrame:
    """The transaction's user, or else its key's user."""
    k = keys.select("api_key_id", F.col("telegram_id").alias("_key_user"))
    return transactions.join(k, "api_key_id", "left").withColumn("owner", F.coalesce("telegram_id", "_key_user")).drop("_key_user")


@query("j12_ledger_owner", cte("ledger") + ", t AS (SELECT tx_id, api_key_id, CASE WHEN tx_id % 3 > 0 THEN telegram_id END AS telegram_id FROM ledger) SELECT tx_id, coalesce(telegram_id, 1000 + api_key_id) AS owner FROM t")
def j12(spark, sf_dir):
    t = view(spark, sf_dir, "ledger").withColumn("telegram_id", F.expr("CASE WHEN tx_id % 3 > 0 THEN telegram_id END"))
    keys = view(spark, sf_dir, "ledger").select("api_key_id", (F.lit(1000) + F.col("api_key_id")).alias("telegram_id")).distinct()
    return ledger_owner(t, keys).select("tx_id", "owner")


def match_payments(requests: DataFrame, payments: DataFrame, window_s: int = 300, share: float = 0.95) -> DataFrame:
    """The earliest payment that fits each request: equal comment, enough paid, in time. One row per matched request."""
    p = payments.select(F.col("comment").alias("_c"), F.col("amount").alias("_a"), F.col("paid_at"), "payment_id")
    on = (F.col("comment") == F.col("_c")) & (F.col("_a") >= share * F.col("expected")) & (F.col("paid_at") >= F.col("requested_at")) & (F.col("paid_at") <= F.col("requested_at") + F.make_dt_interval(secs=F.lit(window_s)))
    return requests.join(p, on).groupBy("request_id").agg(F.min_by("payment_id", F.struct("paid_at", "payment_id")).alias("payment_id"))


@query("j8_match_payments", "SELECT r.event_id AS request_id, arg_min(p.event_id, (p.ts, p.event_id)) AS payment_id FROM events r JOIN events p ON p.user_id = r.user_id AND r.event_type = 'click' AND p.event_type = 'purchase' AND p.value >= 0.95::DOUBLE * r.value AND p.ts >= r.ts AND p.ts <= r.ts + INTERVAL 6 HOURS GROUP BY 1")
def j8(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    requests = e.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("comment"), F.col("value").alias("expected"), F.col("ts").alias("requested_at"))
    payments = e.where("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), F.col("user_id").alias("comment"), F.col("value").alias("amount"), F.col("ts").alias("paid_at"))
    return match_payments(requests, payments, 6 * 3600)
