"""Keys, links, periods and amounts as column functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the namespace of thread ids.
THREAD_NAMESPACE = "b7e3f1a0-2d4c-4e6f-8a1b-c3d5e7f90123"
#: Period code -> days.
PERIOD_DAYS = {"1w": 7, "2w": 14, "1m": 30, "3m": 90, "6m": 180, "1y": 365, "3y": 1095}


def uuid5(name: Column, namespace: str = THREAD_NAMESPACE) -> Column:
    """UUID of a name: SHA-1 of namespace and name, with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.element_at(F.split(F.regexp_replace(variant, "(?<=.)(?=.)", ","), ","), nibble), F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The same in SQL, of the domain's and the root's number.
THREAD_UUID_SQL = f"""list_transform([sha1(unhex('{THREAD_NAMESPACE.replace("-", "")}') || encode(concat_ws('_', {{0}}, {{1}})))], lambda h: concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)))[1]"""


def thread_uuid(domain_id: Column, root_id: Column) -> Column:
    return uuid5(F.concat_ws("_", domain_id.cast("string"), root_id.cast("string")))


def message_link(user: Column, msg: Column, topic: Column | None = None) -> Column:
    parts = [F.lit("https://t.me"), user, *([topic.cast("string")] if topic is not None else []), msg.cast("string")]
    return F.when((F.coalesce(user, F.lit("")) == "") | msg.isNull(), F.lit("")).otherwise(F.concat_ws("/", *parts))


def period_to_cutoff(code: Column, as_of: Column, default_days: int | None = None) -> Column:
    """1w..3y, Nd, or an ISO date -> cutoff; null (or the default) for anything else."""
    days = F.create_map(*[F.lit(x) for kv in PERIOD_DAYS.items() for x in kv])[F.lower(code)]
    days = F.coalesce(days, F.regexp_extract(F.lower(code), r"^(\d{1,4})d$", 1).try_cast("int"))
    if default_days is not None:
        days = F.coalesce(days, F.lit(default_days))
    iso = F.when(code.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(code, 1, 10)).cast("timestamp_ntz"))
    return F.coalesce(iso, as_of - F.make_dt_interval(days))


def amount_to_points(amount: Column, price: Column) -> Column:
    return F.floor((amount * price / 0.01).cast("double")).cast("long")


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar functions for SQL users; Catalyst inlines them."""
    periods = "map(" + ", ".join(f"'{code}', {days}" for code, days in PERIOD_DAYS.items()) + ")"
    bodies = {
        "detect_language(t STRING)": ("STRING", r"CASE WHEN coalesce(length(regexp_replace(t, r'[^\p{L}]', '')), 0) = 0 THEN 'unknown' WHEN length(regexp_replace(t, r'[^\x{0400}-\x{04FF}]', '')) / length(regexp_replace(t, r'[^\p{L}]', '')) >= 0.30 THEN 'ru' ELSE 'en' END"),
        "hashtags_of(t STRING)": ("ARRAY<STRING>", r"CASE WHEN size(regexp_extract_all(t, r'#([\p{L}\p{N}_]+)', 1)) > 0 THEN regexp_extract_all(t, r'#([\p{L}\p{N}_]+)', 1) END"),
        "dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> double(x) * y), 0D, (s, x) -> s + x)"),
        "count_tokens(t STRING)": ("BIGINT", r"CAST(coalesce(regexp_count(t, r'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), 0) AS BIGINT)"),
        "content_score(t STRING)": ("DOUBLE", "least(CAST(length(t) AS DOUBLE) / 100, 5.0D)"),
        "days_cutoff(d INT, as_of TIMESTAMP_NTZ)": ("TIMESTAMP_NTZ", "as_of - make_dt_interval(d)"),
        "period_to_cutoff(code STRING, as_of TIMESTAMP_NTZ)": ("TIMESTAMP_NTZ", f"CASE WHEN code RLIKE r'^\\d{{4}}-\\d{{2}}-\\d{{2}}' THEN CAST(try_to_timestamp(substring(code, 1, 10)) AS TIMESTAMP_NTZ) ELSE as_of - make_dt_interval(coalesce(element_at({periods}, lower(code)), try_cast(regexp_extract(lower(code), r'^(\\d{{1,4}})d$', 1) AS INT))) END"),
        "thread_uuid(domain_id BIGINT, root_id BIGINT)": ("STRING", f"element_at(transform(array(sha1(concat(unhex('{THREAD_NAMESPACE.replace('-', '')}'), CAST(concat_ws('_', domain_id, root_id) AS BINARY)))), h -> concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), concat('5', substring(h, 14, 3)), concat(substring('89ab', CAST(conv(substring(h, 17, 1), 16, 10) AS INT) % 4 + 1, 1), substring(h, 18, 3)), substring(h, 21, 12))), 1)"),
    }
    for head, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
