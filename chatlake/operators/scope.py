"""Domains, groups and memberships: scopes, joins and due rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..sources.fixtures import AS_OF, cte, duck_sql, spark_sql, table, view
from .clean import now


def scope_filter(domains: DataFrame, groups: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """Domains of a scope: all, @name, folder:Name or an id. An unknown one is an error that lists what exists."""
    if scope == "all":
        return domains
    if scope.startswith("@"):
        found = domains.where(F.lower("channel_username") == scope[1:].lower())
    elif scope.startswith("folder:"):
        own = groups.where(F.lower("name") == scope[7:].lower()).select("group_id")
        found = domains.join(members.join(own, "group_id").select("domain_id"), "domain_id", "left_semi")
    else:
        found = domains.where(F.col("domain_id").cast("string") == scope)
    if not found.take(1):
        known = [r[0] for r in groups.select(F.concat(F.lit("folder:"), "name")).limit(20).collect()] + [f"@{r[0]}" for r in domains.select("channel_username").limit(20).collect()]
        raise ValueError(f"unknown scope {scope!r}; there are: all, {', '.join(known)}")
    return found


def _three(spark, sf_dir):
    return view(spark, sf_dir, "domains"), view(spark, sf_dir, "grps"), view(spark, sf_dir, "members")


@query("n2_scope_filter", cte("domains", "grps", "members") + " SELECT domain_id FROM domains WHERE domain_id IN (SELECT domain_id FROM members JOIN grps USING (group_id) WHERE lower(name) = 'asia')")
def n2(spark, sf_dir):
    return scope_filter(*_three(spark, sf_dir), "folder:Asia").select("domain_id")


def list_scopes(domains: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """scope, label, n_channels, n_messages and the sorted names of the channels of every valid scope (none for all of them)."""
    whole = domains.agg(F.lit("all").alias("scope"), F.lit("Everything").alias("label"), F.count("*").alias("n_channels"), F.sum("message_count").alias("n_messages"), F.array().cast("array<string>").alias("channels"))
    folders = members.join(groups, "group_id").join(domains, "domain_id").groupBy("group_id", "name").agg(F.count("*").alias("n_channels"), F.sum("message_count").alias("n_messages"), F.array_sort(F.collect_list("channel_username")).alias("channels")).select(F.concat(F.lit("folder:"), "name").alias("scope"), F.col("name").alias("label"), "n_channels", "n_messages", "channels")
    single = domains.select(F.concat(F.lit("@"), "channel_username").alias("scope"), F.col("channel_username").alias("label"), F.lit(1).cast("long").alias("n_channels"), F.col("message_count").alias("n_messages"), F.array("channel_username").alias("channels"))
    return whole.unionByName(folders).unionByName(single)


@query("n3_list_scopes", cte("domains", "grps", "members") + " SELECT 'all' AS scope, 'Everything' AS label, count(*) AS n_channels, CAST(sum(message_count) AS BIGINT) AS n_messages, '' AS channels FROM domains UNION ALL SELECT 'folder:' || name, name, count(*), CAST(sum(message_count) AS BIGINT), string_agg(channel_username, ',' ORDER BY channel_username) FROM members JOIN grps USING (group_id) JOIN domains USING (domain_id) GROUP BY group_id, name UNION ALL SELECT '@' || channel_username, channel_username, 1, message_count, channel_username FROM domains")
def n3(spark, sf_dir):
    return list_scopes(*_three(spark, sf_dir)).withColumn("channels", F.array_join("channels", ","))


def due_channels(domains: DataFrame, as_of: Column) -> DataFrame:
    return domains.where(F.col("is_active") & (F.col("next_sync_at") <= as_of))


def due_digests(configs: DataFrame, as_of: Column, hours: int = 20) -> DataFrame:
    """Active configs of this hour, never sent or sent more than `hours` ago."""
    old = F.col("last_sent_at").isNull() | (F.col("last_sent_at") < as_of - F.make_dt_interval(hours=F.lit(hours)))
    return configs.where(F.col("is_active") & (F.col("send_hour") == F.hour(as_of)) & old)


_CONFIGS = "SELECT c_custkey AS config_id, c_custkey % 10 <> 0 AS is_active, CAST(c_custkey % 3 AS INT) AS send_hour, CASE WHEN c_custkey % 4 > 0 THEN sec(2678400 - c_custkey % 100 * 3600) END AS last_sent_at FROM customer"


@query("n13_due_rows", cte("domains") + f", configs AS ({duck_sql(_CONFIGS)}) SELECT 'channel' AS kind, domain_id AS id FROM domains WHERE is_active AND next_sync_at <= TIMESTAMP '{AS_OF}' UNION ALL SELECT 'digest', config_id FROM configs WHERE is_active AND send_hour = 0 AND (last_sent_at IS NULL OR last_sent_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 HOURS)")
def n13(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("given_customer")
    configs = spark.sql(spark_sql(_CONFIGS).replace("FROM customer", "FROM given_customer"))
    channels = due_channels(view(spark, sf_dir, "domains"), now()).select(F.lit("channel").alias("kind"), F.col("domain_id").alias("id"))
    return channels.union(due_digests(configs, now()).select(F.lit("digest"), F.col("config_id").cast("long")))


def needs_processing(domains: DataFrame, messages: DataFrame, schemas: DataFrame, entities: DataFrame) -> DataFrame:
    """Active domains with messages and either no active schema or no entities yet."""
    n = lambda df, name: df.groupBy("domain_id").agg(F.count("*").alias(name))
    out = domains.where("is_active").join(n(messages, "n_messages"), "domain_id").join(n(schemas.where("is_active"), "n_schemas"), "domain_id", "left").join(n(entities, "n_entities"), "domain_id", "left")
    return out.where(F.col("n_schemas").isNull() | F.col("n_entities").isNull())


@query("n14_needs_processing", cte("messages", "domains", "entities") + " SELECT domain_id, CAST((SELECT count(*) FROM messages m WHERE m.domain_id = d.domain_id) AS BIGINT) AS n_messages FROM domains d WHERE is_active AND (SELECT count(*) FROM messages m WHERE m.domain_id = d.domain_id) > 0 AND (d.domain_id % 2 = 0 OR (SELECT count(*) FROM entities e WHERE e.domain_id = d.domain_id) = 0)")
def n14(spark, sf_dir):
    d = view(spark, sf_dir, "domains")
    schemas = d.where("domain_id % 2 = 1").select("domain_id", F.lit(True).alias("is_active"))
    return needs_processing(d, view(spark, sf_dir, "messages"), schemas, view(spark, sf_dir, "entities")).select("domain_id", "n_messages")


def group_members(domains: DataFrame, members: DataFrame, group_id: int) -> DataFrame:
    return domains.join(members.where(F.col("group_id") == group_id).select("domain_id"), "domain_id")


@query("j1_group_members", cte("domains", "members") + " SELECT domain_id, channel_username FROM domains JOIN members USING (domain_id) WHERE group_id = 2")
def j1(spark, sf_dir):
    d, _, m = _three(spark, sf_dir)
    return group_members(d, m, 2).select("domain_id", "channel_username")


def grouped_domains(domains: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Domains in at least one active group."""
    return domains.join(members.join(groups.where("is_active"), "group_id").select("domain_id"), "domain_id", "left_semi")


@query("j2_grouped_domains", cte("domains", "grps", "members") + " SELECT DISTINCT d.domain_id FROM domains d JOIN members m USING (domain_id) JOIN grps g USING (group_id) WHERE g.is_active AND d.owner_id = 5")
def j2(spark, sf_dir):
    d, g, m = _three(spark, sf_dir)
    return grouped_domains(d.where("owner_id = 5"), g, m).select("domain_id")


@query("j3_exclusively_grouped", cte("domains", "grps", "members") + " SELECT DISTINCT d.domain_id FROM domains d JOIN members m USING (domain_id) JOIN grps g USING (group_id) WHERE g.is_active AND d.pinned IS NOT TRUE")
def j3(spark, sf_dir):
    d, g, m = _three(spark, sf_dir)
    return exclusively_grouped(d, g, m).select("domain_id")


def exclusively_grouped(domains: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    return grouped_domains(domains.where(~F.coalesce("pinned", F.lit(False))), groups, members)


def standalone_domains(domains: DataFrame, members: DataFrame) -> DataFrame:
    return domains.join(members, "domain_id", "left_anti")


@query("j4_standalone_domains", cte("domains", "members") + " SELECT domain_id FROM domains WHERE domain_id NOT IN (SELECT domain_id FROM members)")
def j4(spark, sf_dir):
    d, _, m = _three(spark, sf_dir)
    return standalone_domains(d, m).select("domain_id")


def conversations_with_domain(conversations: DataFrame, domains: DataFrame, most: int) -> DataFrame:
    return conversations.join(domains.select("domain_id", "channel_username"), "domain_id", "left").orderBy(F.desc("updated_at"), F.desc("conv_id")).limit(most)


@query("j5_conversations_with_domain", cte("messages", "domains") + ", c AS (SELECT msg_id // 100 AS conv_id, min(domain_id) AS domain_id, max(msg_date) AS updated_at FROM messages GROUP BY 1) SELECT conv_id, channel_username, updated_at FROM c LEFT JOIN domains USING (domain_id) ORDER BY updated_at DESC, conv_id DESC LIMIT 20")
def j5(spark, sf_dir):
    c = view(spark, sf_dir, "messages").groupBy(F.floor(F.col("msg_id") / 100).alias("conv_id")).agg(F.min("domain_id").alias("domain_id"), F.max("msg_date").alias("updated_at"))
    return conversations_with_domain(c, view(spark, sf_dir, "domains"), 20).select("conv_id", "channel_username", "updated_at")


def source_rollup(domains: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Per folder: channels and messages, folders without channels included."""
    inside = members.join(domains.select("domain_id", "message_count"), "domain_id")
    per = inside.groupBy("group_id").agg(F.count("*").alias("n_channels"), F.sum(F.coalesce("message_count", F.lit(0))).alias("n_messages"))
    return groups.join(per, "group_id", "left").select("group_id", "name", F.coalesce("n_channels", F.lit(0)).alias("n_channels"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


@query("a4_source_rollup", cte("domains", "grps", "members") + " SELECT g.group_id, g.name, count(d.domain_id) AS n_channels, CAST(coalesce(sum(d.message_count), 0) AS BIGINT) AS n_messages FROM grps g LEFT JOIN members m USING (group_id) LEFT JOIN domains d USING (domain_id) GROUP BY 1, 2")
def a4(spark, sf_dir):
    return source_rollup(*_three(spark, sf_dir))


def bulk_add_members(members: DataFrame, wanted: DataFrame, domains: DataFrame) -> DataFrame:
    """Insert-ignore: (group_id, domain_id) with status added or present; domains that do not exist are created."""
    w = wanted.distinct()
    known = members.select("group_id", "domain_id", F.lit(True).alias("_in"))
    exists = domains.select("domain_id", F.lit(True).alias("_dom"))
    return w.join(known, ["group_id", "domain_id"], "left").join(exists, "domain_id", "left").select("group_id", "domain_id", F.when(F.col("_in"), "present").otherwise("added").alias("status"), F.col("_dom").isNull().alias("new_domain"))


@query("m11_bulk_add_members", cte("members", "domains") + ", w AS (SELECT DISTINCT CAST(o_custkey % 5 AS BIGINT) AS group_id, CAST(o_custkey + 700 AS BIGINT) AS domain_id FROM orders) SELECT w.group_id, w.domain_id, CASE WHEN m.domain_id IS NOT NULL THEN 'present' ELSE 'added' END AS status, d.domain_id IS NULL AS new_domain FROM w LEFT JOIN members m ON m.group_id = w.group_id AND m.domain_id = w.domain_id LEFT JOIN domains d ON d.domain_id = w.domain_id")
def m11(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("long").alias("group_id"), (F.col("o_custkey") + 700).cast("long").alias("domain_id"))
    return bulk_add_members(view(spark, sf_dir, "members"), w, view(spark, sf_dir, "domains"))


def delete_domain(tables: dict[str, DataFrame], gone: DataFrame, keep_with_null: tuple[str, ...] = ("conversations",)) -> dict[str, DataFrame]:
    """Every table without the gone domains' rows; in keep_with_null their domain becomes null."""
    mark = gone.select("domain_id", F.lit(True).alias("_gone")).distinct()
    out = {}
    for name, df in tables.items():
        if name in keep_with_null:
            out[name] = df.join(mark, "domain_id", "left").withColumn("domain_id", F.when(F.col("_gone").isNull(), F.col("domain_id"))).drop("_gone")
        else:
            out[name] = df.join(mark, "domain_id", "left_anti")
    return out


@query("m8_delete_domain", cte("messages", "entities") + " SELECT 'messages' AS child, domain_id, count(*) AS n FROM messages WHERE domain_id NOT IN (2, 5) GROUP BY 2 UNION ALL SELECT 'entities', domain_id, count(*) FROM entities WHERE domain_id NOT IN (2, 5) GROUP BY 2 UNION ALL SELECT 'conversations', CASE WHEN conv_id % 7 NOT IN (2, 5) THEN conv_id % 7 END, count(*) FROM conversations GROUP BY 2")
def m8(spark, sf_dir):
    gone = view(spark, sf_dir, "domains").where("domain_id in (2, 5)")
    tables = {"messages": view(spark, sf_dir, "messages"), "entities": view(spark, sf_dir, "entities"), "conversations": table(spark, sf_dir, "conversations").withColumn("domain_id", F.col("conv_id") % 7)}
    left = delete_domain(tables, gone)
    parts = [df.groupBy("domain_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("child"), "domain_id", "n") for k, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


def last_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


@query("w6_last_row_per_key", cte("runs", "chat") + " SELECT 'run' AS kind, config_id AS k, max_by(run_id, (completed_at, run_id)) AS v FROM runs GROUP BY config_id UNION ALL SELECT 'turn', conv_id, max(turn) FROM chat GROUP BY conv_id")
def w6(spark, sf_dir):
    # one aggregate per key: no sort of the whole group is needed
    runs = view(spark, sf_dir, "runs").groupBy("config_id").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("v")).select(F.lit("run").alias("kind"), F.col("config_id").alias("k"), "v")
    return runs.union(view(spark, sf_dir, "chat").groupBy("conv_id").agg(F.max("turn").alias("v")).select(F.lit("turn"), "conv_id", "v"))


def schema_history(log: DataFrame) -> DataFrame:
    """Arrivals (domain_id, arrived, ...) -> version by arrival and is_active for the newest."""
    w = W.partitionBy("domain_id").orderBy("arrived")
    newest = W.partitionBy("domain_id").orderBy(F.desc("arrived"))
    return log.withColumn("version", F.row_number().over(w).cast("long")).withColumn("is_active", F.row_number().over(newest) == 1)


_SCHEMAS = "SELECT CAST(o_custkey AS BIGINT) AS domain_id, CAST(o_orderkey AS BIGINT) AS arrived FROM {}orders"


@query("w7_schema_version", f"WITH s AS ({_SCHEMAS.format('')}) SELECT domain_id, arrived, row_number() OVER (PARTITION BY domain_id ORDER BY arrived) AS version, row_number() OVER (PARTITION BY domain_id ORDER BY arrived DESC) = 1 AS is_active FROM s")
def w7(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("given_orders")
    return schema_history(spark.sql(_SCHEMAS.format("given_")))


@query("m3_schema_history", f"WITH s AS ({_SCHEMAS.format('')}), n AS (SELECT domain_id, count(*) AS version, max(arrived) AS arrived FROM s GROUP BY 1) SELECT domain_id, version, arrived FROM n ")
def m3(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("given_orders")
    return schema_history(spark.sql(_SCHEMAS.format("given_"))).where("is_active").select("domain_id", "version", "arrived")


def merge_schemas(schemas: DataFrame) -> DataFrame:
    """(rank, domain, types array<struct<name, description>>) -> distinct types by name, first wins, in order."""
    rows = schemas.select("rank", F.posexplode("types").alias("pos", "t")).select("rank", "pos", "t.*")
    return last_row(rows, ["name"], F.col("rank"), F.col("pos"))


def merged_name(schemas: DataFrame) -> DataFrame:
    """The domains' names joined; a scope has a few domains."""
    return schemas.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "domain"))), lambda x: x["domain"]), " + ").alias("name"))


@query("d5_merge_schemas", "WITH p AS (SELECT n_regionkey AS rank, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, concat('type_', n_nationkey % 7) AS name, n_name AS description FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, pos) AS rn FROM p) SELECT name, description, (SELECT string_agg(r_name, ' + ' ORDER BY r_regionkey) FROM region) AS merged FROM k WHERE rn = 1")
def d5(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    types = n.groupBy(F.col("n_regionkey").alias("rank")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("type_"), F.col("n_nationkey") % 7).alias("name"), F.col("n_name").alias("description")))).alias("types"))
    schemas = types.join(r.select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("domain")), "rank")
    return merge_schemas(schemas).select("name", "description", F.lit(merged_name(schemas).first()[0]).alias("merged"))


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run with the latest completed run of its config strictly before it."""
    w = W.partitionBy("config_id").orderBy("completed_at").rangeBetween(W.unboundedPreceding, -1)
    done = F.when(F.col("status") == "completed", F.col("run_id"))
    by_day = runs.withColumn("completed_at", F.unix_seconds(F.col("completed_at").cast("timestamp")))
    return by_day.withColumn("previous", F.max(F.when(F.col("status") == "completed", F.struct(F.col("completed_at"), done))).over(w)["col2"])


@query("j7_previous_run", cte("runs") + " SELECT r.run_id, (SELECT max_by(p.run_id, (p.completed_at, p.run_id)) FROM runs p WHERE p.config_id = r.config_id AND p.status = 'completed' AND p.completed_at < r.completed_at) AS previous FROM runs r")
def j7(spark, sf_dir):
    return previous_run(view(spark, sf_dir, "runs")).select("run_id", "previous")
