"""The entity-relation graph as two tables."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..sources.fixtures import cte, view
from ..sources.tables import written
from .tables import top_per_key

ENTITY, RELATION = ["domain_id", "name"], ["domain_id", "source", "target", "type"]


def merge_graph(old_e: DataFrame, new_e: DataFrame, old_r: DataFrame, new_r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserts: the last write wins on attributes; a relation's missing endpoints become entities of type Unknown."""
    tagged = old_e.withColumn("_b", F.lit(0)).unionByName(new_e.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    attributes = [c for c in tagged.columns if c not in [*ENTITY, "_b"]]
    last = tagged.groupBy(*ENTITY).agg(F.max_by(F.struct(*attributes), F.struct("_b", *[c for c in ("confidence", "type") if c in attributes])).alias("a")).select(*ENTITY, "a.*")
    relations = old_r.unionByName(new_r, allowMissingColumns=True).dropDuplicates(RELATION)
    ends = relations.select("domain_id", F.col("source").alias("name")).union(relations.select("domain_id", "target")).distinct()
    missing = ends.join(last, ENTITY, "left_anti").withColumn("type", F.lit("Unknown"))
    return last.unionByName(missing, allowMissingColumns=True), relations


def _merged(spark, sf_dir):
    e, r = view(spark, sf_dir, "entities"), view(spark, sf_dir, "relations")
    return merge_graph(e, e.withColumn("type", F.lit("Firm")).where("confidence >= 0.5"), r.where("type = 'A'"), r)


_G1 = cte("entities", "relations") + ", e1 AS (SELECT domain_id, name, CASE WHEN confidence >= 0.5 THEN 'Firm' ELSE type END AS type, confidence FROM entities), ends AS (SELECT domain_id, source AS name FROM relations UNION SELECT domain_id, target FROM relations), ents AS (SELECT domain_id, name, type, confidence FROM e1 UNION ALL SELECT domain_id, name, 'Unknown', NULL FROM ends WHERE (domain_id, name) NOT IN (SELECT (domain_id, name) FROM e1))"


@query("g1_merge_graph", _G1 + " SELECT domain_id, name, type, confidence FROM ents")
def g1(spark, sf_dir):
    return _merged(spark, sf_dir)[0].select("domain_id", "name", "type", "confidence")


def symmetric(relations: DataFrame) -> DataFrame:
    pairs = relations.select("domain_id", F.col("source").alias("a"), F.col("target").alias("b"))
    return pairs.union(pairs.select("domain_id", "b", "a")).where("a <> b").distinct()


def multiplied(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Their inner join, for keys of which both sides hold many rows: it is cut into tasks by the number of its rows. A key is a grid: its left rows are
    dealt to lines, its right rows to columns, and a row is copied along its line or column only. So what is shuffled grows with the root of the join's rows."""
    counts = [df.groupBy(*on).agg(F.count("*").alias(n)) for df, n in ((left, "_left"), (right, "_right"))]
    sizes = written(counts[0].join(counts[1], on).withColumn("_made", F.col("_left").cast("double") * F.col("_right")), "join-sizes")
    made = sizes.agg(F.sum("_made")).first()[0] or 0
    if made < TASK_ROWS:
        return left.join(right, on)
    parts = F.ceil(F.col("_made") / max(TASK_ROWS, made / MOST_PARTS))
    columns = F.greatest(F.round(F.sqrt(parts * F.col("_right") / F.col("_left"))), F.ceil(F.col("_right") / COLUMN_ROWS), F.lit(1)).cast("int")
    grid = sizes.select(*on, parts.alias("_parts"), columns.alias("_columns")).withColumn("_lines", F.ceil(F.col("_parts") / F.col("_columns")).cast("int"))
    # at most MOST_PARTS keys have several parts by their rows, and one for each COLUMN_ROWS right rows by those
    grid = F.broadcast(grid.where("_columns > 1 OR _lines > 1").drop("_parts"))
    lines, columns = (F.coalesce(c, F.lit(1)) for c in ("_lines", "_columns"))
    tasks = min(MOST_TASKS, int(made // TASK_ROWS) + 1)

    def dealt(df: DataFrame, to, along) -> DataFrame:
        own = [c for c in df.columns if c not in on] or on
        return df.join(grid, on, "left").select(*df.columns, columns.alias("_columns"), F.pmod(F.xxhash64(*own), to).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), along - 1)).alias("_other"))

    def placed(df: DataFrame, line: str, column: str) -> DataFrame:
        return df.withColumn("_part", F.col(line) * F.col("_columns") + F.col(column)).drop("_columns", "_own", "_other").repartition(tasks, *on, "_part")

    return placed(dealt(left, lines, columns), "_own", "_other").join(placed(dealt(right, columns, lines), "_other", "_own"), [*on, "_part"]).drop("_part")


#: Result rows that a join of many by many rows gives a task, about; its tasks, and parts of its keys, at most, about; right rows of a key that a task holds, about.
TASK_ROWS, MOST_TASKS, MOST_PARTS, COLUMN_ROWS = 4_000_000, 2000, 4000, 10_000


def twins(edges: DataFrame) -> DataFrame:
    """(domain_id, name, kind): names with the same neighbours have the same kind, the number and two 64-bit sums of their hashes."""
    kind = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("b")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "b")).alias("h2"))
    return edges.groupBy("domain_id", F.col("a").alias("name")).agg(kind.alias("kind"))


def neighbors(relations: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(domain_id, start, name): distinct undirected neighbours within depth hops, the start excluded.

    Names with the same neighbours reach, and are reached by, the same names. So hops are made between kinds of names, and only the
    result has a row for each pair of names.
    """
    edges = written(symmetric(relations), "neighbor-edges")
    nodes = written(twins(edges), "neighbor-kinds")
    asked = written(starts.select("domain_id", F.col("name").alias("start")).distinct().join(nodes.withColumnRenamed("name", "start"), ["domain_id", "start"]), "neighbor-starts")
    first = nodes.groupBy("domain_id", F.col("kind").alias("at")).agg(F.min("name").alias("a"))
    steps = written(edges.join(first, ["domain_id", "a"]).join(nodes.select("domain_id", F.col("name").alias("b"), F.col("kind").alias("to")), ["domain_id", "b"]).select("domain_id", "at", "to").distinct(), "neighbor-steps")
    front, seen = asked.select("domain_id", "kind", F.col("kind").alias("at")).distinct(), None
    for _ in range(depth):
        front = front.join(steps, ["domain_id", "at"]).select("domain_id", "kind", F.col("to").alias("at")).distinct()
        front = front if seen is None else front.join(seen, ["domain_id", "kind", "at"], "left_anti")
        seen = written(front if seen is None else seen.unionByName(front), "neighbor-reach")
    reach = asked.join(seen, ["domain_id", "kind"]).select("domain_id", "start", "at") if seen is not None else asked.select("domain_id", "start", F.col("kind").alias("at")).limit(0)
    return multiplied(reach, nodes.select("domain_id", F.col("kind").alias("at"), "name"), ["domain_id", "at"]).where("name <> start").select("domain_id", "start", "name")


@query("g2_neighbors", cte("entities", "relations") + ", ed AS (SELECT domain_id, source AS a, target AS b FROM relations UNION SELECT domain_id, target, source FROM relations), st AS (SELECT domain_id, name FROM entities WHERE type = 'Vendor'), h1 AS (SELECT DISTINCT ed.domain_id, name AS start, b FROM st JOIN ed ON ed.domain_id = st.domain_id AND a = name), h2 AS (SELECT DISTINCT h1.domain_id, start, ed.b FROM h1 JOIN ed ON ed.domain_id = h1.domain_id AND ed.a = h1.b) SELECT domain_id, start, b AS name FROM (SELECT * FROM h1 UNION SELECT * FROM h2) WHERE b <> start")
def g2(spark, sf_dir):
    return neighbors(view(spark, sf_dir, "relations"), view(spark, sf_dir, "entities").where("type = 'Vendor'"))


def relations_of(relations: DataFrame, names: DataFrame) -> DataFrame:
    """All relations that touch an entity, which is always reported as the source."""
    turned = relations.select("domain_id", F.col("target").alias("source"), F.col("source").alias("target"), "type").where("source <> target")
    return relations.select("domain_id", "source", "target", "type").union(turned).join(names.select("domain_id", F.col("name").alias("source")).distinct(), ["domain_id", "source"], "left_semi")


@query("g3_relations_of", cte("relations") + " SELECT domain_id, source, target, type FROM (SELECT * FROM relations UNION ALL SELECT domain_id, target, source, type FROM relations) WHERE source = 'Part#7'")
def g3(spark, sf_dir):
    r = view(spark, sf_dir, "relations")
    return relations_of(r, r.select("domain_id", F.lit("Part#7").alias("name")))


def entities_of(entities: DataFrame, domain_id: int, kind: str | None = None, names: list[str] | None = None) -> DataFrame:
    out = entities.where(F.col("domain_id") == domain_id)
    out = out.where(F.col("type") == kind) if kind else out
    return out.where(F.col("name").isin(names)) if names is not None else out


@query("g4_entities_of", cte("entities") + " SELECT name, type FROM entities WHERE domain_id = 3 AND type = 'Supplier'")
def g4(spark, sf_dir):
    return entities_of(view(spark, sf_dir, "entities"), 3, "Supplier").select("name", "type")


@query("a3_entity_counts", _G1 + " SELECT type, count(*) AS n_entities FROM ents GROUP BY type")
def a3(spark, sf_dir):
    return entity_counts(_merged(spark, sf_dir)[0])


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n_entities"))


def louvain(edges: DataFrame) -> DataFrame:
    """(domain_id, a, b, w) undirected, each pair once -> (domain_id, name, community), by modularity moves in joins.

    In every round half of the nodes (by hash) move to the neighbouring community of the largest gain; a level's communities are
    the next level's nodes. A level ends when a pair of rounds no longer raises the modularity, the whole when a level merges nothing.
    Each round's labels are written to the shared folder.
    """
    member, graph = None, edges
    while True:
        both = written(graph.select("domain_id", "a", "b", "w").union(graph.select("domain_id", F.col("b"), F.col("a"), "w")), "louvain-edges")
        degree = written(both.groupBy("domain_id", "a").agg(F.sum("w").alias("k")), "louvain-degrees")
        total = degree.groupBy("domain_id").agg(F.sum("k").alias("m2"))
        labels = best_labels = degree.select("domain_id", "a", F.col("a").alias("c"))
        reached, turn = modularity(both, degree, total, labels), 0
        while True:
            new = written(moved(both, degree, total, labels, turn), "louvain-labels")
            labels, turn = new.select("domain_id", "a", "c"), turn + 1
            if turn % 2 == 0:
                now = modularity(both, degree, total, labels)
                if now <= reached + 1e-9:
                    break
                reached, best_labels = now, labels
        labels = refined(both, best_labels)
        member = labels.select("domain_id", F.col("a").alias("name"), F.col("c").alias("community")) if member is None else written(member.join(labels.select("domain_id", F.col("a").alias("community"), F.col("c").alias("up")), ["domain_id", "community"]).select("domain_id", "name", F.col("up").alias("community")), "louvain-members")
        if not labels.where("a <> c").take(1):
            return member
        la = labels.select("domain_id", "a", F.col("c").alias("ca"))
        lb = labels.select("domain_id", F.col("a").alias("b"), F.col("c").alias("cb"))
        graph = graph.join(la, ["domain_id", "a"]).join(lb, ["domain_id", "b"]).groupBy("domain_id", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def refined(both: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with each community cut into what its own edges connect, named after the smallest node: nodes that moved on may have left the
    others without a link. Cutting such a community apart can only raise the modularity."""
    la, lb = labels.select("domain_id", "a", F.col("c").alias("ca")), labels.select("domain_id", F.col("a").alias("b"), F.col("c").alias("cb"))
    inner = written(both.where("a <> b").join(la, ["domain_id", "a"]).join(lb, ["domain_id", "b"]).where("ca = cb").select("domain_id", "a", "b"), "louvain-inner")
    now = labels.select("domain_id", "a", F.col("a").alias("c"))
    while True:
        near = inner.join(now.select("domain_id", F.col("a").alias("b"), F.col("c").alias("near")), ["domain_id", "b"]).groupBy("domain_id", "a").agg(F.min("near").alias("near"))
        low = now.join(near, ["domain_id", "a"], "left").select("domain_id", "a", F.col("c").alias("old"), F.least("c", F.coalesce("near", "c")).alias("c"))
        far = now.select("domain_id", F.col("a").alias("c"), F.col("c").alias("far"))  # a node takes the label that its label had
        new = written(low.join(far, ["domain_id", "c"], "left").select("domain_id", "a", "old", F.least("c", F.coalesce("far", "c")).alias("c")), "louvain-parts")
        now = new.select("domain_id", "a", "c")
        if not new.where("old <> c").take(1):
            return now


def modularity(both: DataFrame, degree: DataFrame, total: DataFrame, labels: DataFrame) -> float:
    """Sum of all domains' modularities; both: each edge in either direction."""
    la, lb = labels.withColumnRenamed("c", "ca"), labels.select("domain_id", F.col("a").alias("b"), F.col("c").alias("cb"))
    inside = both.join(la, ["domain_id", "a"]).join(lb, ["domain_id", "b"]).where("ca = cb").groupBy("domain_id").agg(F.sum("w").alias("inner"))
    spread = labels.join(degree, ["domain_id", "a"]).groupBy("domain_id", "c").agg(F.sum("k").alias("tot")).groupBy("domain_id").agg(F.sum(F.col("tot") * F.col("tot")).alias("sq"))
    q = F.coalesce("inner", F.lit(0.0)) / F.col("m2") - F.col("sq") / (F.col("m2") * F.col("m2"))
    return total.join(spread, "domain_id").join(inside, "domain_id", "left").agg(F.sum(q)).first()[0] or 0.0


def moved(both: DataFrame, degree: DataFrame, total: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Labels after half of the nodes, those of this turn, have moved to their best neighbouring community."""
    named = labels.join(degree, ["domain_id", "a"])
    sizes = named.groupBy("domain_id", "c").agg(F.sum("k").alias("tot"))
    to = both.where("a <> b").join(labels.select("domain_id", F.col("a").alias("b"), F.col("c").alias("to")), ["domain_id", "b"]).groupBy("domain_id", "a", "to").agg(F.sum("w").alias("k_in"))
    own = named.select("domain_id", "a", F.col("c").alias("to"), F.lit(0.0).alias("k_in"))
    options = to.unionByName(own).groupBy("domain_id", "a", "to").agg(F.sum("k_in").alias("k_in"))
    judged = options.join(named, ["domain_id", "a"]).join(sizes.withColumnRenamed("c", "to"), ["domain_id", "to"]).join(total, "domain_id")
    rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("k_in") - F.col("k") * rest / F.col("m2"), 9)
    best = judged.groupBy("domain_id", "a").agg(F.max_by("to", F.struct(gain, (F.col("to") == F.col("c")).cast("int"), "to")).alias("to"), F.first("c").alias("c"))
    moves = F.pmod(F.xxhash64("a", F.lit(turn // 2)), F.lit(2)) == turn % 2
    return best.select("domain_id", "a", F.when(moves, F.col("to")).otherwise(F.col("c")).alias("c"))


def communities(relations: DataFrame, least: int = 3) -> DataFrame:
    """(domain_id, community_id, name): communities of at least so many members, named after their smallest member."""
    edges = symmetric(relations).where("a < b").withColumn("w", F.lit(1.0))
    found = written(louvain(edges), "communities")
    sizes = found.groupBy("domain_id", "community").agg(F.count("*").alias("n"), F.min("name").alias("community_id")).where(F.col("n") >= least)
    return found.join(sizes, ["domain_id", "community"]).select("domain_id", "community_id", "name")


@query("g5_communities")
def g5(spark, sf_dir):
    return communities(view(spark, sf_dir, "relations"))


_COMM = "SELECT DISTINCT domain_id, concat('c', type) AS community_id, source AS name FROM {}"


def community_of(memberships: DataFrame, summaries: DataFrame, names: DataFrame) -> DataFrame:
    return memberships.join(names, ["domain_id", "name"], "left_semi").join(summaries, ["domain_id", "community_id"])


@query("g6_community_of", cte("relations", "entities") + f", mb AS ({_COMM.format('relations')}) SELECT mb.domain_id, mb.name, community_id, concat('summary ', community_id) AS summary, 0 AS level FROM mb JOIN entities USING (domain_id, name) WHERE entities.type = 'Vendor'")
def g6(spark, sf_dir):
    mb = view(spark, sf_dir, "relations").select("domain_id", F.concat(F.lit("c"), "type").alias("community_id"), F.col("source").alias("name")).distinct()
    summaries = mb.select("domain_id", "community_id").distinct().withColumn("summary", F.concat(F.lit("summary "), "community_id")).withColumn("level", F.lit(0))
    return community_of(mb, summaries, view(spark, sf_dir, "entities").where("type = 'Vendor'")).select("domain_id", "name", "community_id", "summary", "level")


def community_brief(memberships: DataFrame, relations: DataFrame, members: int = 30, sources: int = 15, lines: int = 30) -> DataFrame:
    """Per community its first members, and internal relations of its first ones, as text for a summary."""
    ranked = top_per_key(memberships, ["domain_id", "community_id"], members, F.col("name"))
    m = ranked.groupBy("domain_id", "community_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("members"))
    src = ranked.where(F.col("rank") <= sources).select("domain_id", "community_id", F.col("name").alias("source"))
    inner = relations.join(src, ["domain_id", "source"]).join(memberships.select("domain_id", "community_id", F.col("name").alias("target")), ["domain_id", "community_id", "target"])
    kept = top_per_key(inner, ["domain_id", "community_id"], lines, F.col("source"), F.col("target"), F.col("type"))
    text = kept.groupBy("domain_id", "community_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "type", "target"))), "\n").alias("relations"))
    return m.join(text, ["domain_id", "community_id"], "left")


@query("g7_community_brief", cte("relations") + ", mb AS (SELECT DISTINCT domain_id, 'all' AS community_id, source AS name FROM relations UNION SELECT domain_id, 'all', target FROM relations), rk AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY name) AS rank FROM mb), m AS (SELECT domain_id, string_agg(name, ', ' ORDER BY name) AS members FROM rk WHERE rank <= 30 GROUP BY 1), i AS (SELECT r.*, row_number() OVER (PARTITION BY r.domain_id ORDER BY source, target, type) AS rn FROM relations r JOIN rk ON rk.domain_id = r.domain_id AND rk.name = r.source AND rank <= 15), t AS (SELECT domain_id, string_agg(concat_ws(' ', source, type, target), chr(10) ORDER BY concat_ws(' ', source, type, target)) AS relations FROM i WHERE rn <= 30 GROUP BY 1) SELECT m.domain_id, 'all' AS community_id, members, relations FROM m LEFT JOIN t USING (domain_id)")
def g7(spark, sf_dir):
    r = view(spark, sf_dir, "relations")
    mb = r.select("domain_id", F.col("source").alias("name")).union(r.select("domain_id", "target")).distinct().withColumn("community_id", F.lit("all"))
    return community_brief(mb, r)


def walks(relations: DataFrame, kind: str | None, least: int, most: int) -> DataFrame:
    """(domain_id, source, target), once each: names joined by a walk of `least` to `most` relations of a type (None: any)."""
    key = ["domain_id", "source", "target"]
    step = written((relations.where(F.col("type") == kind) if kind else relations).select(*key).distinct(), "walk-steps")
    front, out = step, None
    for length in range(1, most + 1):
        if length > 1:
            onward = step.select("domain_id", F.col("source").alias("target"), F.col("target").alias("next"))
            front = front.join(onward, ["domain_id", "target"]).select("domain_id", "source", F.col("next").alias("target")).distinct()
            # where any length counts, a pair that a shorter walk has reached leads nowhere new
            front = written(front.join(out, key, "left_anti") if least <= 1 else front, "walk-front")
            if not front.take(1):
                break
        if length >= least:
            out = front if out is None else written(out.unionByName(front).distinct(), "walks")
    return out if out is not None else step.limit(0)


_WALK = re.compile(r"(?P<kind>[^*]*)\*(?P<least>\d+)\.\.(?P<most>\d+)\Z")


def find(relations: DataFrame, motif: list[tuple[str, str | None, str]], product: bool = False) -> DataFrame:
    """Rows of names for a motif [(a, type, b), ...]: each triple is a relation from a to b; type None for any, "T*1..3" (or "*1..3") for a
    walk of one to three of them.

    Triples are joined along the names that they share, from the first one on; before that each is cut to the rows that have a partner in those that
    are joined after it, so that in a motif without cycles no row of a join is made in vain. Triples that share no name with
    the others multiply, which has to be asked for by `product`. A join that makes many rows of few keys is cut into tasks by its rows.
    """
    tables = []
    for a, kind, b in motif:
        walk = _WALK.match(kind or "")
        step = walks(relations, walk["kind"] or None, int(walk["least"]), int(walk["most"])) if walk else relations.where(F.col("type") == kind) if kind else relations
        step = step.where("source = target").select("domain_id", F.col("source").alias(a)) if a == b else step.select("domain_id", F.col("source").alias(a), F.col("target").alias(b))
        tables.append(step.distinct())
    # the order of joins, and of each triple the one before it that it hangs on
    order, hangs, left = [0], {}, list(range(1, len(motif)))
    while left:
        found = next(((i, j) for i in left for j in order if {motif[i][0], motif[i][2]} & {motif[j][0], motif[j][2]}), None)
        if found is None and not product:
            raise ValueError(f"{motif[left[0]]} shares no name with the triples before it")
        i = left[0] if found is None else found[0]
        if found:
            hangs[i] = found[1]
        order.append(i)
        left.remove(i)
    names = lambda i: {motif[i][0], motif[i][2]}
    for i in reversed(order[1:]):
        tables[i] = written(tables[i], "motif")
        if i in hangs:
            on = ["domain_id", *sorted(names(i) & names(hangs[i]))]
            tables[hangs[i]] = tables[hangs[i]].join(tables[i], on, "left_semi")
    if len(tables) > 1:
        tables[0] = written(tables[0], "motif")
    out, left, grown = tables[order[0]], order[1:], False
    while left:
        on = {i: ["domain_id", *[c for c in sorted(names(i)) if c in out.columns]] for i in left}
        near = [i for i in left if len(on[i]) > 1] or left[:1]
        # tables with one row a key go first: they make no row
        i = next((i for i in near if not tables[i].groupBy(*on[i]).count().where("count > 1").take(1)), None) if len(left) > 1 and not grown else None
        if i is None:
            i, plain = near[0], grown
            out, grown = out.join(tables[i], on[i]) if plain else multiplied(out, tables[i], on[i]), True
        else:
            out = out.join(tables[i], on[i])
        left.remove(i)
    return out


def places(spark, sf_dir: str) -> DataFrame:
    """Relations of customers, suppliers and nations to where they are, for motifs."""
    from ..sources.fixtures import table

    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    edge = lambda df, a, kind, b: df.select(F.lit(0).cast("long").alias("domain_id"), F.col(a).alias("source"), F.lit(kind).alias("type"), F.col(b).alias("target"))
    lives = edge(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "LIVES_IN", "n_name")
    sells = edge(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "SELLS_IN", "n_name")
    return lives.unionByName(sells).unionByName(edge(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "PART_OF", "r_name"))


_PLACES = "WITH p AS (SELECT c_name AS source, 'LIVES_IN' AS type, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, 'SELLS_IN', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'PART_OF', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("g8_star", _PLACES + " SELECT DISTINCT x.source AS c, y.source AS s, x.target AS n, z.target AS r FROM p x JOIN p y ON x.target = y.target AND x.type = 'LIVES_IN' AND y.type = 'SELLS_IN' JOIN p z ON z.source = x.target AND z.type = 'PART_OF'")
def g8_star(spark, sf_dir):
    return find(places(spark, sf_dir), [("c", "LIVES_IN", "n"), ("s", "SELLS_IN", "n"), ("n", "PART_OF", "r")]).drop("domain_id")


@query("g8_chain", _PLACES + " SELECT DISTINCT x.source AS s, x.target AS n, z.target AS r FROM p x JOIN p z ON z.source = x.target AND x.type = 'SELLS_IN'")
def g8_chain(spark, sf_dir):
    return find(places(spark, sf_dir), [("s", "SELLS_IN", "n"), ("n", None, "r")]).drop("domain_id")


@query("g8_path", _PLACES.replace("WITH ", "WITH RECURSIVE ") + ", w AS (SELECT source, target, 1 AS n FROM p UNION ALL SELECT w.source, p.target, n + 1 FROM w JOIN p ON p.source = w.target WHERE n < 3) SELECT DISTINCT source AS a, target AS b FROM w")
def g8_path(spark, sf_dir):
    return find(places(spark, sf_dir), [("a", "*1..3", "b")]).drop("domain_id")


@query("g8_graph_pattern", cte("relations") + " SELECT DISTINCT r.domain_id, r.source AS a, r.target AS b, s.source AS c FROM relations r JOIN relations s ON r.domain_id = s.domain_id AND r.target = s.target AND r.type = 'A' AND s.type = 'R'")
def g8(spark, sf_dir):
    return find(view(spark, sf_dir, "relations"), [("a", "A", "b"), ("c", "R", "b")])


#: Entities of fewer characters are not sought; bytes of names in one automaton (its nodes take about 50 times as many).
SHORT, AUTOMATON_BYTES = 3, 2_000_000


_built: dict = {}


def _automaton(key: str, names):
    """The automaton of a shard of names, (name, its lower form) each; a worker process keeps the last one."""
    import ahocorasick

    if key in _built:
        return _built[key]
    _built.clear()
    forms: dict[str, list[str]] = {}
    for name, low in zip(*(c.to_pylist() for c in names.value.columns)):
        forms.setdefault(low, []).append(name)
    found = ahocorasick.Automaton()
    for low, same in forms.items():
        found.add_word(low, tuple(same))
    found.make_automaton()
    _built[key] = found
    return found


def entities_in_text(texts: DataFrame, names: DataFrame, least: int = SHORT, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, name): names of at least `least` characters that occur in the text, as any part of it, whatever the case.

    Tasks stream the texts through an Aho-Corasick automaton of the names: no row is made but the result's. Names of more than
    `most_bytes` are dealt by hash to shards of about so many bytes, one after another: what a task or the driver holds does not grow with them.
    """
    spark = texts.sparkSession
    named = names.select("name").distinct().where(F.char_length("name") >= least).select("name", F.lower("name").alias("low"))
    named = written(named, "names")
    shards = max(1, -(-(named.agg(F.sum(F.octet_length("low"))).first()[0] or 0) // most_bytes))
    low = texts.select("id", F.lower("content").alias("low")).where("low is not null")
    kind = texts.schema["id"].dataType.simpleString()

    def found_in(shard: int) -> DataFrame:
        own = named.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard) if shards > 1 else named
        sent = spark.sparkContext.broadcast(own.toArrow())
        key = uuid.uuid4().hex

        def search(batches):
            automaton = _automaton(key, sent)
            for batch in batches:
                rows, out = [], []
                for i, text in enumerate(batch.column(1)):
                    for same in {x for _, x in automaton.iter(text.as_py())} if len(automaton) else ():
                        rows += [i] * len(same)
                        out += same
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=["id", "name"])

        return low.mapInArrow(search, f"id {kind}, name string")

    return reduce(DataFrame.unionByName, map(found_in, range(shards))).distinct()


_NAMED = "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' about counterSupplier#00000000', doc_id % 9, ' and more') WHEN doc_id % 3 = 1 THEN concat(text, ' supplier#00000000', doc_id % 9, '5th') ELSE text END"


@query("j9_entities_in_text", cte("entities") + f", t AS (SELECT doc_id AS id, {_NAMED} AS content FROM documents) SELECT DISTINCT id, name FROM t JOIN entities ON contains(lower(content), lower(name))")
def j9(spark, sf_dir):
    from ..sources.fixtures import table

    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_NAMED).alias("content"))
    return entities_in_text(t, view(spark, sf_dir, "entities"))


def schema_first(named: DataFrame, types: list[str] | None, key: str) -> DataFrame:
    """Of (key, name, type), the names of the schema's types; all of a key's names where none is of these."""
    fits = F.col("type").isin(types) if types else F.lit(False)
    marked = named.withColumn("_fits", fits).withColumn("_some", F.max("_fits").over(W.partitionBy(key)))
    return marked.where("_fits or not _some").drop("_fits", "_some", "type").distinct()


def graph_retrieve(queries: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 5, types: list[str] | None = None, vector_hits: DataFrame | None = None) -> dict[str, DataFrame]:
    """For the first entities that each query names: `relations` (query_id, domain_id, source, target, type), `neighbors`
    (query_id, domain_id, start, name) one hop away, and `hits`, the first of the query's vector hits.

    types: a schema's types, which go first; where a query names none of them, all entities count.
    """
    found = entities_in_text(queries.select(F.col("query_id").alias("id"), F.col("query_text").alias("content")), entities).withColumnRenamed("id", "query_id")
    typed = schema_first(found.join(entities.select("name", "type").distinct(), "name"), types, "query_id")
    first = top_per_key(typed, ["query_id"], most, F.col("name")).select("query_id", "name")
    owned = written(first.join(entities.select("domain_id", "name").distinct(), "name"), "graph-starts")
    touching = relations_of(relations, owned).join(owned.select("query_id", "domain_id", F.col("name").alias("source")), ["domain_id", "source"])
    near = neighbors(relations, owned, 1).join(owned.select("query_id", "domain_id", F.col("name").alias("start")), ["domain_id", "start"])
    out = {"relations": touching, "neighbors": near.select("query_id", "domain_id", "start", "name")}
    if vector_hits is not None:
        out["hits"] = top_per_key(vector_hits.select("query_id", "id", "score"), ["query_id"], most, F.desc("score"), F.col("id"))
    return out


_EXACT = ", vs AS (SELECT query_id, id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x)))), 4) AS score FROM vectors, query_vectors)"


@query("r7_graph_retrieve", cte("entities", "relations", "vectors", "query_vectors") + _EXACT + ", q AS (SELECT item_id AS query_id, concat('tell me of Supplier#00000000', item_id % 9 + 1) AS query_text FROM benchmark), n AS (SELECT DISTINCT query_id, name FROM q JOIN entities ON contains(lower(query_text), lower(name))), w AS (SELECT query_id, name, name IN (SELECT name FROM entities WHERE type = 'Vendor') AS fits FROM n), k AS (SELECT *, max(fits::INT) OVER (PARTITION BY query_id) AS anyone FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rn FROM k WHERE fits OR anyone = 0), o AS (SELECT query_id, domain_id, name FROM f JOIN (SELECT DISTINCT domain_id, name FROM entities) USING (name) WHERE rn <= 5), s AS (SELECT * FROM relations UNION ALL SELECT domain_id, target, source, type FROM relations), vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs WHERE query_id IN (SELECT query_id FROM q)) SELECT query_id, 'relation' AS kind, s.domain_id, source, target, type FROM s JOIN o ON s.domain_id = o.domain_id AND s.source = o.name UNION ALL SELECT DISTINCT query_id, 'neighbor', s.domain_id, source, target, NULL FROM s JOIN o ON s.domain_id = o.domain_id AND s.source = o.name WHERE source <> target UNION ALL SELECT query_id, 'hit', NULL, CAST(id AS VARCHAR), NULL, NULL FROM vh WHERE rank <= 5")
def r7(spark, sf_dir):
    from ..sources.fixtures import table

    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("concat('tell me of Supplier#00000000', item_id % 9 + 1)").alias("query_text"))
    got = graph_retrieve(q, view(spark, sf_dir, "entities"), view(spark, sf_dir, "relations"), types=["Vendor"], vector_hits=_vector_hits(spark, sf_dir, q))
    edges = got["relations"].select("query_id", F.lit("relation").alias("kind"), "domain_id", "source", "target", "type")
    near = got["neighbors"].select("query_id", F.lit("neighbor").alias("kind"), "domain_id", F.col("start").alias("source"), F.col("name").alias("target"), F.lit(None).cast("string").alias("type"))
    hits = got["hits"].select("query_id", F.lit("hit").alias("kind"), F.lit(None).cast("long").alias("domain_id"), F.col("id").cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("type"))
    return edges.unionByName(near).unionByName(hits)


def _vector_hits(spark, sf_dir, queries):
    from .vectors import vector_search

    asked = view(spark, sf_dir, "query_vectors").join(queries.select("query_id"), "query_id", "left_semi")
    return vector_search(view(spark, sf_dir, "vectors"), asked, 10)


def graph_enrich(hits: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 10, per_entity: int = 5, types: list[str] | None = None, memberships: DataFrame | None = None, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, source, target, type): relations of entities named in each query's top chunks, so many per entity, those of a
    schema's types first; and (query_id, community_id, summary), each summary once, where communities are given.
    """
    named = entities_in_text(hits.select(F.struct("query_id", "id").alias("id"), "content"), entities)
    first = top_per_key(named.select("id.query_id", "name").distinct(), ["query_id"], most, F.col("name")).select("query_id", "name")
    owned = written(first.join(entities.select("domain_id", "name", "type").distinct(), "name"), "enrich-starts")
    wanted = schema_first(owned, types, "query_id").select("query_id", "domain_id", "name")
    found = relations_of(relations, wanted).join(wanted.select("query_id", "domain_id", F.col("name").alias("source")), ["domain_id", "source"])
    lines = top_per_key(found, ["query_id", "source"], per_entity, F.col("target"), F.col("type"), F.col("domain_id"))
    if memberships is None or summaries is None:
        return lines, None
    starts = owned.select("query_id", "domain_id", "name").distinct()
    about = community_of(memberships, summaries, starts).join(starts, ["domain_id", "name"])
    return lines, about.groupBy("query_id", "summary").agg(F.min("community_id").alias("community_id")).select("query_id", "community_id", "summary")


_R11 = cte("entities", "relations") + f", t AS (SELECT doc_id % 10 AS query_id, doc_id AS id, {_NAMED} AS content FROM documents), n AS (SELECT DISTINCT query_id, name FROM t JOIN entities ON contains(lower(content), lower(name))), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rn FROM n), o AS (SELECT DISTINCT query_id, domain_id, f.name, type FROM f JOIN entities USING (name) WHERE rn <= 10), tt AS (SELECT *, max((type = 'Vendor')::INT) OVER (PARTITION BY query_id) AS anyone FROM o), s AS (SELECT * FROM relations UNION ALL SELECT domain_id, target, source, type FROM relations), j AS (SELECT query_id, source, target, s.type, row_number() OVER (PARTITION BY query_id, source ORDER BY target, s.type, s.domain_id) AS rank FROM s JOIN (SELECT DISTINCT query_id, domain_id, name FROM tt WHERE type = 'Vendor' OR anyone = 0) o ON s.domain_id = o.domain_id AND s.source = o.name), mb AS ({_COMM.format('relations')}), c AS (SELECT query_id, concat('summary ', community_id) AS summary, min(community_id) AS community_id FROM mb JOIN o ON mb.domain_id = o.domain_id AND mb.name = o.name GROUP BY 1, 2)"


@query("r11_graph_enrich", _R11 + " SELECT query_id, source, target, type FROM j WHERE rank <= 5 UNION ALL SELECT query_id, community_id, summary, 'community' FROM c")
def r11(spark, sf_dir):
    from ..sources.fixtures import table

    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("id"), F.expr(_NAMED).alias("content"))
    r = view(spark, sf_dir, "relations")
    mb = r.select("domain_id", F.concat(F.lit("c"), "type").alias("community_id"), F.col("source").alias("name")).distinct()
    summaries = mb.select("domain_id", "community_id").distinct().withColumn("summary", F.concat(F.lit("summary "), "community_id"))
    lines, about = graph_enrich(hits, view(spark, sf_dir, "entities"), r, types=["Vendor"], memberships=mb, summaries=summaries)
    return lines.select("query_id", "source", "target", "type").union(about.select("query_id", "community_id", "summary", F.lit("community")))
