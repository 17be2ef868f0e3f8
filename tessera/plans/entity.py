"""Queries over the entity model, each with its form in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, packs, scalars
from ..functions.numbering import cut, dealt
from ..model import Scope, live, of_kind, visible_to
from ..operators import audit, contracts, graph, metrics, outbox, search, stats, templates
from ..sources.star import NOW, check_sql, euid_sql, model, prelude
from ..streaming import delivery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REGION = 100_000_001
CUSTOMER = 300_000_007
ORDER = 600_000_011
STAMP = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def query(name: str, sql: str | None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


_LIVE_DOWN = """live_down AS (SELECT e.parent_instance_uid AS parent, e.child_instance_uid AS child FROM lineage e JOIN instance c ON c.uid = e.child_instance_uid WHERE NOT e.is_deleted AND NOT c.is_deleted)"""
_BOTH = """ends AS (SELECT parent_instance_uid AS p, child_instance_uid AS c FROM lineage WHERE NOT is_deleted),
  both_ways AS (SELECT p AS a, c AS b FROM ends UNION SELECT c, p FROM ends)"""


def _bfs(start: str, depth: int, steps: str = "both_ways") -> str:
    return f"""bfs(uid, d) AS (SELECT uid, 0 FROM ({start}) s UNION SELECT s.b, d + 1 FROM bfs JOIN {steps} s ON s.a = bfs.uid WHERE d < {depth}),
  dist AS (SELECT uid, min(d) AS depth FROM bfs GROUP BY uid)"""


# Graph

@query("walk_depth_counts", prelude("instance", "lineage") + f""", {_LIVE_DOWN},
  walked(uid, depth, path) AS (SELECT uid, 0, [uid] FROM instance WHERE uid = {REGION} UNION ALL
    SELECT e.child, depth + 1, list_append(path, e.child) FROM walked w JOIN live_down e ON e.parent = w.uid WHERE depth < 4 AND NOT list_contains(path, e.child))
SELECT depth, count(*) AS n, count(DISTINCT uid) AS n_nodes FROM walked GROUP BY depth""")
def walk_depth_counts(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.walk(instance, lineage, REGION, 4).groupBy("depth").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("n_nodes"))


@query("walk_summary", prelude("instance", "lineage") + f""", {_LIVE_DOWN},
  walked(uid, depth, path) AS (SELECT uid, 0, [uid] FROM instance WHERE uid = {CUSTOMER} UNION ALL
    SELECT e.child, depth + 1, list_append(path, e.child) FROM walked w JOIN live_down e ON e.parent = w.uid WHERE depth < 3 AND NOT list_contains(path, e.child))
SELECT count(*) AS n, coalesce(max(depth), 0) AS max_depth FROM walked""")
def walk_summary(spark, d):
    return graph.walk_summary(graph.walk(*model(spark, d, "instance", "lineage"), CUSTOMER, 3))


@query("descendants_of_customer", prelude("instance", "lineage") + f""",
  walked(uid) AS (SELECT uid FROM instance WHERE uid = {CUSTOMER} UNION ALL
    SELECT c.uid FROM walked w JOIN lineage e ON e.parent_instance_uid = w.uid JOIN instance c ON c.uid = e.child_instance_uid WHERE NOT c.is_deleted)
SELECT w.uid, i.euid FROM walked w JOIN instance i USING (uid) ORDER BY i.created_dt DESC, uid LIMIT 10000""")
def descendants_of_customer(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.newest(graph.descendants(instance, lineage, CUSTOMER), instance, 10_000).select("uid", "euid")


@query("descendants_of_region", prelude("instance", "lineage") + f""",
  walked(uid) AS (SELECT uid FROM instance WHERE uid = {REGION} UNION ALL
    SELECT c.uid FROM walked w JOIN lineage e ON e.parent_instance_uid = w.uid JOIN instance c ON c.uid = e.child_instance_uid WHERE NOT c.is_deleted)
SELECT uid, count(*) AS n_paths FROM walked GROUP BY uid""")
def descendants_of_region(spark, d):
    return graph.descendants(*model(spark, d, "instance", "lineage"), REGION).groupBy("uid").agg(F.count("*").alias("n_paths"))


@query("graph_neighbourhood", prelude("instance", "lineage") + f""",
  ends AS (SELECT e.parent_instance_uid AS p, e.child_instance_uid AS c FROM lineage e JOIN instance x ON x.uid = e.parent_instance_uid AND NOT x.is_deleted JOIN instance y ON y.uid = e.child_instance_uid AND NOT y.is_deleted WHERE NOT e.is_deleted),
  both_ways AS (SELECT p AS a, c AS b FROM ends UNION SELECT c, p FROM ends), {_bfs(f"SELECT uid FROM instance WHERE uid = {CUSTOMER} AND NOT is_deleted", 3)}
SELECT uid, depth FROM dist""")
def graph_neighbourhood(spark, d):
    return graph.neighbourhood(*model(spark, d, "instance", "lineage"), CUSTOMER, 3)


@query("graph_neighbourhood_edges", prelude("instance", "lineage") + f""",
  ends AS (SELECT e.parent_instance_uid AS p, e.child_instance_uid AS c FROM lineage e JOIN instance x ON x.uid = e.parent_instance_uid AND NOT x.is_deleted JOIN instance y ON y.uid = e.child_instance_uid AND NOT y.is_deleted WHERE NOT e.is_deleted),
  both_ways AS (SELECT p AS a, c AS b FROM ends UNION SELECT c, p FROM ends), {_bfs(f"SELECT uid FROM instance WHERE uid = {CUSTOMER} AND NOT is_deleted", 2)}
SELECT uid, parent_instance_uid, child_instance_uid, relationship_type FROM lineage
WHERE NOT is_deleted AND parent_instance_uid IN (SELECT uid FROM dist) AND child_instance_uid IN (SELECT uid FROM dist)""")
def graph_neighbourhood_edges(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.incident_edges(graph.neighbourhood(instance, lineage, CUSTOMER, 2), lineage)


@query("graph_payload_nodes", prelude("instance", "lineage") + f""", {_BOTH}, {_bfs(f"SELECT uid FROM instance WHERE uid = {ORDER}", 2)}
SELECT uid, depth FROM dist""")
def graph_payload_nodes(spark, d):
    return graph.payload_nodes(*model(spark, d, "instance", "lineage"), ORDER, 2)


@query("graph_payload_edges", prelude("instance", "lineage") + f""", {_BOTH}, {_bfs(f"SELECT uid FROM instance WHERE uid = {ORDER}", 2)}
SELECT uid, child_instance_uid AS source, parent_instance_uid AS target, parent_instance_uid AS semantic_source, child_instance_uid AS semantic_target, relationship_type
FROM lineage WHERE NOT is_deleted AND (parent_instance_uid IN (SELECT uid FROM dist WHERE depth < 2) OR child_instance_uid IN (SELECT uid FROM dist WHERE depth < 2))""")
def graph_payload_edges(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.payload_edges(graph.payload_nodes(instance, lineage, ORDER, 2), lineage, 2)


@query("graph_overview_edges", prelude("instance", "lineage") + """,
  first AS (SELECT uid FROM instance WHERE NOT is_deleted ORDER BY uid LIMIT 200)
SELECT uid, parent_instance_uid, child_instance_uid, relationship_type FROM lineage
WHERE NOT is_deleted AND parent_instance_uid IN (FROM first) AND child_instance_uid IN (FROM first) ORDER BY uid LIMIT 500""")
def graph_overview_edges(spark, d):
    return graph.overview(*model(spark, d, "instance", "lineage"), 200, 500)


@query("wave_children", prelude("lineage") + f""", {_BOTH}, steps AS (SELECT DISTINCT p AS a, c AS b FROM ends), {_bfs(f"SELECT {REGION}::BIGINT AS uid", 3, "steps")}
SELECT depth, count(*) AS n FROM dist WHERE depth > 0 GROUP BY depth""")
def wave_children(spark, d):
    return graph.waves(graph.live_edges(*model(spark, d, "lineage")), REGION, 3).groupBy("depth").agg(F.count("*").alias("n"))


@query("wave_parents", prelude("lineage") + f""", {_BOTH}, steps AS (SELECT DISTINCT c AS a, p AS b FROM ends), {_bfs("SELECT 500000003::BIGINT AS uid", 4, "steps")}
SELECT depth, count(*) AS n FROM dist WHERE depth > 0 GROUP BY depth""")
def wave_parents(spark, d):
    return graph.waves(graph.live_edges(*model(spark, d, "lineage")), 500_000_003, 4, down=False).groupBy("depth").agg(F.count("*").alias("n"))


@query("khop", prelude("lineage") + f""", {_BOTH}, {_bfs(f"SELECT {REGION}::BIGINT AS uid", 2)}
SELECT uid, depth FROM dist""")
def khop(spark, d):
    (lineage,) = model(spark, d, "lineage")
    start = spark.range(REGION, REGION + 1).withColumnRenamed("id", "uid")
    return graph.reach(start, graph.doubled(graph.live_edges(lineage)), 2)


@query("induced_subgraph", prelude("instance", "lineage") + """,
  shown AS (SELECT uid FROM instance WHERE NOT is_deleted AND type NOT IN ('part', 'supplier'))
SELECT relationship_type, count(*) AS n FROM lineage WHERE NOT is_deleted AND parent_instance_uid IN (FROM shown) AND child_instance_uid IN (FROM shown) GROUP BY relationship_type""")
def induced_subgraph(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.induced(live(instance), graph.live_edges(lineage), ["part", "supplier"]).groupBy("relationship_type").agg(F.count("*").alias("n"))


@query("low_degree_nodes", prelude("instance", "lineage") + """,
  deg AS (SELECT uid, count(*) AS n FROM (SELECT parent_instance_uid AS uid FROM lineage WHERE NOT is_deleted UNION ALL SELECT child_instance_uid FROM lineage WHERE NOT is_deleted) x GROUP BY uid)
SELECT i.uid, coalesce(n, 0) AS degree FROM instance i LEFT JOIN deg USING (uid) WHERE NOT is_deleted AND coalesce(n, 0) <= 1""")
def low_degree_nodes(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.degrees(live(instance), graph.live_edges(lineage)).where("degree <= 1")


@query("graph_text_search", prelude("instance") + """
SELECT uid FROM instance WHERE NOT is_deleted AND (contains(lower(coalesce(euid, '')), 'ring') OR contains(lower(coalesce(name, '')), 'ring') OR contains(lower(type), 'ring') OR contains(lower(category), 'ring') OR contains(lower(coalesce(subtype, '')), 'ring'))""")
def graph_text_search(spark, d):
    return graph.graph_search(live(*model(spark, d, "instance")), " Ring ").select("uid")


@query("mermaid_lines", prelude("instance", "lineage") + """,
  shown AS (SELECT uid, name, row_number() OVER (ORDER BY uid) AS n FROM instance WHERE category = 'geo'),
  links AS (SELECT p.n AS a, c.n AS b, relationship_type AS r, parent_instance_uid AS x, child_instance_uid AS y FROM lineage JOIN shown p ON p.uid = parent_instance_uid JOIN shown c ON c.uid = child_instance_uid WHERE NOT is_deleted)
SELECT 1 AS part, n::INT AS position, 'N' || n || '["' || name || '"]' AS line FROM shown
UNION ALL SELECT 2, (row_number() OVER (ORDER BY x, y, r))::INT, 'N' || a || ' -->|' || r || '| N' || b FROM links""")
def mermaid_lines(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.mermaid(instance.where("category = 'geo'"), graph.live_edges(lineage))


@query("mermaid_lines_all", prelude("instance", "lineage") + """,
  shown AS (SELECT uid, name, row_number() OVER (ORDER BY uid) AS n FROM instance),
  links AS (SELECT p.n AS a, c.n AS b, relationship_type AS r, parent_instance_uid AS x, child_instance_uid AS y FROM lineage JOIN shown p ON p.uid = parent_instance_uid JOIN shown c ON c.uid = child_instance_uid WHERE NOT is_deleted)
SELECT 1 AS part, n::INT AS position, 'N' || n || '["' || name || '"]' AS line FROM shown
UNION ALL SELECT 2, (row_number() OVER (ORDER BY x, y, r))::INT, 'N' || a || ' -->|' || r || '| N' || b FROM links""")
def mermaid_lines_all(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.mermaid(instance, graph.live_edges(lineage))


@query("synthetic_edges", prelude("instance") + """,
  nodes AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS idx FROM instance WHERE category = 'actor'), n AS (SELECT count(*) AS n FROM nodes),
  pairs AS (SELECT i % n AS p, (i % n + 1 + (i // n) % (n - 1)) % n AS c FROM range(5000) r(i), n)
SELECT p.uid AS parent, c.uid AS child FROM pairs JOIN nodes p ON p.idx = pairs.p JOIN nodes c ON c.idx = pairs.c""")
def synthetic_edges(spark, d):
    (instance,) = model(spark, d, "instance")
    return graph.synthetic_edges(instance.where("category = 'actor'"), 5000)


@query("revision_chains", prelude("instance") + """
SELECT uid || '/' || r AS newer, uid || '/' || (r - 1) AS older, 'revision_of' AS relationship_type FROM instance, range(1, 4) t(r) WHERE category = 'geo'""")
def revision_chains(spark, d):
    return graph.revision_chains(model(spark, d, "instance")[0].where("category = 'geo'"), 3)


@query("revision_chains_all", prelude("instance") + """
SELECT uid || '/' || r AS newer, uid || '/' || (r - 1) AS older, 'revision_of' AS relationship_type FROM instance, range(1, 4) t(r)""")
def revision_chains_all(spark, d):
    return graph.revision_chains(model(spark, d, "instance")[0], 3)


@query("edge_endpoints", prelude("instance", "lineage") + """
SELECT e.uid, p.name AS parent_name, c.name AS child_name, p.euid AS parent_euid, c.euid AS child_euid FROM lineage e JOIN instance p ON p.uid = parent_instance_uid JOIN instance c ON c.uid = child_instance_uid WHERE e.relationship_type = 'contains'""")
def edge_endpoints(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.with_endpoints(lineage.where("relationship_type = 'contains'"), instance).select("uid", "parent_name", "child_name", "parent_euid", "child_euid")


@query("edge_endpoints_all", prelude("instance", "lineage") + """
SELECT e.uid, p.name AS parent_name, c.name AS child_name, p.euid AS parent_euid, c.euid AS child_euid FROM lineage e JOIN instance p ON p.uid = parent_instance_uid JOIN instance c ON c.uid = child_instance_uid""")
def edge_endpoints_all(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.with_endpoints(lineage, instance).select("uid", "parent_name", "child_name", "parent_euid", "child_euid")


@query("parent_edges", prelude("instance", "lineage") + """
SELECT i.uid, count(*) AS n_parents FROM instance i JOIN lineage e ON e.child_instance_uid = i.uid GROUP BY i.uid""")
def parent_edges(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return instance.select("uid").join(lineage.select(F.col("child_instance_uid").alias("uid")), "uid").groupBy("uid").agg(F.count("*").alias("n_parents"))


@query("relationships", prelude("instance", "lineage") + f"""
SELECT 'parent_of' AS direction, e.child_instance_uid AS uid, relationship_type, i.name FROM lineage e LEFT JOIN instance i ON i.uid = e.child_instance_uid WHERE NOT e.is_deleted AND e.parent_instance_uid = {CUSTOMER}
UNION ALL SELECT 'child_of', e.parent_instance_uid, relationship_type, i.name FROM lineage e LEFT JOIN instance i ON i.uid = e.parent_instance_uid WHERE NOT e.is_deleted AND e.child_instance_uid = {CUSTOMER}""")
def relationships(spark, d):
    return graph.relationships(*model(spark, d, "instance", "lineage"), CUSTOMER).select("direction", "uid", "relationship_type", "name")


@query("priority_lineages", prelude("lineage") + """
SELECT uid, row_number() OVER (ORDER BY CASE WHEN child_type = 'order_instance' THEN 0 ELSE 1 END, child_instance_uid::VARCHAR) AS place FROM lineage WHERE parent_instance_uid BETWEEN 200000001 AND 200000003""")
def priority_lineages(spark, d):
    from pyspark.sql import Window

    (lineage,) = model(spark, d, "lineage")
    rows = lineage.where("parent_instance_uid between 200000001 and 200000003")
    order = Window.orderBy(F.when(F.col("child_type") == "order_instance", 0).otherwise(1), F.col("child_instance_uid").cast("string"))
    return graph.by_priority(rows, ["order_instance"]).select("uid", F.row_number().over(order).cast("long").alias("place"))


@query("priority_lineages_all", prelude("lineage") + """
SELECT uid, row_number() OVER (PARTITION BY parent_instance_uid ORDER BY CASE WHEN child_type = 'order_instance' THEN 0 ELSE 1 END, child_instance_uid::VARCHAR, uid) AS place FROM lineage""")
def priority_lineages_all(spark, d):
    return graph.numbered_by_priority(model(spark, d, "lineage")[0], ["order_instance"])


@query("orphan_edges", prelude("instance", "lineage") + """,
  alive AS (SELECT uid FROM instance WHERE NOT is_deleted)
SELECT uid, 'parent' AS side, parent_instance_uid AS missing FROM lineage WHERE NOT is_deleted AND parent_instance_uid NOT IN (FROM alive)
UNION ALL SELECT uid, 'child', child_instance_uid FROM lineage WHERE NOT is_deleted AND child_instance_uid NOT IN (FROM alive)""")
def orphan_edges(spark, d):
    instance, lineage = model(spark, d, "instance", "lineage")
    return graph.orphan_edges(lineage, instance)


@query("missing_targets", prelude("instance") + """,
  wanted AS (SELECT DISTINCT 'Z-CST-' || i AS euid FROM range(1, 40) r(i) UNION SELECT euid FROM instance WHERE type = 'customer')
SELECT euid FROM wanted WHERE euid NOT IN (SELECT euid FROM instance WHERE NOT is_deleted)""")
def missing_targets(spark, d):
    (instance,) = model(spark, d, "instance")
    wanted = spark.range(1, 40).select(F.concat(F.lit("Z-CST-"), F.col("id").cast("string")).alias("euid")).unionByName(instance.where("type = 'customer'").select("euid"))
    return graph.missing_targets(wanted, instance)


@query("live_edge_uniqueness", prelude("lineage") + """
SELECT parent_instance_uid, child_instance_uid, relationship_type, count(*) AS n FROM lineage WHERE NOT is_deleted GROUP BY ALL HAVING count(*) > 1""")
def live_edge_uniqueness(spark, d):
    (lineage,) = model(spark, d, "lineage")
    return stats.uniqueness_violations(lineage, ["parent_instance_uid", "child_instance_uid", "relationship_type"], ~F.col("is_deleted"))


# Statistics

def _stats_sql(table: str, distinct: list[str], deleted: str, single: bool) -> str:
    cols = ", ".join(f"count(DISTINCT {c}) AS distinct_{c}" for c in distinct)
    extra = ", count(*) FILTER (is_singleton) AS singleton_count" if single else ""
    return prelude(table) + f" SELECT count(*) AS total, {cols}, max(created_dt) AS latest_created, min(created_dt) AS earliest_created, round(avg((epoch_us({STAMP}) - epoch_us(created_dt)) / 1000000.0), 3) AS average_age_s{extra} FROM {table} WHERE is_deleted = {deleted}"


def _stats(kind: str, deleted: bool = False):
    def run(spark, d):
        (frame,) = model(spark, d, kind)
        return stats.table_stats(frame, kind, now(), deleted).withColumn("average_age_s", F.round("average_age_s", 3))

    return run


query("template_stats", _stats_sql("template", ["type", "subtype", "category"], "false", True))(_stats("template"))
query("instance_stats", _stats_sql("instance", ["type", "subtype", "polymorphic_discriminator", "category"], "false", True))(_stats("instance"))
query("instance_stats_deleted", _stats_sql("instance", ["type", "subtype", "polymorphic_discriminator", "category"], "true", True))(_stats("instance", True))
query("lineage_stats", _stats_sql("lineage", ["parent_type", "child_type", "polymorphic_discriminator", "category"], "false", False))(_stats("lineage"))


@query("table_counts", prelude("template", "instance", "lineage") + " " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) FILTER (NOT is_deleted) AS n_live FROM {t}" for t in ("template", "instance", "lineage")))
def table_counts(spark, d):
    t, i, e = model(spark, d, "template", "instance", "lineage")
    return stats.row_counts(template=t, instance=i, lineage=e)


@query("category_facets", prelude("template", "instance") + " SELECT DISTINCT category FROM (SELECT category FROM template UNION ALL SELECT category FROM instance) x WHERE trim(category) <> ''")
def category_facets(spark, d):
    return stats.category_facets(*model(spark, d, "template", "instance"))


@query("type_facets", prelude("instance") + " SELECT DISTINCT 'type' AS facet, type AS value FROM instance UNION SELECT DISTINCT 'subtype', subtype FROM instance WHERE subtype <> ''")
def type_facets(spark, d):
    return stats.facets(model(spark, d, "instance")[0], "type", "subtype")


@query("top_scope", prelude("instance") + " SELECT domain_code, issuer_app_code, count(*) AS n FROM instance GROUP BY ALL ORDER BY n DESC, domain_code, issuer_app_code LIMIT 1")
def top_scope(spark, d):
    return stats.top_scope(*model(spark, d, "instance"))


@query("duplicate_dedupe_keys", prelude("outbox_event") + " SELECT domain_code, issuer_app_code, destination, dedupe_key, count(*) AS n, min(id) AS first_member, max(id) AS last_member FROM outbox_event GROUP BY ALL HAVING count(*) > 1")
def duplicate_dedupe_keys(spark, d):
    return stats.duplicates(model(spark, d, "outbox_event")[0], outbox.KEYS, "id")


@query("duplicate_dedupe_members", prelude("outbox_event") + " SELECT domain_code, issuer_app_code, destination, dedupe_key, id FROM outbox_event QUALIFY count(*) OVER (PARTITION BY domain_code, issuer_app_code, destination, dedupe_key) > 1")
def duplicate_dedupe_members(spark, d):
    return stats.duplicate_members(model(spark, d, "outbox_event")[0], outbox.KEYS, "id")


@query("kind_bounds", prelude("instance") + " SELECT polymorphic_discriminator, count(*) AS n, min(uid) AS min_uid, max(uid) AS max_uid FROM instance GROUP BY polymorphic_discriminator")
def kind_bounds(spark, d):
    return stats.bounds(model(spark, d, "instance")[0], "polymorphic_discriminator")


@query("next_euid_seq", prelude("template", "instance") + " SELECT euid_prefix AS prefix, max(euid_seq) + 1 AS next_seq FROM (SELECT euid_prefix, euid_seq FROM template UNION ALL SELECT euid_prefix, euid_seq FROM instance) x GROUP BY euid_prefix")
def next_euid_seq(spark, d):
    return identity.next_sequences(*model(spark, d, "template", "instance"))


@query("outbox_summary", prelude("outbox_event") + " SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "delivering", "received", "processed", "failed", "dead_letter", "rejected", "canceled")) + " FROM outbox_event WHERE domain_code = 'Z'")
def outbox_summary(spark, d):
    return stats.outbox_summary(model(spark, d, "outbox_event")[0], Scope("Z"))


@query("inbox_summary", prelude("inbox_message") + " SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("received", "processing", "processed", "failed", "rejected")) + " FROM inbox_message")
def inbox_summary(spark, d):
    return stats.inbox_summary(model(spark, d, "inbox_message")[0])


# Metrics

@query("metrics_overall", prelude("metrics") + " SELECT count(*) AS n, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99, max(duration_ms) AS max_ms, max(ts) AS last_seen FROM metrics")
def metrics_overall(spark, d):
    return metrics.overall(*model(spark, d, "metrics"))


@query("metrics_by_path", prelude("metrics") + " SELECT coalesce(path, '') AS key, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95, max(duration_ms) AS max_ms FROM metrics GROUP BY 1")
def metrics_by_path(spark, d):
    return metrics.by_group(model(spark, d, "metrics")[0], F.col("path"))


@query("metrics_by_table", prelude("metrics") + " SELECT coalesce(table_hint, '') AS key, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95, max(duration_ms) AS max_ms FROM metrics GROUP BY 1")
def metrics_by_table(spark, d):
    return metrics.by_group(model(spark, d, "metrics")[0], F.col("table_hint"))


@query("metrics_slowest", prelude("metrics") + " SELECT event_id, duration_ms, path FROM metrics ORDER BY duration_ms DESC, event_id LIMIT 25")
def metrics_slowest(spark, d):
    return metrics.slowest(model(spark, d, "metrics")[0]).select("event_id", "duration_ms", "path")


@query("metrics_two_week", prelude("metrics") + " SELECT (date_trunc('week', ts) - to_days(CAST(7 * ((weekofyear(ts) - 1) % 2) AS INT)))::DATE AS period, count(*) AS n, count(*) FILTER (NOT ok) AS failures FROM metrics GROUP BY 1")
def metrics_two_week(spark, d):
    return metrics.by_two_weeks(*model(spark, d, "metrics"))


# Audit

_TRAIL = """SELECT a.uid, a.rel_table_euid_fk, a.changed_by, a.operation_type, a.changed_at, {0} FROM audit_log a
LEFT JOIN template t ON {1} t.uid = a.rel_table_uid_fk LEFT JOIN instance i ON {2} i.uid = a.rel_table_uid_fk LEFT JOIN lineage e ON {3} e.uid = a.rel_table_uid_fk {4} ORDER BY changed_at DESC, a.uid LIMIT 500"""
_SHOWN = ", ".join(f"coalesce(t.{c}, i.{c}, e.{c}) AS {c}" for c in ("name", "polymorphic_discriminator", "category", "type", "subtype", "bstatus"))


@query("audit_trail_strict", prelude("template", "instance", "lineage", "audit_log") + " " + _TRAIL.format(_SHOWN, "a.rel_table_name = 'template' AND", "a.rel_table_name = 'instance' AND", "a.rel_table_name = 'lineage' AND", "WHERE a.changed_at >= TIMESTAMP '2024-01-03 00:00:00' AND a.issuer_app_code = 'crm'"))
def audit_trail_strict(spark, d):
    t, i, e, a = model(spark, d, "template", "instance", "lineage", "audit_log")
    return audit.query_trail(a, t, i, e, since=F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), scope=Scope(issuer="crm"))


@query("audit_trail_compat", prelude("template", "instance", "lineage", "audit_log") + " " + _TRAIL.format(_SHOWN, "", "", "", "WHERE a.changed_by = 'User7'"))
def audit_trail_compat(spark, d):
    t, i, e, a = model(spark, d, "template", "instance", "lineage", "audit_log")
    return audit.query_trail(a, t, i, e, changed_by="User7", compat=True)


@query("object_audit", prelude("audit_log") + f" SELECT uid, operation_type, changed_at FROM audit_log WHERE NOT is_deleted AND rel_table_euid_fk = {euid_sql(repr('Z'), repr('CST'), '9')} ORDER BY changed_at DESC, uid LIMIT 100")
def object_audit(spark, d):
    (a,) = model(spark, d, "audit_log")
    return audit.object_audit(a, f" z-cst-9{_check('Z', 'CST', '9').lower()} ").select("uid", "operation_type", "changed_at")


def _check(domain: str, prefix: str, body: str) -> str:
    """Check character of a literal identifier, for a filter value."""
    total = 0
    for i, c in enumerate(reversed(domain + prefix + body)):
        p = identity.ALPHABET.index(c) * (2 if i % 2 == 0 else 1)
        total += p // 32 + p % 32
    return identity.ALPHABET[(32 - total % 32) % 32]


@query("user_audit", prelude("audit_log") + " SELECT uid, operation_type, changed_at FROM audit_log WHERE NOT is_deleted AND lower(changed_by) = 'user12' AND operation_type = 'UPDATE' ORDER BY changed_at DESC, uid LIMIT 100")
def user_audit(spark, d):
    return audit.user_audit(model(spark, d, "audit_log")[0], " USER12", "UPDATE").select("uid", "operation_type", "changed_at")


@query("latest_revisions", prelude("audit_log") + """,
  ranked AS (SELECT *, row_number() OVER (PARTITION BY rel_table_name, rel_table_uid_fk ORDER BY changed_at DESC, uid DESC) AS n FROM audit_log)
SELECT rel_table_name, rel_table_uid_fk, changed_at, uid, operation_type, changed_by FROM ranked WHERE n = 1 ORDER BY changed_at DESC, uid DESC LIMIT 50""")
def latest_revisions(spark, d):
    return audit.latest_revisions(model(spark, d, "audit_log")[0], 50)


def _changed(instance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers before and after a made-up change of state and tenant."""
    old = instance.where("type = 'customer'").withColumn("modified_dt", F.lit(None).cast("timestamp_ntz"))
    new = old.withColumn("bstatus", F.when(F.col("uid") % 5 == 0, "blocked").otherwise(F.col("bstatus"))).withColumn("tenant_id", F.when(F.col("uid") % 7 == 0, F.lit(None)).otherwise(F.col("tenant_id")))
    return old, new


@query("cdc_update_rows", prelude("instance") + """
SELECT uid, 'UPDATE' AS operation_type, 'bstatus' AS column_name, bstatus AS old_value, 'blocked' AS new_value FROM instance WHERE type = 'customer' AND uid % 5 = 0
UNION ALL SELECT uid, 'UPDATE', 'tenant_id', tenant_id, NULL FROM instance WHERE type = 'customer' AND uid % 7 = 0 AND tenant_id IS NOT NULL""")
def cdc_update_rows(spark, d):
    return audit.update_rows(*_changed(model(spark, d, "instance")[0]), ["bstatus", "tenant_id", "name"])


@query("cdc_insert_rows", prelude("instance") + " SELECT uid, 'INSERT' AS operation_type FROM instance WHERE type = 'supplier'")
def cdc_insert_rows(spark, d):
    (i,) = model(spark, d, "instance")
    return audit.insert_rows(i.where("type = 'customer'"), i.where("category = 'actor'"))


@query("soft_delete_rows", prelude("instance") + " SELECT uid, 'DELETE' AS operation_type, uid - 300000000 AS old_key FROM instance WHERE type = 'customer' AND uid % 10 = 0 AND NOT is_deleted")
def soft_delete_rows(spark, d):
    (i,) = model(spark, d, "instance")
    _, rows = audit.soft_delete(i, i.where("type = 'customer' and uid % 10 = 0").select("uid"))
    return rows.select("uid", "operation_type", (F.get_json_object("old_value", "$.uid").cast("long") - 300_000_000).alias("old_key"))


@query("modified_touch", prelude("instance") + f" SELECT uid, CASE WHEN uid % 5 = 0 OR (uid % 7 = 0 AND tenant_id IS NOT NULL) THEN {STAMP} END AS modified_dt FROM instance WHERE type = 'customer'")
def modified_touch(spark, d):
    return audit.touched(*_changed(model(spark, d, "instance")[0]), ["bstatus", "tenant_id"], now())


@query("upsert_outcomes", prelude("template") + """,
  incoming AS (SELECT category, type, 'generic' AS subtype, v AS version, CASE WHEN type = 'part' THEN 'renamed' ELSE name END AS name FROM template, (VALUES ('1.0'), ('1.9'), ('2.0')) x(v))
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN t.uid IS NULL THEN 'inserted' WHEN t.name = incoming.name AND NOT t.is_deleted THEN 'skipped' ELSE 'updated' END AS outcome
  FROM incoming LEFT JOIN template t USING (category, type, subtype, version)) x GROUP BY outcome""")
def upsert_outcomes(spark, d):
    (t,) = model(spark, d, "template")
    versions = spark.createDataFrame([("1.0",), ("1.9",), ("2.0",)], "version string")
    incoming = t.drop("version").join(F.broadcast(versions)).withColumn("name", F.when(F.col("type") == "part", "renamed").otherwise(F.col("name")))
    return audit.upsert(t, incoming, list(templates.KEY), ["name"], True).groupBy("outcome").agg(F.count("*").alias("n"))


# Search

_RESULTS = """, found AS (
  SELECT 'template' AS record_type, uid, euid, name, category, type, subtype, version, bstatus, CAST(NULL AS VARCHAR) AS relationship_type, tenant_id, created_dt FROM template WHERE NOT is_deleted
  UNION ALL SELECT 'instance', uid, euid, name, category, type, subtype, version, bstatus, NULL, tenant_id, created_dt FROM instance WHERE NOT is_deleted
  UNION ALL SELECT 'lineage', uid, euid, name, category, type, subtype, version, bstatus, relationship_type, NULL, created_dt FROM lineage WHERE NOT is_deleted),
joined AS (SELECT *, concat_ws(' ', """ + ", ".join(f"lower(trim(coalesce({c}, '')))" for c in ("euid", "name", "category", "type", "subtype", "version", "bstatus", "relationship_type")) + """) AS hay FROM found) """
_THREE = prelude("template", "instance", "lineage") + _RESULTS


@query("search_all", _THREE + "SELECT record_type, uid, euid, coalesce(nullif(name, ''), euid) AS display_label FROM joined WHERE contains(hay, 'building') ORDER BY created_dt DESC NULLS LAST, record_type DESC, euid DESC LIMIT 25")
def search_all(spark, d):
    found = search.search(search.results(*model(spark, d, "template", "instance", "lineage")), q="Building ")
    return search.newest_first(found, 25).select("record_type", "uid", "euid", "display_label")


@query("search_count", _THREE + "SELECT count(*) AS total FROM joined WHERE contains(hay, 'red')")
def search_count(spark, d):
    return search.search(search.results(*model(spark, d, "template", "instance", "lineage")), q="red").agg(F.count("*").alias("total"))


@query("search_instance_filtered", _THREE + "SELECT record_type, uid, euid FROM joined WHERE record_type = 'instance' AND category = 'actor' AND tenant_id = '00000000-0000-0000-0000-000000000001' AND contains(hay, '#00') ORDER BY created_dt DESC NULLS LAST, record_type DESC, euid DESC LIMIT 100")
def search_instance_filtered(spark, d):
    found = search.search(search.results(*model(spark, d, "template", "instance", "lineage")), q="#00", record_type="instance", category="Actor", tenant_id="00000000-0000-0000-0000-000000000001")
    return search.newest_first(found, 500).select("record_type", "uid", "euid")


@query("search_by_relationship", _THREE + "SELECT relationship_type, count(*) AS n FROM joined WHERE relationship_type = 'placed' GROUP BY ALL")
def search_by_relationship(spark, d):
    found = search.search(search.results(*model(spark, d, "template", "instance", "lineage")), relationship_type="Placed")
    return found.groupBy("relationship_type").agg(F.count("*").alias("n"))


@query("simple_search", _THREE + "SELECT record_type, uid FROM found WHERE contains(lower(trim(euid)) || ' ' || lower(trim(name)), 'nation') ORDER BY created_dt DESC, record_type, euid LIMIT 20")
def simple_search(spark, d):
    return search.simple_search(*model(spark, d, "template", "instance", "lineage"), "Nation", 20).select("record_type", "uid")


@query("complex_search", _THREE + "SELECT record_type, uid FROM found WHERE record_type = 'instance' AND type = 'part' AND contains(lower(trim(name)), 'ring') AND contains(lower(trim(euid)), 'prt-1') ORDER BY created_dt DESC, record_type, euid LIMIT 20")
def complex_search(spark, d):
    return search.complex_search(*model(spark, d, "template", "instance", "lineage"), kind="instance", type_name="part", name_like="ring", euid_like="prt-1").select("record_type", "uid")


@query("lookup_by_euid", _THREE + f"SELECT record_type, uid FROM found WHERE euid = {euid_sql(repr('Z'), repr('NTN'), '4')}")
def lookup_by_euid(spark, d):
    return search.by_euid(*model(spark, d, "template", "instance", "lineage"), f" Z-NTN-4{_check('Z', 'NTN', '4')} ").select("record_type", "uid")


@query("instances_page", prelude("instance") + " SELECT uid, euid, name FROM instance WHERE NOT is_deleted ORDER BY created_dt DESC, uid LIMIT 50 OFFSET 100")
def instances_page(spark, d):
    return search.page(live(*model(spark, d, "instance")), [F.col("created_dt").desc(), F.col("uid").asc()], 3, 50).select("uid", "euid", "name")


@query("page_count", prelude("instance") + " SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM instance WHERE NOT is_deleted")
def page_count(spark, d):
    return search.pages(live(*model(spark, d, "instance")), 50)


@query("attr_or_json_filter", prelude("instance") + " SELECT uid FROM instance WHERE (type = 'order' OR json_extract_string(json_addl, '$.type') = 'order') AND json_extract_string(json_addl, '$.rank') = '3'")
def attr_or_json_filter(spark, d):
    return search.members(model(spark, d, "instance")[0], {"type": "order", "rank": "3"}).select("uid")


@query("template_wildcard", prelude("template") + " SELECT uid FROM template WHERE NOT is_deleted AND domain_code = 'Z' AND category = 'actor' AND subtype = 'generic' AND version = '1.0'")
def template_wildcard(spark, d):
    return search.template_by_code(model(spark, d, "template")[0], "actor/*/generic/1.0/", "Z").select("uid")


@query("highest_version", prelude("template") + " SELECT subtype, max_by(uid, version || '/' || uid) AS uid FROM template GROUP BY subtype")
def highest_version(spark, d):
    return search.highest_version(model(spark, d, "template")[0], ["subtype"]).select("subtype", "uid")


@query("rls_visible", prelude("instance") + " SELECT count(*) AS n, count(tenant_id) AS with_tenant FROM instance WHERE domain_code = 'Z' AND issuer_app_code = 'crm' AND (tenant_id IS NULL OR tenant_id = '00000000-0000-0000-0000-000000000002')")
def rls_visible(spark, d):
    rows = visible_to(model(spark, d, "instance")[0], "Z", "crm", "00000000-0000-0000-0000-000000000002")
    return rows.agg(F.count("*").alias("n"), F.count("tenant_id").alias("with_tenant"))


@query("rls_attempts", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def rls_attempts(spark, d):
    lines, o = model(spark, d, "lineitem", "outbox_event")
    return outbox.visible_attempts(lines.select(F.col("l_orderkey").alias("outbox_event_id")), o, Scope("Z", "sales")).agg(F.count("*").alias("n"))


@query("discriminator_counts", prelude("instance") + " SELECT count(*) AS n, min(euid) AS first FROM instance WHERE polymorphic_discriminator = 'supplier_instance'")
def discriminator_counts(spark, d):
    return of_kind(model(spark, d, "instance")[0], "supplier_instance").agg(F.count("*").alias("n"), F.min("euid").alias("first"))


@query("category_colours", prelude("instance") + " SELECT category, CASE category WHEN 'workflow' THEN '#00FF7F' WHEN 'container' THEN '#8B00FF' WHEN 'actor' THEN '#FF69B4' ELSE '#888888' END AS colour, count(*) AS n FROM instance GROUP BY ALL")
def category_colours(spark, d):
    return model(spark, d, "instance")[0].groupBy("category", graph.colour(F.upper("category")).alias("colour")).agg(F.count("*").alias("n"))


@query("json_pairs", prelude("instance") + " SELECT 'rank' AS key, json_extract_string(json_addl, '$.rank') AS value, count(*) AS n FROM instance GROUP BY ALL")
def json_pairs(spark, d):
    pairs = model(spark, d, "instance")[0].select(F.explode(scalars.json_pairs(F.col("json_addl"))))
    return pairs.where("key = 'rank'").groupBy("key", "value").agg(F.count("*").alias("n"))


@query("json_merge", prelude("instance") + " SELECT 'x' AS rank, json_extract_string(json_addl, '$.kind') AS kind, count(*) AS n FROM instance GROUP BY ALL")
def json_merge(spark, d):
    merged = scalars.json_with(F.col("json_addl"), "rank", F.lit("x"))
    rows = model(spark, d, "instance")[0].select(scalars.json_text(merged, "rank").alias("rank"), scalars.json_text(merged, "kind").alias("kind"))
    return rows.groupBy("rank", "kind").agg(F.count("*").alias("n"))


# Outbox and inbox

@query("outbox_claim", prelude("outbox_event") + f" SELECT id FROM outbox_event WHERE status IN ('pending', 'failed', 'delivering') AND next_attempt_at <= {STAMP} AND domain_code = 'Z' ORDER BY created_dt, id LIMIT 50")
def outbox_claim(spark, d):
    return outbox.claim(_outbox(spark, d), now(), "token", scope=Scope("Z")).select("id")


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    (o,) = model(spark, d, "outbox_event")
    return o.withColumns({"last_error": F.lit(None).cast("string"), "claim_token": F.lit(None).cast("string"), "dead_letter_dt": F.lit(None).cast("timestamp_ntz")})


@query("outbox_claimed_state", prelude("outbox_event") + f", c AS (SELECT * FROM outbox_event WHERE status IN ('pending', 'failed', 'delivering') AND next_attempt_at <= {STAMP} ORDER BY created_dt, id LIMIT 50) SELECT id, 'delivering' AS status, attempt_count + 1 AS attempt_count, {STAMP} + to_minutes(5) AS next_attempt_at, {STAMP} + to_minutes(5) AS lease_expires_dt, 'token' AS claim_token FROM c")
def outbox_claimed_state(spark, d):
    return outbox.claim(_outbox(spark, d), now(), "token").select("id", "status", "attempt_count", "next_attempt_at", "lease_expires_dt", "claim_token")


_CLAIMED = prelude("outbox_event") + f""", c AS (SELECT id, attempt_count + 1 AS attempts FROM outbox_event WHERE status IN ('pending', 'failed', 'delivering') AND next_attempt_at <= {STAMP} ORDER BY created_dt, id LIMIT 200),
  settled AS (SELECT id, attempts, CASE id % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'received' WHEN 2 THEN 'rejected' ELSE CASE WHEN attempts >= 10 THEN 'dead_letter' ELSE 'failed' END END AS status FROM c)"""


def _settled(spark: SparkSession, d: str) -> DataFrame:
    claimed = outbox.claim(_outbox(spark, d), now(), "token", 200)
    outcome = F.element_at(F.array(*map(F.lit, ("processed", "received", "rejected", "failed"))), (F.col("id") % 4 + 1).cast("int"))
    return outbox.settle(claimed, claimed.select("id", outcome.alias("outcome"), F.lit("no answer").alias("error")), now())


@query("outbox_settled", _CLAIMED + f" SELECT id, status, CASE WHEN status = 'failed' THEN {STAMP} + to_seconds(least(1800, 2 ** least(greatest(attempts, 0), 31))) ELSE {STAMP} + to_minutes(5) END AS next_attempt_at, CASE WHEN status IN ('failed', 'dead_letter', 'rejected') THEN 'no answer' END AS last_error FROM settled")
def outbox_settled(spark, d):
    return _settled(spark, d).select("id", "status", "next_attempt_at", "last_error")


@query("outbox_attempt_rows", _CLAIMED + " SELECT id AS outbox_event_id, attempts AS attempt_no, CASE WHEN status IN ('processed', 'received') THEN 'receipt_valid' WHEN status = 'rejected' THEN 'rejected' ELSE 'transport_failed' END AS transport_status FROM settled")
def outbox_attempt_rows(spark, d):
    return outbox.attempt_rows(_settled(spark, d), now()).select("outbox_event_id", "attempt_no", "transport_status")


@query("outbox_failed", prelude("outbox_event") + " SELECT id, status, last_attempt_dt FROM outbox_event WHERE status IN ('failed', 'dead_letter', 'rejected')")
def outbox_failed(spark, d):
    return outbox.failed(model(spark, d, "outbox_event")[0]).select("id", "status", "last_attempt_dt")


_TURNS = prelude("outbox_event") + f""", one AS (SELECT *, status IN ('pending', 'failed', 'delivering') AND next_attempt_at <= {STAMP} AS due FROM outbox_event WHERE id % 3 <> 0),
settled1 AS (SELECT id, attempt_count + 1 AS attempts FROM one WHERE due),
after1 AS (SELECT id, attempts, CASE id % 4 WHEN 0 THEN CASE WHEN attempts >= 10 THEN 'dead_letter' ELSE 'failed' END WHEN 1 THEN 'rejected' ELSE 'processed' END AS status,
  {STAMP} + to_seconds(least(1800, pow(2, least(attempts, 31)))::BIGINT) AS again FROM settled1),
two AS (SELECT id, attempt_count AS attempts, status, next_attempt_at AS again FROM outbox_event WHERE id % 3 = 0
  UNION ALL SELECT id, attempt_count, status, next_attempt_at FROM one WHERE NOT due AND status IN ('pending', 'failed', 'delivering')
  UNION ALL SELECT id, attempts, status, again FROM after1 WHERE status = 'failed'),
due2 AS (SELECT *, status IN ('pending', 'failed', 'delivering') AND again <= {STAMP} + INTERVAL 1 HOUR AS due FROM two),
after2 AS (SELECT id, attempts + 1 AS attempts, CASE id % 4 WHEN 0 THEN CASE WHEN attempts + 1 >= 10 THEN 'dead_letter' ELSE 'failed' END WHEN 1 THEN 'rejected' ELSE 'processed' END AS status FROM due2 WHERE due)"""


@query("outbox_dispatch_turns", _TURNS + """ SELECT id, 1 AS turn, status, attempts AS attempt_count FROM after1 UNION ALL SELECT id, 2, status, attempts FROM after2
UNION ALL SELECT id, 3, status, attempts FROM due2 WHERE NOT due AND status IN ('pending', 'failed', 'delivering') UNION ALL SELECT id, 3, status, attempts FROM after2 WHERE status = 'failed'""")
def outbox_dispatch_turns(spark, d):
    """Two turns of the dispatch loop an hour apart, and (as turn 3) what waits after them.

    Tables of a turn are kept, as in the loop: else each is computed again wherever the next one names it,
    and one task holds the sorts of all their joins.
    """
    (o,) = model(spark, d, "outbox_event")
    state, n = ("id", "status", "attempt_count", "next_attempt_at"), o.count()
    kept = lambda frame: dealt(cut(frame.select(*state)), n, "id")
    o, waiting, turns = dealt(o.select(*state), n, "id"), None, []
    for turn, incoming in ((1, o.where("id % 3 <> 0")), (2, o.where("id % 3 = 0"))):
        at = outbox.after(F.lit(NOW).cast("timestamp_ntz"), 3600 * (turn - 1))
        pool = kept(delivery.pooled(waiting, incoming)) if waiting is not None else incoming
        claimed = outbox.claimed(outbox.claimable(pool, at), at, f"batch-{turn}")
        kind = F.col("id") % 4
        results = claimed.select("id", F.when(kind == 0, "failed").when(kind == 1, "rejected").otherwise("processed").alias("outcome"), F.when(kind < 2, "no").alias("error"))
        settled = kept(outbox.settle(claimed, results, at))
        waiting = kept(delivery.still_waiting(pool, settled))
        turns.append(settled.select("id", F.lit(turn).alias("turn"), "status", "attempt_count"))
    return turns[0].unionByName(turns[1]).unionByName(waiting.select("id", F.lit(3).alias("turn"), "status", "attempt_count"))


@query("outbox_stale", prelude("outbox_event") + f" SELECT id, claimed_dt FROM outbox_event WHERE status = 'delivering' AND lease_expires_dt < {STAMP}")
def outbox_stale(spark, d):
    return outbox.stale(model(spark, d, "outbox_event")[0], now()).select("id", "claimed_dt")


@query("outbox_by_destination", prelude("outbox_event") + " SELECT id, created_dt FROM outbox_event WHERE destination = '1-URGENT' ORDER BY created_dt DESC, id LIMIT 100")
def outbox_by_destination(spark, d):
    return outbox.by_destination(model(spark, d, "outbox_event")[0], "1-URGENT").select("id", "created_dt")


@query("outbox_by_receipt", prelude("outbox_event") + " SELECT id FROM outbox_event WHERE receipt_machine_uuid = 'receipt-12'")
def outbox_by_receipt(spark, d):
    return outbox.by_receipt(model(spark, d, "outbox_event")[0], "receipt-12").select("id")


@query("outbox_messages", prelude("instance", "outbox_event") + " SELECT o.id, i.euid AS message_euid, i.name AS message_name FROM outbox_event o JOIN instance i ON i.uid = o.message_uid WHERE status = 'pending'")
def outbox_messages(spark, d):
    o, i = model(spark, d, "outbox_event", "instance")
    return outbox.with_message(o.where("status = 'pending'"), i).select("id", "message_euid", "message_name")


@query("outbox_attempts", "SELECT l_orderkey AS outbox_event_id, max(n) AS attempts FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) x GROUP BY l_orderkey")
def outbox_attempts(spark, d):
    (lines,) = model(spark, d, "lineitem")
    return outbox.attempts(lines, F.col("l_orderkey"), [F.col("l_linenumber")]).groupBy("outbox_event_id").agg(F.max("attempt_no").cast("long").alias("attempts"))


@query("outbox_dedupe", prelude("outbox_event") + """, old AS (SELECT DISTINCT domain_code, issuer_app_code, destination, dedupe_key FROM outbox_event WHERE id % 3 = 0)
SELECT min(id) AS id FROM outbox_event o WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM old WHERE old.domain_code = o.domain_code AND old.destination = o.destination AND old.dedupe_key = o.dedupe_key) GROUP BY domain_code, issuer_app_code, destination, dedupe_key""")
def outbox_dedupe(spark, d):
    (o,) = model(spark, d, "outbox_event")
    return outbox.enqueue(o.where("id % 3 = 0"), o.where("id % 3 <> 0"), [F.col("id").asc()]).select("id")


@query("outbox_fanout", prelude("outbox_event") + """
SELECT x.message_uid, dest AS destination FROM (SELECT * FROM outbox_event WHERE status = 'received' AND id < 500) x, (VALUES ('1-URGENT'), ('2-HIGH'), ('lab')) v(dest)
WHERE NOT EXISTS (SELECT 1 FROM outbox_event o WHERE o.domain_code = x.domain_code AND o.issuer_app_code = x.issuer_app_code AND o.destination = dest AND o.dedupe_key = x.dedupe_key)""")
def outbox_fanout(spark, d):
    (o,) = model(spark, d, "outbox_event")
    return outbox.fan_out(o.where("status = 'received' and id < 500"), ["1-URGENT", "2-HIGH", "lab"], o).select("message_uid", "destination")


@query("outbox_fanout_all", prelude("outbox_event") + """
SELECT min(x.message_uid) AS message_uid, dest AS destination FROM (SELECT * FROM outbox_event WHERE status = 'received') x, (VALUES ('1-URGENT'), ('2-HIGH'), ('lab')) v(dest)
WHERE NOT EXISTS (SELECT 1 FROM outbox_event o WHERE o.domain_code = x.domain_code AND o.issuer_app_code = x.issuer_app_code AND o.destination = dest AND o.dedupe_key = x.dedupe_key) GROUP BY x.domain_code, x.issuer_app_code, dest, x.dedupe_key""")
def outbox_fanout_all(spark, d):
    (o,) = model(spark, d, "outbox_event")
    return outbox.fan_out(o.where("status = 'received'"), ["1-URGENT", "2-HIGH", "lab"], o).select("message_uid", "destination")


@query("outbox_backoff", "SELECT i AS attempts, CAST(least(1800, 2 ** least(greatest(i, 0), 31)) AS BIGINT) AS delay_s FROM (VALUES (-5), (0), (1), (2), (7), (31), (999)) v(i)")
def outbox_backoff(spark, d):
    return spark.createDataFrame([(i,) for i in (-5, 0, 1, 2, 7, 31, 999)], "attempts int").select("attempts", scalars.retry_delay(F.col("attempts")).alias("delay_s"))


@query("outbox_requeue", prelude("outbox_event") + f" SELECT id, CASE WHEN id IN (5, 13, 21, 22) AND status = 'dead_letter' THEN 'pending' ELSE status END AS status, CASE WHEN id IN (5, 13, 21, 22) AND status = 'dead_letter' THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN id IN (5, 13, 21, 22) AND status = 'dead_letter' THEN {STAMP} ELSE next_attempt_at END AS next_attempt_at FROM outbox_event WHERE id < 50")
def outbox_requeue(spark, d):
    return outbox.requeue(_outbox(spark, d).where("id < 50"), [5, 13, 21, 22], now(), True).select("id", "status", "attempt_count", "next_attempt_at")


@query("outbox_requeue_all", prelude("outbox_event") + f" SELECT id, CASE WHEN id IN (5, 13, 21, 22) AND status = 'dead_letter' THEN 'pending' ELSE status END AS status, CASE WHEN id IN (5, 13, 21, 22) AND status = 'dead_letter' THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN id IN (5, 13, 21, 22) AND status = 'dead_letter' THEN {STAMP} ELSE next_attempt_at END AS next_attempt_at FROM outbox_event")
def outbox_requeue_all(spark, d):
    return outbox.requeue(_outbox(spark, d), [5, 13, 21, 22], now(), True).select("id", "status", "attempt_count", "next_attempt_at")


@query("inbox_dedupe", prelude("inbox_message") + ", r AS (SELECT *, row_number() OVER (PARTITION BY message_machine_uuid ORDER BY received_seq, receipt_machine_uuid) AS n FROM inbox_message) SELECT message_machine_uuid, receipt_machine_uuid FROM r WHERE n = 1")
def inbox_dedupe(spark, d):
    (i,) = model(spark, d, "inbox_message")
    return outbox.receive(i.where("false"), i, [F.col("received_seq"), F.col("receipt_machine_uuid")]).select("message_machine_uuid", "receipt_machine_uuid")


@query("inbox_transition", """WITH RECURSIVE w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, CASE event_id % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'processed' WHEN 2 THEN 'failed' ELSE 'processing' END AS wanted FROM events WHERE event_id % 7 = 0),
  f(user_id, n, status) AS (SELECT DISTINCT user_id, 0::BIGINT, 'received' FROM w UNION ALL SELECT w.user_id, w.n, CASE WHEN (wanted = 'processing' AND status = 'received') OR (wanted IN ('processed', 'failed') AND status IN ('received', 'processing')) OR wanted = 'rejected' THEN wanted ELSE status END FROM f JOIN w ON w.user_id = f.user_id AND w.n = f.n + 1)
SELECT user_id, max_by(status, n) AS status FROM f GROUP BY user_id""")
def inbox_transition(spark, d):
    (e,) = model(spark, d, "events")
    wanted = F.when(F.col("event_id") % 10 == 0, "rejected").when(F.col("event_id") % 10 == 1, "processed").when(F.col("event_id") % 10 == 2, "failed").otherwise("processing")
    return outbox.inbox_states(e.where("event_id % 7 = 0").select("user_id", "ts", wanted.alias("wanted")), "user_id", "ts", "wanted")


@query("inbox_transition_all", """WITH RECURSIVE e AS (SELECT user_id, ts, CASE event_id % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'processed' WHEN 2 THEN 'failed' ELSE 'processing' END AS wanted FROM events), w AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, wanted) AS n, wanted FROM e),
  f(user_id, n, status) AS (SELECT DISTINCT user_id, 0::BIGINT, 'received' FROM w UNION ALL SELECT w.user_id, w.n, CASE WHEN (wanted = 'processing' AND status = 'received') OR (wanted IN ('processed', 'failed') AND status IN ('received', 'processing')) OR wanted = 'rejected' THEN wanted ELSE status END FROM f JOIN w ON w.user_id = f.user_id AND w.n = f.n + 1)
SELECT user_id, max_by(status, n) AS status FROM f GROUP BY user_id""")
def inbox_transition_all(spark, d):
    (e,) = model(spark, d, "events")
    wanted = F.when(F.col("event_id") % 10 == 0, "rejected").when(F.col("event_id") % 10 == 1, "processed").when(F.col("event_id") % 10 == 2, "failed").otherwise("processing")
    return outbox.inbox_states(e.select("user_id", "ts", wanted.alias("wanted")), "user_id", "ts", "wanted")


# Identifiers

@query("euid_encode", f"SELECT o_orderkey AS k, translate(to_base(o_orderkey + 1, 32), '{identity.DIGITS[10:]}', '{identity.ALPHABET[10:]}') AS body FROM orders")
def euid_encode(spark, d):
    return model(spark, d, "orders")[0].select(F.col("o_orderkey").alias("k"), identity.encode32(F.col("o_orderkey") + 1).alias("body"))


@query("euid_check", prelude("instance") + f" SELECT uid, {check_sql('(domain_code || euid_prefix)')} AS check_char FROM instance")
def euid_check(spark, d):
    return model(spark, d, "instance")[0].select("uid", identity.check_character(F.concat("domain_code", "euid_prefix")).alias("check_char"))


@query("euid_parse", prelude("instance") + " SELECT uid, domain_code AS domain, euid_prefix AS prefix, euid_seq AS seq FROM instance")
def euid_parse(spark, d):
    return model(spark, d, "instance")[0].select("uid", identity.parse(F.col("euid")).alias("p")).select("uid", "p.domain", "p.prefix", "p.seq")


@query("euid_validate", prelude("instance") + " SELECT uid, true AS good, false AS other_domain, false AS altered FROM instance")
def euid_validate(spark, d):
    euid = F.col("euid")
    altered = F.concat(F.left(euid, F.length(euid) - 1), F.when(F.right(euid, F.lit(1)) == "0", "1").otherwise("0"))
    return model(spark, d, "instance")[0].select("uid", identity.is_valid(euid).alias("good"), identity.is_valid(euid, ["T"]).alias("other_domain"), identity.is_valid(altered).alias("altered"))


@query("euid_assign", prelude("instance") + f", n AS (SELECT euid_prefix, max(euid_seq) AS top FROM instance GROUP BY 1), r AS (SELECT uid, domain_code, euid_prefix, top + row_number() OVER (PARTITION BY euid_prefix ORDER BY uid) AS seq FROM instance JOIN n USING (euid_prefix) WHERE category = 'actor') SELECT uid, seq AS euid_seq, {euid_sql('domain_code', 'euid_prefix', 'seq')} AS euid FROM r")
def euid_assign(spark, d):
    (i,) = model(spark, d, "instance")
    rows = i.where("category = 'actor'").select("uid", "domain_code", "euid_prefix")
    return identity.assign(rows, identity.next_sequences(i), ["uid"]).select("uid", "euid_seq", "euid")


@query("prefix_kinds", prelude("template") + " SELECT instance_prefix AS prefix, min(polymorphic_discriminator) AS discriminator FROM template GROUP BY 1 HAVING count(DISTINCT polymorphic_discriminator) = 1")
def prefix_kinds(spark, d):
    return identity.prefix_kind(F.col("prefix"), model(spark, d, "template")[0])


# Contracts, assessments, references

@query("edge_contract_status", prelude("lineage") + """, m AS (SELECT uid, relationship_type, CASE uid % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS kind FROM lineage)
SELECT relationship_type, CASE kind WHEN 1 THEN 'canonical' WHEN 2 THEN 'invalid' ELSE CASE WHEN relationship_type = 'contains' THEN 'legacy_alias' ELSE 'generic' END END AS compliance_status, count(*) AS n FROM m GROUP BY ALL""")
def edge_contract_status(spark, d):
    (e,) = model(spark, d, "lineage")
    good = '{"edge_type": "CONTAINS", "source_euid": "a", "target_euid": "b", "asserted_by_system": "lims", "evidence_refs": ["x"]}'
    bad = '{"edge_type": "CONTAINS", "source_euid": "a", "target_euid": " ", "asserted_by_system": "lims", "evidence_refs": ["x"]}'
    rows = e.withColumn("metadata", F.when(F.col("uid") % 5 == 0, good).when(F.col("uid") % 5 == 1, bad))
    return contracts.contract_status(rows, *contracts.vocabulary(spark)).groupBy("relationship_type", "compliance_status").agg(F.count("*").alias("n"))


_EDGE_NAMES = ["Fulfillment_Item", "beta_pooling_run_output", "amends_result", "run-consumed", " derived_from ", "placed", "has_external_reference", "decides_on"]


@query("edge_canonical_types", prelude("lineage") + """ SELECT (uid % 8)::BIGINT AS name, ['HAS_SLOT', 'RUN_PRODUCED', 'SUPERSEDES', 'RUN_CONSUMED', 'DERIVED_FROM', NULL, 'USES_EVIDENCE', 'DECIDES_ON'][(uid % 8 + 1)::INT] AS edge_type, count(*) AS n FROM lineage GROUP BY ALL""")
def edge_canonical_types(spark, d):
    (e,) = model(spark, d, "lineage")
    named = e.select((F.col("uid") % 8).alias("name"), F.element_at(F.array(*map(F.lit, _EDGE_NAMES)), (F.col("uid") % 8 + 1).cast("int")).alias("relationship_type"))
    return contracts.canonical_types(named, *contracts.vocabulary(spark)).groupBy("name", "edge_type").agg(F.count("*").alias("n"))


@query("assessments", prelude("template", "instance") + """ SELECT coalesce(t.validator_ref, 'UNIVERSAL_PASS@1') AS validator_ref, CASE WHEN coalesce(t.validator_ref, 'UNIVERSAL_PASS@1') = 'UNIVERSAL_PASS@1' THEN 'valid_current' ELSE 'not_evaluated_current' END AS state, count(*) AS n
FROM instance i LEFT JOIN template t ON t.uid = i.template_uid AND NOT t.is_deleted WHERE NOT i.is_deleted GROUP BY ALL""")
def assessments(spark, d):
    i, t = model(spark, d, "instance", "template")
    return contracts.assess_objects(i, t).groupBy("validator_ref", "state").agg(F.count("*").alias("n"))


@query("external_refs", """SELECT n_nationkey AS k, (i - 1)::INT AS ref_index, s AS system, 'R' || n_nationkey AS root_euid, CASE WHEN s = 'alpha' THEN true ELSE false END AS graph_expandable,
  CASE WHEN s = 'alpha' THEN 'http://a/obj/R' || n_nationkey END AS href, CASE WHEN s <> 'alpha' THEN 'Missing required graph metadata: base_url, graph_data_path, object_detail_path_template' END AS reason
FROM nation, (VALUES (1, 'alpha'), (2, 'beta')) v(i, s)""")
def external_refs(spark, d):
    (n,) = model(spark, d, "nation")
    root = F.concat(F.lit("R"), F.col("n_nationkey").cast("string"))
    one = F.struct(F.lit(" beta ").alias("target_system"), root.alias("value"))
    full = F.struct(F.lit("alpha").alias("system"), root.alias("root_euid"), F.lit("http://a/").alias("base_url"), F.lit("/g").alias("graph_data_path"), F.lit("/obj/{euid}").alias("object_detail_path_template"))
    items = F.concat_ws(",", F.to_json(one), F.to_json(full), F.to_json(full))
    rows = n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit('{"properties":{"external_payload":{"graph":['), items, F.lit("]}}}")).alias("json_addl"))
    return contracts.external_references(rows, "properties.external_payload.graph", ["k"]).select("k", "ref_index", "system", "root_euid", "graph_expandable", "href", "reason")


# Templates

_PACK_JSON = """concat('{"name": "', p_name, '", "action_imports": {"core": {"actions": {"act/a/', p_partkey, '/1": {}, "act/b/x/1": {}}}, "plain": "act/c/', p_size, '/1"}, "expected_inputs": ["in/', p_size, '/x/1"], "instantiation_layouts": ',
'[{"child_templates": ["kid/a/', p_partkey, '/1", {"template_code": "kid/b/x/1"}, {"other": 1}]}, {"relationship_type": "none"}], "json_addl": {"expected_outputs": ["out/', p_partkey, '/x/1"], "instantiation_layouts": [{"child_templates": ["kid/c/x/1"]}]}}')"""


@query("template_references", "SELECT p_partkey AS k, unnest(['act/a/' || p_partkey || '/1', 'act/b/x/1', 'act/c/' || p_size || '/1', 'in/' || p_size || '/x/1', 'kid/a/' || p_partkey || '/1', 'kid/b/x/1', 'out/' || p_partkey || '/x/1', 'kid/c/x/1']) AS ref FROM part")
def template_references(spark, d):
    (p,) = model(spark, d, "part")
    # A part is a small row with a long JSON, so a file of few bytes is work for many tasks.
    return dealt(p, p.count()).select(F.col("p_partkey").alias("k"), F.explode(packs.extracted_refs(F.expr(_PACK_JSON))).alias("ref"))


@query("template_ref_missing", """WITH p(code, ref) AS (VALUES ('a/b/c/1', 'a/b/c/2'), ('a/b/c/2', 'x/y/z/1'), ('a/b/c/2', 'x/*/z/1'), ('a/b/c/2', 'x/y'))
SELECT code, ref, CASE WHEN ref = 'x/y' THEN 'error' ELSE 'warning' END AS level FROM p WHERE ref NOT LIKE '%*%' AND ref NOT IN (SELECT code FROM p)""")
def template_ref_missing(spark, d):
    rows = spark.createDataFrame([("s", "a", "b", "c", "1", ["a/b/c/2"]), ("s", "a", "b", "c", "2", ["x/y/z/1", "x/*/z/1", "x/y"])], "source string, category string, type string, subtype string, version string, refs array<string>")
    return templates.missing_references(rows).select("code", "ref", "level")


@query("layout_children", """SELECT 1 AS depth, 12::BIGINT * count(*) AS n FROM nation UNION ALL SELECT 2, 12::BIGINT * 8 * count(*) FROM nation""")
def layout_children(spark, d):
    (n,) = model(spark, d, "nation")
    parents = n.select(F.col("n_nationkey").cast("string").alias("id"), F.lit("box").alias("code"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("tenant_id"))
    layouts = spark.createDataFrame([("box", "plate", 12, None, "contains"), ("plate", "well", 8, "{parent_name}_well_{index}", "contains"), ("well", "box", 1, None, "contains")], "code string, child_code string, count int, name_pattern string, relationship_type string")
    nodes, _ = templates.expand_layouts(parents, layouts)
    return nodes.groupBy("depth").agg(F.count("*").alias("n"))


@query("singleton_targets", prelude("template", "instance") + " SELECT t.uid AS template_uid, max_by(i.uid, i.created_dt::VARCHAR || i.uid) AS uid FROM template t LEFT JOIN instance i ON i.template_uid = t.uid AND NOT i.is_deleted WHERE t.is_singleton AND NOT t.is_deleted GROUP BY t.uid")
def singleton_targets(spark, d):
    i, t = model(spark, d, "instance", "template")
    return templates.singletons(i, t)


@query("schema_drift", "SELECT 'column' AS object_class, 'missing_one' AS name, 'missing' AS state UNION ALL SELECT 'column', column_name, 'unexpected' FROM information_schema.columns WHERE table_name = 'nation' AND column_name <> 'n_name'")
def schema_drift(spark, d):
    (n,) = model(spark, d, "nation")
    found = spark.createDataFrame([("column", c) for c in n.columns], "object_class string, name string")
    expected = spark.createDataFrame([("column", "n_name"), ("column", "missing_one")], "object_class string, name string")
    return templates.drift(expected, found, F.col("name").startswith("n_"), True)


@query("statement_kinds", """SELECT i AS n, k AS kind, t AS hint FROM (VALUES (1, 'SELECT', 'public.a'), (2, 'INSERT', 'b'), (3, 'UPDATE', 'foo'), (4, 'DELETE', 'c'), (5, 'OTHER', '')) v(i, k, t)""")
def statement_kinds(spark, d):
    rows = [(1, "select * from public.a where x"), (2, "INSERT INTO b values"), (3, 'UPDATE "foo" set'), (4, "delete from c"), (5, "VACUUM")]
    sql = F.col("sql")
    return spark.createDataFrame(rows, "n int, sql string").select("n", scalars.statement_kind(sql).alias("kind"), scalars.table_hint(sql).alias("hint"))
