"""Queries over details, ownership and readiness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..model import live
from ..operators import detail, graph, outbox, search, stats, templates
from ..sources.star import model, prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return add


@query("object_detail", prelude("instance") + " SELECT uid, euid, 'instance' AS record_type, coalesce(nullif(name, ''), euid) AS display_label, strftime(created_dt, '%Y-%m-%dT%H:%M:%S') AS created, '/lab/object/' || euid AS href, category || '/' || type || '/' || subtype || '/' || version AS code FROM instance")
def object_detail(spark, d):
    (i,) = model(spark, d, "instance")
    return detail.object_detail(i.withColumn("record_type", F.lit("instance")), "lab")


#: JSON of objects with something to say about their place in a drawn graph: all keys, some, none, no object.
_GRAPH_JSON = """CASE uid % 4 WHEN 0 THEN '{"properties": {"graph": {"role": "hub", "expected_fanout_max": ' || (uid % 9) || ', "collapse_by_default": true, "fanout_reason": "r' || (uid % 5) || '", "color": "red"}}}'
WHEN 1 THEN '{"properties": {"graph": {"role": "leaf' || (uid % 3) || '"}}}' WHEN 2 THEN json_addl ELSE '{"properties": {"graph": "none"}}' END"""


@query("graph_presentation", prelude("instance") + """ SELECT uid, CASE WHEN uid % 4 = 0 THEN 'hub' WHEN uid % 4 = 1 THEN 'leaf' || (uid % 3) END AS role, CASE WHEN uid % 4 = 0 THEN (uid % 9)::VARCHAR END AS expected_fanout_max,
CASE WHEN uid % 4 = 0 THEN 'true' END AS collapse_by_default, CASE WHEN uid % 4 = 0 THEN 'r' || (uid % 5) END AS fanout_reason FROM instance""")
def graph_presentation(spark, d):
    (i,) = model(spark, d, "instance")
    return detail.presentation(i.withColumn("json_addl", F.expr(_GRAPH_JSON)))


QUERIES["graph_presentation_all"], ORACLES["graph_presentation_all"] = QUERIES["graph_presentation"], ORACLES["graph_presentation"]


@query("template_rows", prelude("template") + " SELECT uid, category || '/' || type || '/' || subtype || '/' || version AS code, validator_ref FROM template")
def template_rows(spark, d):
    return detail.template_rows(*model(spark, d, "template"))


@query("ready_count", prelude("instance") + " SELECT least(count(*), 500) AS n FROM instance WHERE NOT is_deleted")
def ready_count(spark, d):
    return detail.saturated_count(live(*model(spark, d, "instance")), 500)


@query("owner_problems", prelude("template") + " SELECT 'Z' AS domain, instance_prefix AS prefix, 'lab' AS owner, CASE WHEN instance_prefix IN ('RGN', 'NTN') THEN 'held by another' ELSE 'unclaimed' END AS problem FROM template WHERE instance_prefix NOT IN ('CST')")
def owner_problems(spark, d):
    (t,) = model(spark, d, "template")
    held = spark.createDataFrame([("Z", "rgn", "geo"), ("Z", "NTN", "geo"), ("Z", "CST", "lab")], "domain string, prefix string, owner string")
    return detail.owner_problems(t.select(F.lit("Z").alias("domain"), F.col("instance_prefix").alias("prefix"), F.lit("lab").alias("owner")), held)


@query("unregistered_domains", prelude("outbox_event") + " SELECT DISTINCT domain_code AS domain FROM outbox_event WHERE domain_code <> 'Z'")
def unregistered_domains(spark, d):
    (o,) = model(spark, d, "outbox_event")
    return detail.unregistered(o.select(F.col("domain_code").alias("domain")), spark.createDataFrame([("Z",)], "domain string"))


@query("pending_steps", "SELECT n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def pending_steps(spark, d):
    (n,) = model(spark, d, "nation")
    names = n.select(F.col("n_name").alias("name"), "n_nationkey")
    return detail.pending(names, names.where("n_nationkey % 3 = 0"))


@query("nations_of_both", "SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_of_both(spark, d):
    c, s = model(spark, d, "customer", "supplier")
    return detail.in_both(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")))


@query("never_backwards", prelude("instance") + ", n AS (SELECT euid_prefix AS prefix, max(euid_seq) + 1 AS next_seq FROM instance GROUP BY 1), s(prefix, next_seq) AS (VALUES ('RGN', 3::BIGINT), ('NTN', 1000::BIGINT), ('NEW', 7::BIGINT)) SELECT prefix, greatest(n.next_seq, s.next_seq) AS next_seq FROM n FULL JOIN s USING (prefix)")
def never_backwards(spark, d):
    (i,) = model(spark, d, "instance")
    state = spark.createDataFrame([("RGN", 3), ("NTN", 1000), ("NEW", 7)], "prefix string, next_seq long")
    return identity.never_backwards(identity.next_sequences(i), state)


@query("external_namespace", "SELECT 'ext::lab::global::' || n_name AS source, 'ext::lab::global::' || r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'Z-CST-1', 'ext::lab::global::ROOT'")
def external_namespace(spark, d):
    n, r = model(spark, d, "nation", "region")
    nodes = n.select(F.col("n_name").alias("id")).unionByName(r.select(F.col("r_name").alias("id")))
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return graph.namespaced(nodes, edges, "lab", None, "Z-CST-1", "ROOT")[1]


@query("required_templates", prelude("template") + " SELECT 'geo' AS category, 'region' AS type, 'generic' AS subtype, '1.0' AS version, 'XXX' AS instance_prefix, 'prefix mismatch' AS problem UNION ALL SELECT 'geo', 'nation', 'generic', '1.0', 'NTN', 'missing' WHERE (SELECT count(*) FROM template WHERE type = 'nation' AND is_deleted) = 1")
def required_templates(spark, d):
    (t,) = model(spark, d, "template")
    wanted = spark.createDataFrame([("geo", "region", "generic", "1.0", "XXX"), ("geo", "nation", "generic", "1.0", "NTN"), ("actor", "customer", "generic", "1.0", "CST")], "category string, type string, subtype string, version string, instance_prefix string")
    return search.required(t, wanted)


@query("foreign_prefixes", prelude("template") + " SELECT uid FROM template WHERE instance_prefix <> 'CST'")
def foreign_prefixes(spark, d):
    (t,) = model(spark, d, "template")
    held = spark.createDataFrame([("Z", "CST", "lab"), ("T", "RGN", "lab")], "domain string, prefix string, owner string")
    return templates.unowned(t, held, "Z", "lab").select("uid")


@query("scope_violations", prelude("instance") + " SELECT domain_code, category, count(*) AS n FROM instance WHERE is_singleton GROUP BY ALL HAVING count(*) > 1")
def scope_violations(spark, d):
    return stats.uniqueness_violations(model(spark, d, "instance")[0], ["domain_code", "category"], F.col("is_singleton"))


@query("events_of_message", prelude("instance", "outbox_event") + " SELECT o.id, i.name AS message_name FROM outbox_event o JOIN instance i ON i.uid = o.message_uid WHERE i.euid_seq = 13")
def events_of_message(spark, d):
    i, o = model(spark, d, "instance", "outbox_event")
    return outbox.with_message(o, i.where("euid_seq = 13")).select("id", "message_name")
