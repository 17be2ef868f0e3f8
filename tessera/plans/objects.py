"""Queries over objects as they are made, changed, linked and shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import contracts, objects, search
from ..sources.star import NOW, model, prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return add


#: Templates that import actions, in Spark's and DuckDB's SQL alike: an order template imports two
#: actions and one that isn't there, a part template one whose definition is empty.
_TEMPLATE_JSON = """CASE type WHEN 'order' THEN '{"properties": {"owner": "nobody", "n": 5, "deep": {"a": [1]}}, "default_status": "open", "action_imports": {"go": "actor/customer/generic/1.0", "see": "actor/supplier/generic/1.0", "no": "a/b/c/1"}}'
WHEN 'part' THEN '{"action_imports": {"stop": "geo/region/generic/1.0"}}' WHEN 'customer' THEN '{"action_definition": {"label": "Go", "n": 1}}' WHEN 'supplier' THEN '{"action_definition": {"label": "See"}}' WHEN 'region' THEN '{"action_definition": {}}' END"""


def _templates(spark, d):
    (t,) = model(spark, d, "template")
    return t.withColumn("json_addl", F.expr(_TEMPLATE_JSON))


@query("instances_from_templates", """SELECT o_orderkey AS key, 'order_instance' AS polymorphic_discriminator, 'workflow' AS category, '1.10' AS version, 6::BIGINT AS template_uid, 'open' AS bstatus, 'c' || o_custkey AS owner, 'BIGINT' AS n_type, CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '5' END AS n,
  '{"a":[1]}' AS deep, '[]' AS audit_log FROM orders UNION ALL SELECT -p_partkey - 1, 'part_instance', 'container', '1.9', 5, 'created', NULL, NULL, NULL, NULL, '[]' FROM part""")
def instances_from_templates(spark, d):
    o, p = model(spark, d, "orders", "part")
    number = F.when(F.col("o_orderkey") % 2 == 0, F.lit(7))
    wanted = o.select(F.col("o_orderkey").alias("key"), F.lit("workflow/order/generic/1.10").alias("code"), F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), number.alias("n"))).alias("properties"))
    wanted = wanted.unionByName(p.select((-F.col("p_partkey") - 1).alias("key"), F.lit("container/part/generic/1.9").alias("code"), F.lit(None).cast("string").alias("properties")))
    wanted = wanted.withColumns({"name": F.lit("n"), "tenant_id": F.lit(None).cast("string")})
    made = objects.instances(wanted, _templates(spark, d))
    at = lambda path: scalars.json_text(F.col("json_addl"), path)
    kind = F.schema_of_variant(F.try_parse_json(at("properties.n")))
    return made.select("key", "polymorphic_discriminator", "category", "version", "template_uid", "bstatus", at("properties.owner").alias("owner"), kind.alias("n_type"), at("properties.n").alias("n"), at("properties.deep").alias("deep"), at("audit_log").alias("audit_log"))


@query("action_groups", prelude("template") + """, d(type, action, label) AS (VALUES ('customer', 'go', 'Go'), ('supplier', 'see', 'See'))
SELECT 6::BIGINT AS template_uid, t.type || '_actions' AS action_group, action, label, t.euid AS source, '0' AS executed FROM template t JOIN d USING (type)""")
def action_groups(spark, d):
    groups = objects.action_groups(_templates(spark, d))
    each = groups.select("template_uid", F.explode(F.from_json("action_groups", "map<string,map<string,string>>")).alias("action_group", "actions")).select("template_uid", "action_group", F.explode("actions").alias("action", "value"))
    at = lambda path: scalars.json_text(F.col("value"), path)
    return each.select("template_uid", "action_group", "action", at("label").alias("label"), at("action_template_euid").alias("source"), at("action_executed").alias("executed"))


@query("bulk_nodes", """SELECT format('lt-r1-t{:04d}-i{:08d}', t, i) AS name, 'loadtest_node' AS subtype, 9::BIGINT AS template_uid, format('tenant_{:04d}', t) AS tenant, i AS ordinal FROM range(1, 6) a(t), range(1, 1001) b(i)""")
def bulk_nodes(spark, d):
    at = lambda path: scalars.json_text(F.col("json_addl"), path)
    return objects.bulk_nodes(spark, "r1", 9, 5, 1000).select("name", "subtype", "template_uid", at("tenant_id").alias("tenant"), at("instance_ord").cast("long").alias("ordinal"))


@query("search_result_fields", prelude("template", "instance", "lineage") + """ SELECT 'lab' AS system, 'lab' AS service, k AS record_type, k AS kind, uid, euid, name, coalesce(nullif(name, ''), euid) AS display_label, category, type, subtype, version, bstatus, nullif(tenant_id, '') AS tenant_id,
  relationship_type, '/object/' || euid AS href, '/api/dag/data?start_euid=' || euid AS graph_href, strftime(created_dt, '%Y-%m-%dT%H:%M:%S') AS created_dt, NULL::VARCHAR AS modified_dt FROM (
  SELECT 'template' AS k, uid, euid, name, category, type, subtype, version, bstatus, tenant_id, NULL AS relationship_type, created_dt FROM template WHERE NOT is_deleted
  UNION ALL SELECT 'instance', uid, euid, name, category, type, subtype, version, bstatus, tenant_id, NULL, created_dt FROM instance WHERE NOT is_deleted
  UNION ALL SELECT 'lineage', uid, euid, name, category, type, subtype, version, bstatus, NULL, relationship_type, created_dt FROM lineage WHERE NOT is_deleted)""")
def search_result_fields(spark, d):
    return objects.search_results(search.results(*model(spark, d, "template", "instance", "lineage")), "lab")


_WISHES = "SELECT euid, CASE uid % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' new ' || (uid % 10) ELSE NULL END AS value FROM template UNION ALL SELECT euid, CASE uid % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' new ' || (uid % 10) ELSE 'x' END FROM instance UNION ALL SELECT 'Z-NONE-1', 'y'"


@query("edit_outcomes", prelude("template", "instance") + f""", w AS ({_WISHES}) SELECT w.euid, trim(coalesce(value, '')) AS value,
  CASE WHEN trim(coalesce(value, '')) = '' THEN 'name is required' WHEN w.euid = 'Z-NONE-1' THEN 'not found' WHEN t.euid IS NOT NULL THEN 'read-only' END AS problem FROM w LEFT JOIN template t USING (euid)""")
def edit_outcomes(spark, d):
    t, i = model(spark, d, "template", "instance")
    wishes = spark.sql(_WISHES.replace("FROM template", "FROM {template}").replace("FROM instance", "FROM {instance}"), template=t, instance=i)
    known = t.select("euid", F.lit("template").alias("record_type")).unionByName(i.select("euid", F.lit("instance").alias("record_type")))
    return objects.edited(known, wishes, "name")


@query("recorded_changes", prelude("instance") + """, old AS (SELECT * FROM instance WHERE uid % 5 <> 0), new AS (SELECT uid, name, CASE WHEN uid % 7 = 0 THEN 'closed' ELSE bstatus END AS bstatus FROM instance WHERE uid % 11 <> 0)
SELECT uid, 'INSERT' AS operation_type, NULL AS column_name, NULL AS new_value FROM new WHERE uid % 5 = 0
UNION ALL SELECT uid, 'UPDATE', 'bstatus', 'closed' FROM new WHERE uid % 5 <> 0 AND uid % 7 = 0
UNION ALL SELECT uid, 'DELETE', NULL, NULL FROM old WHERE uid % 11 = 0 AND NOT is_deleted""")
def recorded_changes(spark, d):
    (i,) = model(spark, d, "instance")
    i = i.withColumn("modified_dt", F.col("created_dt").cast("timestamp_ntz"))
    changed = i.where("uid % 11 <> 0").withColumn("bstatus", F.when(F.col("uid") % 7 == 0, "closed").otherwise(F.col("bstatus")))
    _, rows = objects.recorded("instance", i.where("uid % 5 <> 0"), changed, ["name", "bstatus"], F.lit(NOW).cast("timestamp_ntz"))
    return rows.select("uid", "operation_type", "column_name", "new_value")


@query("changed_table", prelude("instance") + f""" SELECT uid, CASE WHEN uid % 11 <> 0 AND uid % 7 = 0 THEN 'closed' ELSE bstatus END AS bstatus, is_deleted OR uid % 11 = 0 AS is_deleted,
  CASE WHEN uid % 11 <> 0 AND uid % 5 <> 0 AND uid % 7 = 0 THEN TIMESTAMP '{NOW}' ELSE created_dt::TIMESTAMP END AS modified_dt FROM instance WHERE uid % 11 <> 0 OR uid % 5 <> 0""")
def changed_table(spark, d):
    (i,) = model(spark, d, "instance")
    i = i.withColumn("modified_dt", F.col("created_dt").cast("timestamp_ntz"))
    changed = i.where("uid % 11 <> 0").withColumn("bstatus", F.when(F.col("uid") % 7 == 0, "closed").otherwise(F.col("bstatus")))
    after, _ = objects.recorded("instance", i.where("uid % 5 <> 0"), changed, ["name", "bstatus"], F.lit(NOW).cast("timestamp_ntz"))
    return after.select("uid", "bstatus", "is_deleted", "modified_dt")


@query("linked_references", prelude("instance", "lineage") + """ SELECT e.parent_instance_uid AS parent, i.uid AS link_uid, i.euid AS link_euid, e.euid AS lineage_euid, e.relationship_type FROM lineage e JOIN instance i ON i.uid = e.child_instance_uid WHERE NOT e.is_deleted AND i.type = 'part' AND i.uid % 3 < 2""")
def linked_references(spark, d):
    i, e = model(spark, d, "instance", "lineage")
    part = F.col("type") == "part"
    i = i.withColumn("subtype", F.when(part & (F.col("uid") % 3 == 0), " External_ID ").otherwise(F.col("subtype"))).withColumn("category", F.when(part & (F.col("uid") % 3 == 1), "external_reference").otherwise(F.col("category")))
    return objects.linked_references(i, e)


@query("identifier_items", """SELECT p_partkey AS uid, unnest(['{"value":"a' || p_partkey || '"}', '{"value":"b"}']) AS item FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, '{"value":"c' || p_partkey || '"}' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, '{"own":1}' FROM part WHERE p_partkey % 4 = 2""")
def identifier_items(spark, d):
    (p,) = model(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    json = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('{"properties":{"external_identifier":[],"external_reference":[{"value":"a'), k, F.lit('"},{"value":"b"}]}}')))
    json = json.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('{"properties":{"tapdb_external_identifier":{"value":"c'), k, F.lit('"}}}'))).otherwise('{"properties":{"own":1}}')
    rows = p.select(F.col("p_partkey").alias("uid"), json.alias("json_addl"), F.lit("x").alias("category"), F.when(F.col("p_partkey") % 4 == 2, "EXTERNAL_ID").otherwise("y").alias("type"), F.lit(None).cast("string").alias("subtype"))
    return objects.identifier_items(rows)


_LINKS = "SELECT uid AS key, CASE WHEN uid % 13 = 0 THEN 'Z-NONE-1' ELSE euid END AS source_euid, CASE WHEN uid % 5 = 0 THEN ' ' ELSE ' lims ' END AS system, CASE WHEN uid % 7 = 0 THEN NULL ELSE 'F' || uid END AS foreign_uid, 'refers_to' AS relationship_type FROM instance"


@query("external_link_edges", prelude("instance") + """ SELECT uid AS parent_instance_uid, 'lims:F' || uid AS name, 'refers_to' AS relationship_type, NULL AS problem, uid AS key FROM instance WHERE NOT is_deleted AND uid % 13 <> 0 AND uid % 5 <> 0 AND uid % 7 <> 0
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN uid % 5 = 0 AND uid % 7 = 0 THEN 'Missing required external link field(s): system, foreign_uid' WHEN uid % 5 = 0 THEN 'Missing required external link field(s): system' WHEN uid % 7 = 0 THEN 'Missing required external link field(s): foreign_uid' ELSE 'Source object not found' END, uid
FROM instance WHERE is_deleted OR uid % 13 = 0 OR uid % 5 = 0 OR uid % 7 = 0""")
def external_link_edges(spark, d):
    (i,) = model(spark, d, "instance")
    wanted = spark.sql(_LINKS.replace("FROM instance", "FROM {instance}"), instance=i)
    made, edges, refused = objects.external_links(wanted, i)
    rows = edges.join(made.select("key", "name"), "key").withColumn("problem", F.lit(None).cast("string"))
    return rows.unionByName(refused, allowMissingColumns=True).select("parent_instance_uid", "name", "relationship_type", "problem", "key")


@query("template_page", prelude("template") + " SELECT uid, category, type FROM template WHERE NOT is_deleted ORDER BY category, type, subtype, version, uid LIMIT 500")
def template_page(spark, d):
    return objects.template_page(*model(spark, d, "template")).select("uid", "category", "type")


@query("templates_with_deleted", prelude("template") + " SELECT uid, is_deleted FROM template WHERE category = 'geo' AND domain_code = 'Z'")
def templates_with_deleted(spark, d):
    return objects.list_templates(*model(spark, d, "template"), category="geo", include_deleted=True, domain="Z").select("uid", "is_deleted")


@query("inbox_by_uuid", prelude("inbox_message") + " SELECT receipt_machine_uuid, status FROM inbox_message WHERE message_machine_uuid = 'm7'")
def inbox_by_uuid(spark, d):
    return objects.inbox_message(*model(spark, d, "inbox_message"), "m7").select("receipt_machine_uuid", "status")


@query("properties_form", prelude("instance") + """ SELECT uid, '{"owner":"' || json_extract_string(json_addl, '$.properties.owner') || '","shade":' || coalesce('"' || json_extract_string(json_addl, '$.properties.shade') || '"', 'null') || '}' AS properties FROM instance""")
def properties_form(spark, d):
    return objects.properties_form(*model(spark, d, "instance"))


@query("graph_meta", prelude("instance") + " SELECT euid AS start_euid, 4 AS depth, 'lab' AS owner_service, 'instance' AS root_record_type, 'dag:v1' AS contract_version FROM instance WHERE uid = 300000007 AND NOT is_deleted")
def graph_meta(spark, d):
    t, i, e = model(spark, d, "template", "instance", "lineage")
    return objects.graph_meta(search.results(t, i, e).where("uid = 300000007 and record_type = 'instance'"), "lab")


@query("inventory_counts", prelude("template", "instance", "lineage") + " SELECT 'template' AS name, count(*) AS n FROM template UNION ALL SELECT 'instance', count(*) FROM instance UNION ALL SELECT 'lineage', count(*) FROM lineage")
def inventory_counts(spark, d):
    t, i, e = model(spark, d, "template", "instance", "lineage")
    return objects.inventory(template=t, instance=i, lineage=e)


@query("first_of_each_path", "SELECT p_type || '/' || p_brand AS path, min(p_partkey) AS place FROM part GROUP BY ALL")
def first_of_each_path(spark, d):
    (p,) = model(spark, d, "part")
    return objects.first_of_each(p.select(F.concat("p_type", F.lit("/"), "p_brand").alias("path"), F.col("p_partkey").alias("place")))


@query("json_path_set", prelude("instance") + """ SELECT uid, '5' AS set_number, json_extract_string(json_addl, '$.properties.owner') AS owner, json_extract_string(json_addl, '$.rank') AS rank, false AS has_missing FROM instance""")
def json_path_set(spark, d):
    (i,) = model(spark, d, "instance")
    out = scalars.json_with(scalars.json_with(F.col("json_addl"), "properties.fresh", F.lit(5)), "absent.deep", F.lit(1))
    return i.select("uid", out.alias("j")).select("uid", scalars.json_text(F.col("j"), "properties.fresh").alias("set_number"), scalars.json_text(F.col("j"), "properties.owner").alias("owner"), scalars.json_text(F.col("j"), "rank").alias("rank"), F.col("j").contains("absent").alias("has_missing"))


@query("edge_evidence", """SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 IN (0, 1) THEN 'E' || n_nationkey WHEN n_nationkey % 5 = 2 THEN 'R' END AS euid, CASE WHEN n_nationkey % 5 = 2 THEN '3' END AS kept FROM nation""")
def edge_evidence(spark, d):
    (n,) = model(spark, d, "nation")
    k, m = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 5
    refs = F.when(m == 0, F.concat(F.lit('[" E'), k, F.lit(' "]'))).when(m == 1, F.concat(F.lit('[{"euid": "E'), k, F.lit('"}, "x"]'))).when(m == 2, '[{"root_euid": "R", "n": 3}]').when(m == 3, '["a", " "]').otherwise("[]")
    first = F.to_json(contracts.evidence(refs)[0])
    return n.select(F.col("n_nationkey").alias("k"), scalars.json_text(first, "euid").alias("euid"), scalars.json_text(first, "n").alias("kept"))
