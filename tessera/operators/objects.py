"""Objects as they are made, changed, linked and shown."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import dealt
from ..functions.scalars import clean, discriminator_of, iso, json_merged, json_sorted, json_text, nonblank, template_code
from ..model import live
from . import audit

KEY = ("category", "type", "subtype", "version")

# Words in category, type or subtype that mark an external identifier.
MARKERS = ("external_identifier", "external_id", "external_reference", "tapdb_external_identifier")
#: Tables whose changes are recorded; delivery tables aren't.
AUDITED = ("template", "instance", "lineage")
MAX_DEPTH = 10
GRAPH_VERSION = "dag:v1"


def instances(wanted: DataFrame, template: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Rows of new instances for ``wanted`` (key, code, name, properties, tenant_id).

    The type columns come from the live template of the code, which must be there; properties are the
    template's with the wanted ones over them; the status is the template's default_status or created.
    ``actions`` (template_uid, action_groups) are the templates' action groups.
    """
    t = live(template).select(template_code(*KEY).alias("code"), F.col("uid").alias("template_uid"), *KEY, "is_singleton", "json_addl", discriminator_of(F.col("instance_polymorphic_identity"), F.col("polymorphic_discriminator")).alias("polymorphic_discriminator"))
    rows = wanted.join(t, "code", "left")
    rows = rows.withColumn("template_uid", F.when(F.col("template_uid").isNull(), F.raise_error(F.concat(F.lit("Template not found: "), "code"))).otherwise(F.col("template_uid")))
    if actions is None:
        rows = rows.withColumn("action_groups", F.lit("{}"))
    else:
        rows = rows.join(actions, "template_uid", "left")
    empty = F.lit("{}")
    properties = json_merged(F.coalesce(json_text(F.col("json_addl"), "properties"), empty), F.coalesce("properties", empty))
    document = F.to_json(F.struct(F.parse_json(properties).alias("properties"), F.parse_json(F.coalesce("action_groups", empty)).alias("action_groups"), F.array().alias("audit_log")))
    status = F.coalesce(json_text(F.col("json_addl"), "default_status"), F.lit("created"))
    return rows.select("key", "name", "tenant_id", "polymorphic_discriminator", *KEY, "template_uid", document.alias("json_addl"), status.alias("bstatus"), "is_singleton")


def action_groups(template: DataFrame) -> DataFrame:
    """template_uid, action_groups: for templates that import actions, the JSON of the groups
    ``{type}_actions``, with each action's definition, where it comes from, and fresh counters.

    Imports of unknown templates, and of those without a definition, are left out. A template's
    actions are as many as it imports.
    """
    t = live(template)
    imports = t.select(F.col("uid").alias("template_uid"), F.explode(F.from_json(json_text(F.col("json_addl"), "action_imports"), "map<string,string>")).alias("action", "code"))
    definition = json_text(F.col("json_addl"), "action_definition")
    known = t.select(template_code(*KEY).alias("code"), F.col("uid").alias("_uid"), F.col("euid").alias("_euid"), F.concat("type", F.lit("_actions")).alias("group"), definition.alias("_definition"))
    known = known.where(F.ltrim("_definition").startswith("{") & (F.size(F.json_object_keys("_definition")) > 0))
    source = F.to_json(F.struct(F.col("_uid").alias("action_template_uid"), F.col("_euid").alias("action_template_euid"), F.col("code").alias("action_template_code")))
    action = json_merged(json_merged(source, F.col("_definition")), F.lit('{"action_executed": "0", "executed_datetime": [], "action_enabled": "1"}'))
    each = imports.join(known, "code").select("template_uid", "group", "action", action.alias("value"))
    groups = each.groupBy("template_uid", "group").agg(F.map_from_entries(F.collect_list(F.struct("action", F.parse_json("value").alias("value")))).alias("actions"))
    return groups.groupBy("template_uid").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("group", "actions")))).alias("action_groups"))


def bulk_nodes(spark: SparkSession, run: str, template_uid: int, tenants: int, per_tenant: int) -> DataFrame:
    """Instances for a load test, ``per_tenant`` for each of the tenants, made where they are used."""
    rows = spark.range(tenants * per_tenant).select((F.expr(f"id div {per_tenant}") + 1).alias("t"), (F.col("id") % per_tenant + 1).alias("i"))
    tenant = F.concat(F.lit("tenant_"), F.lpad(F.col("t").cast("string"), 4, "0"))
    payload = F.struct(F.lit(True).alias("loadtest"), F.lit(run).alias("run_id"), F.lit("base").alias("kind"), tenant.alias("tenant_id"), F.col("t").alias("tenant_ord"), F.col("i").alias("instance_ord"))
    name = F.format_string(f"lt-{run}-t%04d-i%08d", "t", "i")
    fixed = {"polymorphic_discriminator": "generic_instance", "category": "generic", "type": "generic", "subtype": "loadtest_node", "version": "1.0", "bstatus": "active"}
    return rows.select(name.alias("name"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(template_uid).cast("long").alias("template_uid"), F.to_json(payload).alias("json_addl"), F.lit(False).alias("is_singleton"))


def search_results(found: DataFrame, service: str) -> DataFrame:
    """Rows of ``search.results`` with all fields of a search result: service, label, links and ISO times."""
    when = lambda c: iso(F.col(c)) if c in found.columns else F.lit(None).cast("string")
    euid = F.coalesce("euid", F.lit(""))
    return found.select(
        F.lit(service).alias("system"), F.lit(service).alias("service"), "record_type", F.col("record_type").alias("kind"), "uid", "euid", "name", "display_label", *KEY, "bstatus",
        nonblank(F.col("tenant_id")).alias("tenant_id"), "relationship_type", F.concat(F.lit("/object/"), euid).alias("href"), F.concat(F.lit("/api/dag/data?start_euid="), euid).alias("graph_href"),
        when("created_dt").alias("created_dt"), when("modified_dt").alias("modified_dt"),
    )


def edited(objects: DataFrame, wishes: DataFrame, column: str) -> DataFrame:
    """euid, value, problem of each wish (euid, value) to set an object's name or status.

    Values are trimmed and must not be blank, the object (euid, record_type) must be there, and
    templates are read-only; a wish without a problem is to be written.
    """
    known = objects.select("euid", "record_type")
    value = F.trim(F.coalesce("value", F.lit("")))
    problem = F.when(value == "", f"{column} is required").when(F.col("record_type").isNull(), "not found").when(F.col("record_type") == "template", "read-only")
    return wishes.join(known, "euid", "left").select("euid", value.alias("value"), problem.alias("problem"))


def with_edits(objects: DataFrame, edits: DataFrame, column: str) -> DataFrame:
    """Objects after the edits that have no problem; of several for one object the greatest value is taken."""
    good = edits.where("problem is null").groupBy("euid").agg(F.max("value").alias("_value"))
    return objects.join(good, "euid", "left").withColumn(column, F.coalesce("_value", column)).drop("_value").select(*objects.columns)


def recorded(name: str, old: DataFrame, new: DataFrame, columns: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """A table after a change from ``old`` to ``new``, and its audit rows (uid, operation_type, column_name,
    old_value, new_value).

    New rows are recorded, changed ones column by column, and get the time of change; rows that are
    gone stay, flagged as deleted. Tables outside AUDITED change without any of this.

    Both states meet once, dealt by uid to as many tasks as their rows ask for.
    """
    empty = lambda frame: frame.select("uid", "operation_type", *[F.col(c) if c in frame.columns else F.lit(None).cast("string").alias(c) for c in ("column_name", "old_value", "new_value")])
    if name not in AUDITED:
        return new, empty(audit.update_rows(old, old, columns).limit(0))
    n = old.count() + new.count()
    before = dealt(old.select(*[F.col(c).alias(f"_old_{c}") for c in old.columns], F.lit(True).alias("_old")), n, "_old_uid")
    now_there = dealt(new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns], F.lit(True).alias("_new")), n, "_new_uid")
    both = before.join(now_there, F.col("_old_uid") == F.col("_new_uid"), "full")
    made, gone = F.col("_old").isNull(), F.col("_new").isNull()
    differs = [~made & ~gone & ~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")) for c in columns]
    after = {c: F.when(gone, F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")) for c in new.columns}
    stamp = F.when(reduce(or_, differs, F.lit(False)), F.coalesce(now, "_new_modified_dt")).otherwise(F.col("_new_modified_dt"))
    after |= {"is_deleted": gone | F.col("_new_is_deleted"), "modified_dt": F.when(gone, F.col("_old_modified_dt")).otherwise(stamp)}
    # What happened to a row, as numbers, so that values are made from plain columns and unused ones aren't shuffled.
    marks = [F.when(made, -2), F.when(gone & ~F.col("_old_is_deleted"), -1), *[F.when(d, i) for i, d in enumerate(differs)]]
    marked = both.select("*", F.explode(F.array_compact(F.array(*marks))).alias("_mark"))
    chosen = lambda value: F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("_mark") == i, value(c)) for i, c in enumerate(columns)])
    text = lambda side: chosen(lambda c: F.col(f"_{side}_{c}").cast("string"))
    state = F.to_json(F.struct(*[F.col(f"_old_{c}").alias(c) for c in old.columns]))
    rows = marked.select(
        F.coalesce("_new_uid", "_old_uid").alias("uid"), F.when(F.col("_mark") == -2, "INSERT").when(F.col("_mark") == -1, "DELETE").otherwise("UPDATE").alias("operation_type"),
        chosen(F.lit).alias("column_name"), F.when(F.col("_mark") == -1, state).otherwise(text("old")).alias("old_value"), text("new").alias("new_value"),
    )
    return both.select(*[v.alias(c) for c, v in after.items()]), rows


def is_marked() -> Column:
    """Whether category, type or subtype marks an external identifier."""
    return clean(F.col("category")).isin(*MARKERS) | clean(F.col("type")).isin(*MARKERS) | clean(F.col("subtype")).isin(*MARKERS)


def linked_references(instance: DataFrame, lineage: DataFrame) -> DataFrame:
    """parent, link_uid, link_euid, lineage_euid, relationship_type: live edges to marked objects."""
    marked = instance.where(is_marked()).select(F.col("uid").alias("link_uid"), F.col("euid").alias("link_euid"))
    edges = live(lineage).select(F.col("parent_instance_uid").alias("parent"), F.col("child_instance_uid").alias("link_uid"), F.col("euid").alias("lineage_euid"), "relationship_type")
    return edges.join(marked, "link_uid").select("parent", "link_uid", "link_euid", "lineage_euid", "relationship_type")


def identifier_items(objects: DataFrame) -> DataFrame:
    """uid, item: the external identifiers in an object's properties, as JSON: a list's items or the one
    object under a known key, else the properties of a marked object themselves."""
    text = lambda k: json_text(F.col("json_addl"), k)
    usable = lambda c: F.when(~F.regexp_replace(c, r"\s", "").isin("", "{}", "[]", "null", "false", "0"), c)
    raw = F.coalesce(*[usable(text(f"properties.{k}")) for k in ("tapdb_external_identifier", "external_identifier", "external_reference")])
    items = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).when(F.ltrim(raw).startswith("{"), F.array(raw))
    own = F.when(is_marked(), F.array(F.coalesce(text("properties"), F.lit("{}"))))
    return objects.select("uid", F.explode(F.coalesce(items, own)).alias("item"))


def external_links(wanted: DataFrame, instance: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Link objects (key, name, properties), edges to them (parent_instance_uid, key, relationship_type), and refusals.

    ``wanted`` has key, source_euid, system, foreign_uid and relationship_type, of which the last three
    must not be blank; the source must be a live instance.
    """
    fields = ("system", "foreign_uid", "relationship_type")
    missing = F.array_join(F.array_compact(F.array(*[F.when(nonblank(F.col(c)).isNull(), F.lit(c)) for c in fields])), ", ")
    source = live(instance).select(F.col("euid").alias("source_euid"), F.col("uid").alias("parent_instance_uid"))
    problem = F.when(missing != "", F.concat(F.lit("Missing required external link field(s): "), missing)).when(F.col("parent_instance_uid").isNull(), "Source object not found")
    rows = wanted.join(source, "source_euid", "left").withColumn("problem", problem)
    good = rows.where("problem is null").select("key", "parent_instance_uid", *[F.trim(c).alias(c) for c in fields])
    properties = F.to_json(F.struct("system", F.col("foreign_uid").alias("root_euid")))
    return good.select("key", F.concat("system", F.lit(":"), "foreign_uid").alias("name"), properties.alias("properties")), good.select("parent_instance_uid", "key", "relationship_type"), rows.where("problem is not null").select("key", "problem")


def template_page(template: DataFrame, limit: int = 500) -> DataFrame:
    """Live templates in the order of their key, at most ``limit``."""
    return live(template).orderBy(*KEY, "uid").limit(limit)


def list_templates(template: DataFrame, *, category: str | None = None, type_name: str | None = None, include_deleted: bool = False, domain: str | None = None) -> DataFrame:
    """Templates that match what is given; deleted ones beside the others if wanted."""
    rows = template if include_deleted else live(template)
    for column, value in (("category", category), ("type", type_name), ("domain_code", domain)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def inbox_message(inbox: DataFrame, machine_uuid: str) -> DataFrame:
    """The message that a machine sent under a uuid."""
    return inbox.where(F.col("message_machine_uuid") == machine_uuid)


def properties_form(template: DataFrame) -> DataFrame:
    """uid, properties: each template's or instance's properties with sorted keys, ``{}`` without any."""
    return template.select("uid", json_sorted(json_text(F.col("json_addl"), "properties")).alias("properties"))


def graph_meta(root: DataFrame, service: str, depth: int = 4) -> DataFrame:
    """start_euid, depth, owner_service, root_record_type, contract_version of a graph around one object."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 0 to {MAX_DEPTH}")
    return root.select(F.col("euid").alias("start_euid"), F.lit(depth).alias("depth"), F.lit(service).alias("owner_service"), F.col("record_type").alias("root_record_type"), F.lit(GRAPH_VERSION).alias("contract_version"))


def inventory(**tables: DataFrame) -> DataFrame:
    """name, n: the number of rows of each table."""
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def first_of_each(paths: DataFrame) -> DataFrame:
    """path, place: each path once, at its first place."""
    return paths.groupBy("path").agg(F.min("place").alias("place"))
