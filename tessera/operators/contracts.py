"""Edge contracts, assessments and external references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_merged, json_text, nonblank, object_link
from ..model import DEFAULT_VALIDATOR, live

#: What an external reference's JSON may hold.
REFERENCE = "struct<system:string,target_system:string,service:string,root_euid:string,target_euid:string,value:string,euid:string,tenant_id:string,base_url:string,graph_data_path:string,object_detail_path_template:string,auth_mode:string,label:string,href:string,relationship_type:string>"
AUTH_MODES = ("none", "bearer", "session")

# The canonical edge types, and older names of relationships with the type that each stands for.
EDGE_TYPES = (
    "ORDER_HAS_TEST", "TEST_HAS_SUBJECT", "ORDERED_AS", "PRODUCT_ALLOWS_PLAN_VERSION", "FULFILLS_TEST", "USES_PLAN_VERSION", "HAS_SLOT", "ACCESSION_OBSERVED", "ACCESSION_LINKS_TEST", "CONTAINS",
    "HOLDS_MATERIAL", "MATERIAL_FROM_SUBJECT", "SLOT_SATISFIED_BY", "RUN_FOR_FULFILLMENT", "RUN_CONSUMED", "RUN_PRODUCED", "DERIVED_FROM", "DECIDES_ON", "USES_EVIDENCE", "SUPERSEDES",
)
EDGE_ALIASES = {
    "contains_test": "ORDER_HAS_TEST", "order_patient": "TEST_HAS_SUBJECT", "ordered_as": "ORDERED_AS", "product_allows_plan_version": "PRODUCT_ALLOWS_PLAN_VERSION",
    "fulfillment_run_test": "FULFILLS_TEST", "uses_plan_version": "USES_PLAN_VERSION", "fulfillment_item": "HAS_SLOT", "accession_observed": "ACCESSION_OBSERVED",
    "accession_links_test": "ACCESSION_LINKS_TEST", "contains": "CONTAINS", "holds_material": "HOLDS_MATERIAL", "material_from_subject": "MATERIAL_FROM_SUBJECT",
    "fulfills_atlas_test_fulfillment_item": "SLOT_SATISFIED_BY", "belongs_to_test_fulfillment_item": "SLOT_SATISFIED_BY", "run_for_fulfillment": "RUN_FOR_FULFILLMENT",
    "beta_extraction_run_input": "RUN_CONSUMED", "beta_library_prep_run_input": "RUN_CONSUMED", "beta_pooling_run_input": "RUN_CONSUMED", "beta_sequencing_run_input": "RUN_CONSUMED",
    "beta_extraction_run_output": "RUN_PRODUCED", "beta_library_prep_run_output": "RUN_PRODUCED", "beta_pooling_run_output": "RUN_PRODUCED", "beta_sequencing_run_output": "RUN_PRODUCED",
    "derived_from": "DERIVED_FROM", "produced_by_analysis": "DERIVED_FROM", "uses_evidence": "USES_EVIDENCE", "has_external_reference": "USES_EVIDENCE", "amends_result": "SUPERSEDES",
}


def vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The canonical types (edge_type) and the aliases (alias, edge_type)."""
    return spark.createDataFrame([(t,) for t in EDGE_TYPES], "edge_type string"), spark.createDataFrame(list(EDGE_ALIASES.items()), "alias string, edge_type string")


def canonical_types(edges: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds edge_type: the canonical name of relationship_type, directly or by an alias; else null.

    canonical has edge_type, aliases has alias and edge_type; both are small vocabularies, which are sent
    to the edges, as these have few names and many without one.
    """
    upper = F.replace(F.upper(F.trim("relationship_type")), F.lit("-"), F.lit("_"))
    direct = canonical.select(F.col("edge_type").alias("_direct"))
    known = aliases.select(F.lower("alias").alias("_alias"), F.col("edge_type").alias("_by_alias"))
    joined = edges.join(F.broadcast(direct), upper == F.col("_direct"), "left").join(F.broadcast(known), F.lower(F.trim("relationship_type")) == F.col("_alias"), "left")
    return joined.withColumn("edge_type", F.coalesce("_direct", "_by_alias")).drop("_direct", "_alias", "_by_alias")


def contract_status(edges: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds edge_type and compliance_status: canonical or invalid for rows with edge metadata,
    legacy_alias for known names without it, generic for others. metadata is a JSON column."""
    named = canonical_types(edges, canonical, aliases)
    meta = F.col("metadata")
    text = lambda k: nonblank(json_text(meta, k))
    allowed = canonical.select(F.col("edge_type").alias("_stated"))
    stated = named.join(F.broadcast(allowed), text("edge_type") == F.col("_stated"), "left")
    evidence = F.from_json(json_text(meta, "evidence_refs"), "array<string>")
    complete = F.col("_stated").isNotNull() & text("source_euid").isNotNull() & text("target_euid").isNotNull() & text("asserted_by_system").isNotNull() & (F.coalesce(F.size(evidence), F.lit(0)) > 0)
    status = F.when(meta.isNotNull() & complete, "canonical").when(meta.isNotNull(), "invalid").when(F.col("edge_type").isNotNull(), "legacy_alias").otherwise("generic")
    return stated.withColumn("compliance_status", status).drop("_stated")


def evidence(refs: Column) -> Column:
    """A JSON list of evidence as objects with an euid: texts become one, objects may name it root_euid.

    Null for what is no list, is empty, or has an item that names nothing.
    """
    items = F.from_json(refs, "array<variant>")
    text = lambda v, path: F.trim(F.try_variant_get(v, path, "string"))
    object_ = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    named = lambda v: F.when(object_(v), F.coalesce(F.nullif(text(v, "$.euid"), F.lit("")), text(v, "$.root_euid"))).when(F.schema_of_variant(v) == "STRING", text(v, "$"))
    good = (F.size(items) > 0) & F.forall(items, lambda v: F.coalesce(named(v), F.lit("")) != "")
    whole = lambda v: F.when(object_(v), F.parse_json(json_merged(F.to_json(v), F.to_json(F.create_map(F.lit("euid"), named(v)))))).otherwise(F.parse_json(F.to_json(F.create_map(F.lit("euid"), named(v)))))
    return F.when(F.ltrim(refs).startswith("[") & good, F.transform(items, whole))


def creation_guard(edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that may be created, and those refused: a canonical name needs metadata."""
    named = edges.join(F.broadcast(canonical.select(F.col("edge_type").alias("_strict"))), F.col("relationship_type") == F.col("_strict"), "left")
    refused = F.col("_strict").isNotNull() & F.col("metadata").isNull()
    return named.where(~refused).drop("_strict"), named.where(refused).drop("_strict")


def assessment(validator_ref: Column) -> Column:
    """State of a piece of evidence under its validator: the default one accepts all, others aren't evaluated."""
    ref = F.coalesce(nonblank(validator_ref), F.lit(DEFAULT_VALIDATOR))
    default = ref == DEFAULT_VALIDATOR
    return F.struct(
        ref.alias("validator_ref"),
        F.when(default, "valid_current").otherwise("not_evaluated_current").alias("state"),
        F.when(default, "universal_pass").otherwise("validator_not_implemented").alias("finding"),
        F.when(default, "info").otherwise("warning").alias("severity"),
    )


def assess_objects(instance: DataFrame, template: DataFrame) -> DataFrame:
    """uid and the assessment of each live instance under its template's validator; without a live template the default."""
    t = live(template).select(F.col("uid").alias("template_uid"), "validator_ref")
    return live(instance).select("uid", "template_uid").join(t, "template_uid", "left").select("uid", assessment(F.col("validator_ref")).alias("a")).select("uid", "a.*")


def repair_record(subject: DataFrame, reason: str, evidence: Column) -> DataFrame:
    """Rows of evidence about subjects, which stay as they are."""
    return subject.select(F.col("euid").alias("subject_euid"), F.lit(reason).alias("reason"), evidence.alias("evidence"), F.lit(False).alias("subject_mutated"))


def external_references(objects: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """References in a JSON list or object at a path of json_addl, cleaned, completed, each once per
    row and numbered. keys identify a row; of equal (system, root, tenant) the first stays."""
    raw = json_text(F.col("json_addl"), path)
    items = F.when(raw.startswith("["), F.from_json(raw, f"array<{REFERENCE}>")).otherwise(F.array_compact(F.array(F.from_json(raw, REFERENCE))))
    rows = objects.select(*keys, F.posexplode(items).alias("position", "r"))
    first = lambda *names: F.coalesce(*[nonblank(F.col(f"r.{n}")) for n in names], F.lit(""))
    rows = rows.select(*keys, "position", first("system", "target_system", "service").alias("system"), first("root_euid", "target_euid", "value", "euid").alias("root_euid"), nonblank(F.col("r.tenant_id")).alias("tenant_id"), first("base_url").alias("base_url"), first("graph_data_path").alias("graph_data_path"), first("object_detail_path_template").alias("object_detail_path_template"), F.coalesce(nonblank(F.col("r.auth_mode")), F.lit("none")).alias("auth_mode"), nonblank(F.col("r.label")).alias("label"), nonblank(F.col("r.href")).alias("href"))
    needed = ["system", "root_euid", "base_url", "graph_data_path", "object_detail_path_template"]
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in needed], F.when(~F.col("auth_mode").isin(*AUTH_MODES), F.lit("auth_mode"))))
    link = F.when((F.col("base_url") != "") & (F.col("object_detail_path_template") != "") & (F.col("root_euid") != ""), object_link(F.col("base_url"), F.col("object_detail_path_template"), F.col("root_euid")))
    label = F.when((F.col("system") != "") & (F.col("root_euid") != ""), F.concat("system", F.lit(":"), "root_euid")).otherwise("external reference")
    rows = rows.withColumns({"missing": missing, "href": F.coalesce("href", link), "label": F.coalesce("label", label), "system": F.coalesce(F.nullif("system", F.lit("")), F.lit("external"))})
    rows = rows.withColumn("graph_expandable", F.size("missing") == 0).withColumn("reason", F.when(F.size("missing") > 0, F.concat(F.lit("Missing required graph metadata: "), F.array_join("missing", ", "))))
    once = Window.partitionBy(*keys, "system", "root_euid", "tenant_id").orderBy("position")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    order = Window.partitionBy(*keys).orderBy("system", "label", "root_euid", F.coalesce("tenant_id", F.lit("")))
    return rows.withColumn("ref_index", F.row_number().over(order) - 1).select(*keys, "ref_index", "system", "root_euid", "tenant_id", "label", "href", "graph_expandable", "reason")
