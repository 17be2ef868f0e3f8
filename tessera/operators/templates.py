"""Template packs: validation, references, instantiation, schema drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import is_token
from ..functions.scalars import child_name, is_template_code, nonblank, template_code
from ..model import live
from .graph import cut

REQUIRED = ("name", "polymorphic_discriminator", "category", "type", "subtype", "version", "instance_prefix")
KEY = ("category", "type", "subtype", "version")
#: Levels of nested layouts.
MAX_DEPTH = 10


def issues(packs: DataFrame) -> DataFrame:
    """source, level, code, message of each rule that a template breaks."""
    code = template_code(*KEY)
    out = []
    for c in REQUIRED:
        out.append(packs.where(nonblank(F.col(c)).isNull()).select("source", F.lit("error").alias("level"), code.alias("code"), F.lit(f"{c} is required").alias("message")))
    out.append(packs.where(nonblank(F.col("instance_prefix")).isNotNull() & ~is_token(F.col("instance_prefix"))).select("source", F.lit("error").alias("level"), code.alias("code"), F.lit("instance_prefix is not a token").alias("message")))
    twice = packs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("source").alias("source")).where("n > 1")
    out.append(twice.select("source", F.lit("error").alias("level"), code.alias("code"), F.lit("duplicate template key").alias("message")))
    return reduce(DataFrame.unionByName, out)


def references(packs: DataFrame) -> DataFrame:
    """source, code, ref: the template codes that templates import or lay out."""
    return packs.select("source", template_code(*KEY).alias("code"), F.explode("refs").alias("ref")).withColumn("ref", F.trim("ref"))


def missing_references(packs: DataFrame, strict: bool = False) -> DataFrame:
    """References to templates that aren't there; codes with * are exempt, badly formed ones are errors."""
    refs = references(packs)
    bad = refs.where(~is_template_code(F.col("ref"), True)).select("source", F.lit("error").alias("level"), "code", "ref")
    there = packs.select(template_code(*KEY).alias("ref")).distinct()
    absent = refs.where(is_template_code(F.col("ref"), True) & ~F.col("ref").contains("*")).join(there, "ref", "left_anti")
    return bad.unionByName(absent.select("source", F.lit("error" if strict else "warning").alias("level"), "code", "ref"))


def unowned(packs: DataFrame, ownership: DataFrame, domain: str, owner: str) -> DataFrame:
    """Templates whose prefix the owner doesn't hold in the domain. ownership: domain, prefix, owner."""
    held = ownership.where((F.col("domain") == domain) & (F.col("owner") == owner)).select(F.upper("prefix").alias("_prefix"))
    return packs.join(held, F.upper("instance_prefix") == F.col("_prefix"), "left_anti")


def layout_problems(layouts: DataFrame) -> DataFrame:
    """Layout rows with a count under 1 or without a relationship, and the problem."""
    problem = F.when(F.coalesce("count", F.lit(1)) < 1, "count must be at least 1").when(nonblank(F.col("relationship_type")).isNull(), "relationship_type is required")
    return layouts.withColumn("problem", problem).where("problem is not null")


def expand_layouts(parents: DataFrame, layouts: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Children that creating the parents makes, level by level, and the edges to them.

    parents: id, code, name, tenant_id. layouts: code (of the parent), child_code, count,
    name_pattern, relationship_type. A child's id is its parent's with layout and index behind it.
    Codes already on a node's path aren't expanded again. Without a number of levels it is an error if
    there is more to make after MAX_DEPTH.
    """
    rows = layouts.select(F.col("code").alias("_code"), "child_code", F.coalesce("count", F.lit(1)).alias("_count"), F.coalesce("name_pattern", F.lit("{parent_name}_{index}")).alias("_pattern"), "relationship_type")
    level = parents.select("id", "code", "name", "tenant_id", F.array("code").alias("path"))
    nodes = edges = None
    for depth in range(1, (MAX_DEPTH if levels is None else levels) + 1):
        made = level.join(rows, (F.col("code") == F.col("_code")) & ~F.array_contains("path", F.col("child_code")))
        made = made.select("*", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("index"))
        child = F.concat("id", F.lit("/"), "child_code", F.lit("#"), F.col("index").cast("string"))
        made = cut(made.select(child.alias("child_id"), F.col("id").alias("parent_id"), "child_code", child_name(F.col("_pattern"), parent_name=F.col("name"), index=F.col("index")).alias("child_name"), "tenant_id", "relationship_type", F.array_append("path", F.col("child_code")).alias("path"), F.lit(depth).alias("depth")))
        if made.isEmpty():
            break
        n = made.select(F.col("child_id").alias("id"), F.col("child_code").alias("code"), F.col("child_name").alias("name"), "tenant_id", "depth")
        e = made.select("parent_id", "child_id", "relationship_type")
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
        level = made.select(F.col("child_id").alias("id"), F.col("child_code").alias("code"), F.col("child_name").alias("name"), "tenant_id", "path")
    else:
        more = rows.where("_count > 0").join(level, (F.col("code") == F.col("_code")) & ~F.array_contains("path", F.col("child_code")))
        if levels is None and not more.isEmpty():
            raise ValueError(f"layouts go deeper than {MAX_DEPTH} levels")
    if nodes is None:
        spark = parents.sparkSession
        return spark.createDataFrame([], "id string, code string, name string, tenant_id string, depth int"), spark.createDataFrame([], "parent_id string, child_id string, relationship_type string")
    return nodes, edges


def actions(objects: DataFrame, templates: DataFrame) -> DataFrame:
    """Actions of objects: action_imports (a map of name to template code) joined with their templates; unknown ones are left out."""
    each = objects.select("uid", F.explode("action_imports").alias("action", "code"))
    known = live(templates).select(template_code(*KEY).alias("code"), F.col("type").alias("group"))
    return each.join(known, "code").select("uid", F.concat("group", F.lit("_actions")).alias("action_group"), "action", "code", F.lit("0").alias("action_executed"))


def action_counts(records: DataFrame) -> DataFrame:
    """Executions of each object's actions and the last one's time."""
    return records.groupBy("uid", "action").agg(F.count("*").cast("string").alias("action_executed"), F.max("executed_dt").alias("last_executed"))


def singletons(instance: DataFrame, template: DataFrame) -> DataFrame:
    """template_uid, uid: the newest live instance of each singleton template; uid is null where one must be made."""
    newest = live(instance).groupBy("template_uid").agg(F.max_by("uid", F.struct("created_dt", "uid")).alias("uid"))
    return live(template).where("is_singleton").select(F.col("uid").alias("template_uid")).join(newest, "template_uid", "left")


def drift(expected: DataFrame, found: DataFrame, owned: Column, strict: bool) -> DataFrame:
    """object_class, name, state: missing objects always, unexpected ones that look owned only if strict."""
    keys = ["object_class", "name"]
    missing = expected.select(*keys).distinct().join(found, keys, "left_anti").withColumn("state", F.lit("missing"))
    if not strict:
        return missing
    extra = found.select(*keys).distinct().join(expected, keys, "left_anti").where(owned).withColumn("state", F.lit("unexpected"))
    return missing.unionByName(extra)


def export(template: DataFrame) -> DataFrame:
    """uid, pack: a template as a pack of one, in JSON."""
    fields = F.struct(*[F.col(c) for c in REQUIRED])
    return template.select("uid", F.to_json(F.struct(F.array(fields).alias("templates"))).alias("pack"))
