"""Object search, lookup, lists and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean, json_text, nonblank, role_of
from ..model import live

_FIELDS = ["euid", "name", "category", "type", "subtype", "version", "bstatus", "relationship_type"]


def results(template: DataFrame, instance: DataFrame, lineage: DataFrame) -> DataFrame:
    """Live rows of the three tables as search results, tagged with their kind; what a table lacks is null."""
    out = None
    for kind, frame in (("template", template), ("instance", instance), ("lineage", lineage)):
        wanted = ["uid", *_FIELDS, "tenant_id", "domain_code", "created_dt"]
        row = live(frame).select(F.lit(kind).alias("record_type"), *[F.col(c) for c in wanted if c in frame.columns])
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    label = F.coalesce(F.nullif("name", F.lit("")), F.col("euid"))
    return out.withColumn("display_label", label).withColumn("tenant_id", F.nullif("tenant_id", F.lit("")))


def search(found: DataFrame, *, q: str = "", euid: str = "", record_type: str = "", category: str = "", type_name: str = "", subtype: str = "", tenant_id: str = "", relationship_type: str = "") -> DataFrame:
    """Results that match: ``q`` anywhere in the joined fields (so across fields), the others exactly;
    case and outer spaces don't count, and blank filters don't filter."""
    wanted = {"euid": euid, "record_type": record_type, "category": category, "type": type_name, "subtype": subtype, "tenant_id": tenant_id, "relationship_type": relationship_type}
    for column, value in wanted.items():
        if value.strip():
            found = found.where(clean(F.col(column)) == value.strip().lower())
    if q.strip():
        found = found.where(F.concat_ws(" ", *[clean(F.col(c)) for c in _FIELDS]).contains(q.strip().lower()))
    return found


def newest_first(found: DataFrame, limit: int) -> DataFrame:
    """At most 1 to 100 results; created, kind and identifier all descending, without time last."""
    return found.orderBy(F.col("created_dt").desc_nulls_last(), F.desc("record_type"), F.desc("euid")).limit(min(100, max(1, limit)))


def simple_search(template: DataFrame, instance: DataFrame, lineage: DataFrame, q: str, limit: int) -> DataFrame:
    """Results with the query in "euid name"; none for a blank query."""
    found = results(template, instance, lineage)
    q = q.strip().lower()
    hit = F.concat_ws(" ", clean(F.col("euid")), clean(F.col("name"))).contains(q) if q else F.lit(False)
    return listed(found.where(hit), limit)


def listed(found: DataFrame, limit: int) -> DataFrame:
    """Created descending (without time: as at the epoch), then kind and identifier ascending."""
    return found.orderBy(F.coalesce("created_dt", F.expr("timestamp_ntz'1970-01-01'")).desc(), "record_type", "euid").limit(limit)


def complex_search(template: DataFrame, instance: DataFrame, lineage: DataFrame, *, kind: str = "", category: str = "", type_name: str = "", subtype: str = "", name_like: str = "", euid_like: str = "", limit: int = 20) -> DataFrame:
    """Exact filters on kind, category, type and subtype, parts of name and identifier."""
    found = search(results(template, instance, lineage), record_type=kind, category=category, type_name=type_name, subtype=subtype)
    for column, part in (("name", name_like), ("euid", euid_like)):
        if part.strip():
            found = found.where(clean(F.col(column)).contains(part.strip().lower()))
    return listed(found, limit)


def by_euid(template: DataFrame, instance: DataFrame, lineage: DataFrame, euid: str) -> DataFrame:
    """The live object of an identifier: a template before an instance before an edge."""
    found = results(template, instance, lineage).where(F.col("euid") == euid.strip())
    order = F.when(F.col("record_type") == "template", 0).when(F.col("record_type") == "instance", 1).otherwise(2)
    return found.orderBy(order, "uid").limit(1)


def page(frame: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of 1 to 500 rows in a total order."""
    size = min(500, max(1, size))
    return frame.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def pages(frame: DataFrame, size: int) -> DataFrame:
    return frame.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(min(500, max(1, size)))).cast("long").alias("pages"))


def members(frame: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """Rows where each criterion equals the column of that name or the top-level JSON value."""
    if not criteria:
        raise ValueError("criteria are needed")

    def holds(key: str, value: str) -> Column:
        json = json_text(F.col("json_addl"), key) == value
        return F.coalesce(json | (F.col(key).cast("string") == value) if key in frame.columns else json, F.lit(False))

    return frame.where(reduce(lambda a, b: a & b, [holds(k, v) for k, v in criteria.items()]))


def template_by_code(template: DataFrame, code: str, domain: str) -> DataFrame:
    """Live templates of category/type/subtype/version, where * stands for any segment."""
    parts = [p.strip() for p in code.strip("/ ").split("/")]
    if len(parts) != 4 or not all(parts):
        raise ValueError("a template code has four segments")
    found = live(template).where(F.col("domain_code") == domain)
    for column, part in zip(("category", "type", "subtype", "version"), parts, strict=True):
        if part != "*":
            found = found.where(F.col(column) == part)
    return found


def highest_version(template: DataFrame, keys: list[str]) -> DataFrame:
    """The template with the highest version of each key, versions compared as texts."""
    return template.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc("uid")))).where("_n = 1").drop("_n")


def required(template: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted templates (category, type, subtype, version, instance_prefix) that are missing or have another prefix."""
    keys = ["category", "type", "subtype", "version"]
    there = live(template).select(*keys, F.col("instance_prefix").alias("_prefix"))
    problem = F.when(F.col("_prefix").isNull(), "missing").when(F.col("_prefix") != F.col("instance_prefix"), "prefix mismatch")
    return wanted.join(there, keys, "left").withColumn("problem", problem).where("problem is not null").drop("_prefix")


def users(instance: DataFrame, login: str | None = None, active_only: bool = True) -> DataFrame:
    """Users, kept as actor/user instances, mapped to their attributes and sorted by login."""
    text = lambda k: nonblank(json_text(F.col("json_addl"), k))
    rows = live(instance).where((F.col("category") == "actor") & (F.col("type") == "user"))
    rows = rows.select("uid", F.coalesce(text("login_identifier"), text("email")).alias("login"), text("email").alias("email"), role_of(text("role")).alias("role"), F.coalesce(text("is_active").try_cast("boolean"), F.lit(True)).alias("is_active"))
    if login is not None:
        rows = rows.where((clean(F.col("login")) == login.strip().lower()) | (clean(F.col("email")) == login.strip().lower()))
    return (rows.where("is_active") if active_only else rows).orderBy(clean(F.col("login")), "uid")
