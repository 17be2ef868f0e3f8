"""Object details, presentation, ownership and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso, json_text, nonblank, template_code
from ..model import DEFAULT_VALIDATOR, live

# What an object may say about its place in a drawn graph.
PRESENTATION = ("role", "expected_fanout_max", "collapse_by_default", "fanout_reason")


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A request's number within its bounds; the default for none."""
    return default if value is None else min(high, max(low, value))


def one_of(value: str | None, allowed: tuple[str, ...], default: str) -> str:
    """A request's word if it is allowed, whatever its case."""
    word = (value or "").strip().lower()
    return word if word in allowed else default


def object_detail(found: DataFrame, service: str) -> DataFrame:
    """Detail rows of search results: label, ISO time, and the path of the object within a service."""
    label = F.coalesce(F.nullif("name", F.lit("")), F.col("euid"))
    return found.select("uid", "euid", "record_type", label.alias("display_label"), iso(F.col("created_dt")).alias("created"), F.concat(F.lit(f"/{service}/object/"), "euid").alias("href"), template_code("category", "type", "subtype", "version").alias("code"))


def presentation(objects: DataFrame, path: str = "properties.graph") -> DataFrame:
    """uid and the known presentation keys of each object's JSON; other keys are dropped."""
    return objects.select("uid", *[json_text(F.col("json_addl"), f"{path}.{k}").alias(k) for k in PRESENTATION])


def template_rows(template: DataFrame) -> DataFrame:
    """Templates with their code and the validator that holds for them."""
    return template.select("uid", template_code("category", "type", "subtype", "version").alias("code"), F.coalesce(nonblank(F.col("validator_ref")), F.lit(DEFAULT_VALIDATOR)).alias("validator_ref"))


def saturated_count(frame: DataFrame, most: int) -> DataFrame:
    """The number of rows, or ``most`` if there are more."""
    return frame.limit(most).agg(F.count("*").alias("n"))


def owner_problems(wanted: DataFrame, ownership: DataFrame) -> DataFrame:
    """Wanted (domain, prefix, owner) rows that nobody or somebody else holds."""
    held = ownership.select("domain", F.upper("prefix").alias("prefix"), F.col("owner").alias("_holder"))
    joined = wanted.withColumn("prefix", F.upper("prefix")).join(held, ["domain", "prefix"], "left")
    problem = F.when(F.col("_holder").isNull(), "unclaimed").when(F.col("_holder") != F.col("owner"), "held by another")
    return joined.select("domain", "prefix", "owner", problem.alias("problem")).where("problem is not null")


def unregistered(domains: DataFrame, registry: DataFrame) -> DataFrame:
    return domains.select("domain").distinct().join(registry.select("domain"), "domain", "left_anti")


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Names of steps that haven't been applied, in their order."""
    return files.select("name").distinct().join(applied.select("name"), "name", "left_anti").orderBy("name")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both frames."""
    return a.intersect(b)


def changed_immutable(wanted: Column, immutable: list[str]) -> Column:
    """The immutable fields among those that a change wants to set."""
    return F.array_sort(F.array_intersect(wanted, F.array(*map(F.lit, immutable))))


def parsed_list(text: Column) -> Column:
    """Identifiers of a comma-separated text, trimmed, without blanks and repeats, in their order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def missing_singletons(wanted: DataFrame, instance: DataFrame, key: str) -> DataFrame:
    """Wanted singletons (ref) for which no live instance has the reference in its JSON."""
    there = live(instance).select(json_text(F.col("json_addl"), key).alias("ref")).where("ref is not null").distinct()
    return wanted.join(there, "ref", "left_anti")
