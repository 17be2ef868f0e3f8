"""Counts and statistics of the model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from ..model import INBOX_STATUSES, OUTBOX_STATUSES, Scope

_DISTINCT = {
    "template": ["type", "subtype", "category"],
    "instance": ["type", "subtype", "polymorphic_discriminator", "category"],
    "lineage": ["parent_type", "child_type", "polymorphic_discriminator", "category"],
}


def table_stats(frame: DataFrame, kind: str, now: Column, deleted: bool = False, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """One row: total, distinct values, first and last creation, average age in seconds, and for
    templates and instances the singletons. ``deleted`` chooses the deleted rows alone, not both."""
    rows = scope.of(frame).where(F.col("is_deleted") == deleted)
    out = [F.count("*").alias("total"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in _DISTINCT[kind]]]
    out += [F.max("created_dt").alias("latest_created"), F.min("created_dt").alias("earliest_created"), F.avg(seconds_between(now, F.col("created_dt"))).alias("average_age_s")]
    if "is_singleton" in frame.columns:
        out.append(F.count_if("is_singleton").alias("singleton_count"))
    return rows.agg(*out)


def status_summary(frame: DataFrame, statuses: tuple[str, ...], scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """One row with the count of each status, 0 for those without rows."""
    return scope.of(frame).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def outbox_summary(outbox: DataFrame, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    return status_summary(outbox, OUTBOX_STATUSES, scope)


def inbox_summary(inbox: DataFrame, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    return status_summary(inbox, INBOX_STATUSES, scope)


def row_counts(**tables: DataFrame) -> DataFrame:
    """table_name, n_rows, n_live of each table."""
    out = None
    for name, frame in tables.items():
        alive = F.count_if(~F.col("is_deleted")) if "is_deleted" in frame.columns else F.count("*")
        row = frame.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), alive.alias("n_live"))
        out = row if out is None else out.unionByName(row)
    return out


def category_facets(*frames: DataFrame) -> DataFrame:
    """Distinct categories without blanks; deleted rows count."""
    every = frames[0].select("category")
    for f in frames[1:]:
        every = every.unionByName(f.select("category"))
    return every.where(F.trim("category") != "").distinct()


def facets(frame: DataFrame, *columns: str) -> DataFrame:
    """facet, value: distinct values of the columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("f")
    return frame.select(pairs).select("f.*").where("value is not null and value <> ''").distinct()


def top_scope(frame: DataFrame) -> DataFrame:
    return frame.groupBy("domain_code", "issuer_app_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain_code", "issuer_app_code").limit(1)


def duplicates(frame: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Keys that several rows have, their number, and the smallest and largest members."""
    found = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member"))
    return found.where("n > 1")


def duplicate_members(frame: DataFrame, keys: list[str], member: str) -> DataFrame:
    """The keys that several rows have with each row's member, one row per member; nulls are a key as well."""
    rows = frame.select(*keys, member)
    twice = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(twice, same, "left_semi")


def bounds(frame: DataFrame, key: str) -> DataFrame:
    return frame.groupBy(key).agg(F.count("*").alias("n"), F.min("uid").alias("min_uid"), F.max("uid").alias("max_uid"))


def uniqueness_violations(frame: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that a (partial) unique constraint forbids."""
    rows = frame if where is None else frame.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def readiness(**checks: Column) -> Column:
    """Whether all checks hold."""
    out = F.lit(True)
    for c in checks.values():
        out = out & F.coalesce(c, F.lit(False))
    return out
