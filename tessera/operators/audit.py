"""Audit trail and change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import among, cut
from ..functions.scalars import clean
from ..model import Scope, live

_SHOWN = ["name", "polymorphic_discriminator", "category", "type", "subtype", "bstatus"]


def trail(audit: DataFrame, template: DataFrame, instance: DataFrame, lineage: DataFrame, compat: bool = False) -> DataFrame:
    """Audit rows with the properties of the row they are about.

    uids of the three tables overlap, so a row joins only the table that it names; ``compat`` joins all
    three by uid alone and prefers the template's, then the instance's values.
    """
    out = audit
    for name, frame in (("template", template), ("instance", instance), ("lineage", lineage)):
        side = frame.select(F.col("uid").alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in _SHOWN])
        match = F.col("rel_table_uid_fk") == F.col(f"_{name}")
        out = out.join(side, match if compat else match & (F.col("rel_table_name") == name), "left")
    columns = ["uid", "rel_table_euid_fk", "changed_by", "operation_type", "changed_at"]
    return out.select(*columns, *[F.coalesce(*[F.col(f"_{t}_{c}") for t in ("template", "instance", "lineage")]).alias(c) for c in _SHOWN])


def query_trail(audit: DataFrame, template: DataFrame, instance: DataFrame, lineage: DataFrame, *, changed_by: str | None = None, euid: str | None = None, since: Column | None = None, scope: Scope = Scope(), limit: int = 500, descending: bool = True, compat: bool = False) -> DataFrame:  # noqa: B008
    """Filtered audit trail in the order of change, at most ``limit`` rows; matches are exact.

    The rows are chosen before the joins, so only ``limit`` of them meet the other tables, and of those
    only the rows that they are about.
    """
    rows = scope.of(audit)
    for column, value in (("changed_by", changed_by), ("rel_table_euid_fk", euid)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("changed_at") >= since)
    order = [F.col("changed_at").desc() if descending else F.col("changed_at").asc(), F.col("uid").asc()]
    rows = cut(rows.orderBy(*order).limit(limit))
    about = rows.select(F.col("rel_table_uid_fk").alias("uid")).distinct()
    return trail(rows, *[among(t, "uid", about) for t in (template, instance, lineage)], compat).orderBy(*order)


def object_audit(audit: DataFrame, euid: str, operation: str | None = None, limit: int = 100) -> DataFrame:
    """Live audit rows of an object, newest first; case and outer spaces don't count."""
    rows = live(audit).where(clean(F.col("rel_table_euid_fk")) == euid.strip().lower())
    return _newest(rows if operation is None else rows.where(F.col("operation_type") == operation), limit)


def user_audit(audit: DataFrame, user: str, operation: str | None = None, limit: int = 100) -> DataFrame:
    """Live audit rows of a user, newest first; case and outer spaces don't count."""
    rows = live(audit).where(clean(F.col("changed_by")) == user.strip().lower())
    return _newest(rows if operation is None else rows.where(F.col("operation_type") == operation), limit)


def effective_user(wanted: str | None, own: str, is_admin: bool) -> str:
    """Whose trail a user may see: everyone's only as an administrator."""
    return (wanted or own) if is_admin else own


def _newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.col("changed_at").desc(), "uid").limit(limit)


def latest_revisions(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """The last audit row of each entity; of these the newest ``limit``. Combined before the shuffle."""
    key = ["rel_table_name", "rel_table_uid_fk"]
    last = audit.groupBy(*key).agg(F.max(F.struct("changed_at", "uid", "operation_type", "changed_by")).alias("last"))
    out = last.select(*key, "last.*")
    return out if limit is None else out.orderBy(F.col("changed_at").desc(), F.col("uid").desc()).limit(limit)


def update_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """One UPDATE row per changed column of a row in both states; typed values are compared, null-safe."""
    o = old.select("uid", *[F.col(c).alias(f"_old_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_old_{c}").cast("string").alias("old_value"), F.col(c).cast("string").alias("new_value"), (~F.col(f"_old_{c}").eqNullSafe(F.col(c))).alias("changed")) for c in columns])
    rows = o.join(new.select("uid", *columns), "uid").select("uid", F.explode(pairs).alias("c"))
    return rows.where("c.changed").select("uid", F.lit("UPDATE").alias("operation_type"), "c.column_name", "c.old_value", "c.new_value")


def insert_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """One INSERT row for each row that is new."""
    return new.select("uid").join(old.select("uid"), "uid", "left_anti").select("uid", F.lit("INSERT").alias("operation_type"))


def soft_delete(frame: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frame with the rows flagged as deleted, and their DELETE rows with the old state as JSON."""
    hit = uids.select(F.col("uid").alias("_uid")).distinct()
    joined = frame.join(hit, F.col("uid") == F.col("_uid"), "left")
    gone = F.col("_uid").isNotNull()
    after = joined.withColumn("is_deleted", F.when(gone, F.lit(True)).otherwise(F.col("is_deleted"))).drop("_uid")
    rows = joined.where(gone & ~F.col("is_deleted")).select("uid", F.lit("DELETE").alias("operation_type"), F.to_json(F.struct(*[F.col(c) for c in frame.columns])).alias("old_value"))
    return after, rows


def touched(old: DataFrame, new: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """uid, modified_dt: the new rows with the time of change where a column differs."""
    o = old.select("uid", *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"_old_{c}").eqNullSafe(F.col(c))
    return o.join(new, "uid").select("uid", F.when(differs, now).otherwise(F.col("modified_dt")).alias("modified_dt"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str], overwrite: bool) -> DataFrame:
    """Keys of the incoming rows and their outcome: inserted, updated or skipped."""
    e = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in compared], F.col("is_deleted").alias("_gone"), F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(c))
    outcome = F.when(F.col("_there").isNull(), "inserted").when(F.lit(not overwrite) | (same & ~F.col("_gone")), "skipped").otherwise("updated")
    return incoming.join(e, keys, "left").select(*keys, outcome.alias("outcome"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose keys don't exist, the first of each key in the given order."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)
