"""Equi-joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables

#: A key is hot from so many rows, and from one HOT_KEYS-th of all rows: there are at most HOT_KEYS of them.
LEAST_HOT, HOT_KEYS = 1024, 100_000


def hot_keys(rows: DataFrame, key: str, tables: Tables, name: str, counts: str | None = None) -> DataFrame:
    """_hot, _salts: the hot keys of ``rows``, and the tasks to which each is dealt, as a written table.

    ``rows`` is a written table; with ``counts`` it has one row for each key, and that column counts the
    key's rows. Of all rows at most HOT_KEYS keys have more than a HOT_KEYS-th, so the result has a
    proven bound and may be broadcast.
    """
    each = rows.select(key, F.col(counts).alias("_n")) if counts else rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = (rows.agg(F.sum(counts)).first()[0] or 0) if counts else rows.count()
    most = max(LEAST_HOT, total // HOT_KEYS + 1)
    hot = each.where((F.col("_n") > most) & F.col(key).isNotNull())
    return tables.keep(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / most).cast("int").alias("_salts")), name)


def dealt_join(rows: DataFrame, other: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` on ``key``.

    The rows of a hot key are dealt by the hash of ``by`` to as many tasks as they fill; its rows of
    ``other`` are copied to each of these.
    """
    if hot.isEmpty():
        return rows.join(other, key, how)
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0)))
    copied = other.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.drop("_hot", "_salts").join(copied.drop("_hot", "_salts"), [key, "_salt"], how).drop("_salt")
