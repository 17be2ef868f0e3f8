"""Latency metrics: global, by group, slowest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import two_weeks_from


def overall(metrics: DataFrame, order: str = "ts") -> DataFrame:
    """One row: count, exact percentiles, maximum and the last row's time; 0 if there are no rows."""
    at = lambda p: F.round(F.coalesce(F.percentile("duration_ms", F.lit(p)), F.lit(0.0)), 6)
    return metrics.agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("max_ms"), F.max(order).alias("last_seen"))


def by_group(metrics: DataFrame, key: Column) -> DataFrame:
    """key, n, p95, max_ms, the slowest groups first; null keys are empty."""
    out = metrics.groupBy(F.coalesce(key, F.lit("")).alias("key")).agg(F.count("*").alias("n"), F.round(F.percentile("duration_ms", F.lit(0.95)), 6).alias("p95"), F.max("duration_ms").alias("max_ms"))
    return out.orderBy(F.desc("p95"), F.desc("n"), "key")


def slowest(metrics: DataFrame, limit: int = 25) -> DataFrame:
    return metrics.orderBy(F.desc("duration_ms"), "event_id").limit(limit)


def by_two_weeks(metrics: DataFrame) -> DataFrame:
    """Counts and failures by the Monday of each pair of weeks."""
    return metrics.groupBy(two_weeks_from(F.col("ts")).alias("period")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"))
