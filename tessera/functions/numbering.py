"""Row numbers without one task that sees all rows, or all rows of a key; rows dealt by their number."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task sorts or holds at once, where rows are dealt by their number.
ROWS_A_TASK = 250_000
#: Identifiers that are sent to the rows, instead of shuffling the rows.
FEW = 500_000


def cut(frame: DataFrame) -> DataFrame:
    """Checkpoints a frame in the folder that the cluster names; only local mode without one gets a folder of its own."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return frame.checkpoint()


def dealt(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt by keys (or evenly) to as many tasks as a number of rows asks for.

    So what a task sorts or holds doesn't grow with the table. Partitions of a shuffle that Spark adds by
    itself are merged again by their compressed size, which for keys is a small part of what they take in memory.
    """
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)


def among(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is one of the ids (uid), a frame that has been cut.

    Up to FEW ids (counted) are sent to the rows, where the choice is made as they are read.
    """
    ids = ids.select(F.col("uid").alias(column))
    return frame.join(F.broadcast(ids) if ids.count() <= FEW else ids, column, "left_semi").select(*frame.columns)


def numbered(frame: DataFrame, name: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """The rows with their number from 1 on in ascending ``order``, within each combination of ``within`` if given.

    Rows are dealt by ranges of (within, order) and sorted there; the count of each range's rows of a
    key gives the offset of the next range. A key with very many rows is spread over ranges.
    """
    keys = within or []
    sort = {f"_k{i}": c for i, c in enumerate([*map(F.col, keys), *order])}
    dealt = frame.withColumns(sort).repartitionByRange(*sort).sortWithinPartitions(*sort).drop(*sort)
    # The upper bits of the id are the range, the lower ones the place in it.
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    runs = dealt.groupBy("_range", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_w{i}"))
    return dealt.join(runs, same).select(*frame.columns, (F.col("_at") + F.col("_shift")).alias(name))
