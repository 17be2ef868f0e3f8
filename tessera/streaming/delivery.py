"""Delivery as Structured Streaming: deduplicated intake, and a dispatch loop over micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.shipping import ship
from ..model import CLAIMABLE
from ..operators import outbox

OUTCOMES = ("processed", "received", "rejected", "failed")
RESULT = "id long, outcome string, error string"


def deduplicated_intake(events: DataFrame, keys: list[str] | None = None, time: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream of events without repeats on scope, destination and dedupe key.

    With an event time the state holds as long as events may be late, else for ever.
    """
    keys = keys or outbox.KEYS
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else events.dropDuplicates(keys)


def deliver(claimed: DataFrame, send: Callable[[dict], tuple[str, str]]) -> DataFrame:
    """id, outcome, error of sending each event; an exception is a failure, another result an error."""
    columns = claimed.columns

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for event in batch.to_dict("records"):
                try:
                    result = send(event)
                except Exception as x:  # a failed delivery is a result
                    rows.append((event["id"], "failed", str(x)[: outbox.MAX_TEXT]))
                    continue
                if not (isinstance(result, tuple) and len(result) == 2 and result[0] in OUTCOMES):
                    raise TypeError(f"a delivery must return an outcome and an error text, not {result!r}")
                rows.append((event["id"], *result))
            yield pd.DataFrame(rows, columns=["id", "outcome", "error"])

    ship(claimed.sparkSession)
    return claimed.select(*columns).mapInPandas(sent, RESULT)


def polled(events: DataFrame, rows_per_second: int = 1) -> DataFrame:
    """The stream with a clock beside it, so that a trigger has a batch even if no event has come."""
    ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().where("value < 0")
    return events.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]))


def pooled(waiting: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Events that wait, and incoming ones; of an id that waits already the waiting row stays.

    Claims add columns; rows that were never claimed have nulls there.
    """
    if waiting is None:
        return incoming
    fresh = incoming.join(waiting.select("id"), "id", "left_anti")
    return waiting.unionByName(fresh, allowMissingColumns=True)


def still_waiting(pool: DataFrame, settled: DataFrame) -> DataFrame:
    """What waits after a turn: events of the pool that weren't claimed, and failed ones, due again later."""
    left = pool.where(F.col("status").isin(*CLAIMABLE)).join(settled.select("id"), "id", "left_anti")
    return left.unionByName(settled.where(F.col("status").isin(*CLAIMABLE)), allowMissingColumns=True)


def dispatch(events: DataFrame, send: Callable[[dict], tuple[str, str]], state: str, attempts: str, now: Callable[[], Column], max_attempts: int = 10, lease_seconds: int = 300) -> DataStreamWriter:
    """A query that keeps the events that wait, and at each trigger delivers those that are due.

    A trigger reads what waits (``state``/waiting of the trigger before), adds the new events, claims
    what may be claimed - due events, failed ones whose delay is over, and events in delivery whose
    lease has run out - sends them, and writes what waits from there on. Events that can't be claimed
    any more pass through to ``state``/settled, where each delivery's outcome stands as well; attempts
    go to ``attempts``. No event is lost, and nothing is ordered or limited, so a trigger's work is
    spread over all tasks. ``polled`` gives triggers without new events.

    All folders are named by the trigger, so one that runs again after a failure replaces its own
    output: delivery is at least once, its records are written once. A trigger's waiting table is kept
    until the next but one has ended.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, at = rows.sparkSession, now()
        stored = lambda what: f"{state}/{what}/batch={number}"

        def kept(frame: DataFrame, what: str) -> DataFrame:
            frame.write.mode("overwrite").parquet(stored(what))
            return spark.read.schema(frame.schema).parquet(stored(what))

        waiting = spark.read.parquet(f"{state}/waiting/batch={number - 1}") if number else None
        pool = kept(pooled(waiting, rows), "pool")
        claimed = kept(outbox.claimed(outbox.claimable(pool, at), at, f"batch-{number}", lease_seconds), "claimed")  # fixed before anything is sent
        results = kept(deliver(claimed, send), "results")
        settled = outbox.settle(claimed, results, at, max_attempts)
        final = pool.where(~F.col("status").isin(*CLAIMABLE))
        settled = kept(settled.unionByName(final, allowMissingColumns=True), "settled")
        tried = settled.join(claimed.select("id"), "id", "left_semi")
        outbox.attempt_rows(tried, at).write.mode("overwrite").parquet(f"{attempts}/batch={number}")
        kept(still_waiting(pool, settled), "waiting")
        for old in (f"{state}/waiting/batch={number - 2}", stored("pool"), stored("results")):
            remove(spark, old)

    return events.writeStream.foreachBatch(batch)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def latencies_by_period(metrics: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and failures of a stream of latency rows by windows of 14 days (an addition)."""
    windowed = metrics.withWatermark("ts", late).groupBy(F.window("ts", "14 days"))
    return windowed.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures")).select(F.col("window.start").alias("period"), "n", "failures")
