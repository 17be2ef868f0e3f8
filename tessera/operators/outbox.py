"""Delivery state: enqueueing, claiming, transitions, requeueing, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import retry_delay
from ..model import CLAIMABLE, Scope
from .audit import insert_missing

KEYS = ["domain_code", "issuer_app_code", "destination", "dedupe_key"]
MAX_TEXT = 10_000


def after(now: Column, seconds: Column | int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds) if isinstance(seconds, int) else seconds)


def enqueue(outbox: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Incoming events that are new on scope, destination and dedupe key, the first of each."""
    return insert_missing(outbox, incoming, KEYS, order)


def fan_out(messages: DataFrame, destinations: list[str], outbox: DataFrame) -> DataFrame:
    """An event for each message and destination that has none yet; the message's scope is inherited."""
    each = messages.select("message_uid", "domain_code", "issuer_app_code", "dedupe_key", F.explode(F.array(*map(F.lit, destinations))).alias("destination"))
    return insert_missing(outbox, each, KEYS, [F.col("message_uid").asc()])


def claimable(outbox: DataFrame, now: Column, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """Events that may be claimed: waiting, failed, or delivering with a lease that is over."""
    return scope.of(outbox).where(F.col("status").isin(*CLAIMABLE) & (F.col("next_attempt_at") <= now))


def claim(outbox: DataFrame, now: Column, token: str, batch_size: int = 50, lease_seconds: int = 300, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """The oldest claimable events after the claim. One writer claims at a time."""
    return claimed(claimable(outbox, now, scope).orderBy("created_dt", "id").limit(batch_size), now, token, lease_seconds)


def claimed(rows: DataFrame, now: Column, token: str, lease_seconds: int = 300) -> DataFrame:
    """Events as they are once they have been claimed."""
    lease = after(now, lease_seconds)
    return rows.withColumns({
        "status": F.lit("delivering"), "attempt_count": (F.coalesce("attempt_count", F.lit(0)) + 1).cast("int"), "next_attempt_at": lease, "last_error": F.lit(None).cast("string"),
        "claim_token": F.lit(token), "claimed_dt": now, "lease_expires_dt": lease,
    })


def failed(outbox: DataFrame, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    return scope.of(outbox).where(F.col("status").isin("failed", "dead_letter", "rejected")).orderBy(F.col("last_attempt_dt").desc_nulls_last(), "id")


def stale(outbox: DataFrame, now: Column, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """Events in delivery whose lease is over."""
    return scope.of(outbox).where((F.col("status") == "delivering") & (F.col("lease_expires_dt") < now)).orderBy(F.col("claimed_dt").asc_nulls_last(), "id")


def by_destination(outbox: DataFrame, destination: str, limit: int = 100) -> DataFrame:
    return outbox.where(F.col("destination") == destination).orderBy(F.col("created_dt").desc(), "id").limit(limit)


def by_receipt(outbox: DataFrame, receipt: str) -> DataFrame:
    return outbox.where(F.col("receipt_machine_uuid") == receipt)


def with_message(outbox: DataFrame, instance: DataFrame) -> DataFrame:
    """Events with their message; a message that was fanned out gives a row per event."""
    return outbox.join(instance.select(F.col("uid").alias("message_uid"), F.col("euid").alias("message_euid"), F.col("name").alias("message_name")), "message_uid")


def attempts(lines: DataFrame, event: Column, order: list[Column]) -> DataFrame:
    """outbox_event_id, attempt_no: attempts numbered within their event."""
    return lines.select("*", event.alias("outbox_event_id")).withColumn("attempt_no", F.row_number().over(Window.partitionBy("outbox_event_id").orderBy(*order)))


def visible_attempts(attempt: DataFrame, outbox: DataFrame, scope: Scope) -> DataFrame:
    """Attempts of events in scope."""
    return attempt.join(scope.of(outbox).select(F.col("id").alias("outbox_event_id")), "outbox_event_id", "left_semi")


def settle(claimed: DataFrame, results: DataFrame, now: Column, max_attempts: int = 10) -> DataFrame:
    """Claimed events after delivery. results: id, outcome (processed, received, rejected, failed), error.

    A success is processed or received, a rejection is final, and a failure waits for its delay or
    becomes a dead letter once the attempts are used up.
    """
    r = results.select("id", F.col("outcome").alias("_outcome"), F.left(F.nullif("error", F.lit("")), F.lit(MAX_TEXT)).alias("_error"))
    over = F.col("attempt_count") >= max_attempts
    failing = F.col("_outcome") == "failed"
    status = F.when(failing & over, "dead_letter").when(failing, "failed").otherwise(F.col("_outcome"))
    joined = claimed.join(r, "id").withColumn("status", status)
    when = lambda s, c: F.when(F.col("status") == s, now).otherwise(F.col(c)) if c in claimed.columns else F.when(F.col("status") == s, now)
    return joined.withColumns({
        "last_error": F.when(F.col("status").isin("failed", "dead_letter", "rejected"), F.col("_error")),
        "next_attempt_at": F.when(F.col("status") == "failed", after(now, retry_delay(F.col("attempt_count")))).otherwise(F.col("next_attempt_at")),
        "last_attempt_dt": when("failed", "last_attempt_dt"), "dead_letter_dt": when("dead_letter", "dead_letter_dt"), "rejected_dt": when("rejected", "rejected_dt"),
        "receipt_received_dt": when("received", "receipt_received_dt"), "receipt_processed_dt": when("processed", "receipt_processed_dt"),
    }).drop("_outcome", "_error")


def attempt_rows(settled: DataFrame, now: Column) -> DataFrame:
    """The append-only rows of settled deliveries: one per event and attempt."""
    transport = F.when(F.col("status").isin("processed", "received"), "receipt_valid").when(F.col("status") == "rejected", "rejected").otherwise("transport_failed")
    return settled.select(F.col("id").alias("outbox_event_id"), F.col("attempt_count").alias("attempt_no"), "claim_token", F.col("claimed_dt").alias("attempt_started_dt"), now.alias("attempt_finished_dt"), transport.alias("transport_status"), F.col("last_error").alias("transport_error"))


def requeue(outbox: DataFrame, ids: list[int], now: Column, reset_attempts: bool = False) -> DataFrame:
    """All events; dead letters with the ids are pending again, without traces of their claim."""
    hit = F.col("id").isin(*ids) & (F.col("status") == "dead_letter")
    out = outbox.withColumn("_hit", hit)
    cleared = {c: F.when(F.col("_hit"), F.lit(None).cast(outbox.schema[c].dataType)).otherwise(F.col(c)) for c in ("last_error", "claim_token", "claimed_dt", "lease_expires_dt", "dead_letter_dt") if c in outbox.columns}
    if reset_attempts:
        cleared["attempt_count"] = F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("attempt_count"))
    return out.withColumns(cleared | {"status": F.when(F.col("_hit"), "pending").otherwise(F.col("status")), "next_attempt_at": F.when(F.col("_hit"), now).otherwise(F.col("next_attempt_at"))}).drop("_hit")


def receive(inbox: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Incoming messages that are new; the first of each machine uuid keeps its receipt."""
    return insert_missing(inbox, incoming, ["message_machine_uuid"], order)


def inbox_transition(status: Column, wanted: Column) -> Column:
    """The state after a guarded transition: to processing from received, to processed or failed from
    either, to rejected from any; a forbidden one changes nothing."""
    allowed = ((wanted == "processing") & (status == "received")) | (wanted.isin("processed", "failed") & status.isin("received", "processing")) | (wanted == "rejected")
    return F.when(allowed, wanted).otherwise(status)


def inbox_states(events: DataFrame, message: str, order: str, wanted: str) -> DataFrame:
    """Final state of each message: its wanted transitions folded in order, from received on.

    The fold in closed form, so that Spark aggregates before the shuffle: a rejection anywhere is final,
    else the first of processed and failed holds, else processing if it was wanted. A null order comes
    first, at equal orders failed comes before processed, and null or unknown wishes change nothing.
    """
    w = F.col(wanted)
    first = F.min(F.when(w.isin("processed", "failed"), F.struct(F.col(order).alias("at"), w.alias("to"))))["to"]
    status = F.when(F.coalesce(F.bool_or(w == "rejected"), F.lit(False)), "rejected").otherwise(F.coalesce(first, F.when(F.bool_or(w == "processing"), "processing"), F.lit("received")))
    return events.groupBy(message).agg(status.alias("status"))
