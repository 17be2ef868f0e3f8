"""Schemas of the entity model and its enumerations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = """uid BIGINT, euid STRING, euid_prefix STRING, euid_seq BIGINT, name STRING, tenant_id STRING, domain_code STRING,
issuer_app_code STRING, polymorphic_discriminator STRING, category STRING, type STRING, subtype STRING, version STRING,
json_addl STRING, bstatus STRING, is_singleton BOOLEAN, is_deleted BOOLEAN, created_dt TIMESTAMP_NTZ, modified_dt TIMESTAMP_NTZ"""
SCHEMAS = {
    "template": f"{CORE}, instance_prefix STRING, instance_polymorphic_identity STRING, validator_ref STRING, json_addl_schema STRING",
    "instance": f"{CORE}, template_uid BIGINT, machine_uuid STRING",
    "lineage": f"{CORE}, parent_instance_uid BIGINT, child_instance_uid BIGINT, parent_type STRING, child_type STRING, relationship_type STRING",
    "audit_log": """uid BIGINT, tenant_id STRING, domain_code STRING, issuer_app_code STRING, rel_table_name STRING, column_name STRING,
rel_table_uid_fk BIGINT, rel_table_euid_fk STRING, old_value STRING, new_value STRING, changed_by STRING, changed_at TIMESTAMP_NTZ,
operation_type STRING, json_addl STRING, is_deleted BOOLEAN""",
    "outbox_event": """id BIGINT, message_uid BIGINT, tenant_id STRING, domain_code STRING, issuer_app_code STRING, destination STRING,
dedupe_key STRING, status STRING, attempt_count INT, next_attempt_at TIMESTAMP_NTZ, last_error STRING, created_dt TIMESTAMP_NTZ,
claim_token STRING, claimed_dt TIMESTAMP_NTZ, lease_expires_dt TIMESTAMP_NTZ, last_attempt_dt TIMESTAMP_NTZ,
receipt_machine_uuid STRING, receipt_status STRING, receipt_received_dt TIMESTAMP_NTZ, receipt_processed_dt TIMESTAMP_NTZ,
dead_letter_dt TIMESTAMP_NTZ, rejected_dt TIMESTAMP_NTZ""",
    "inbox_message": """uid BIGINT, message_machine_uuid STRING, receipt_machine_uuid STRING, domain_code STRING, issuer_app_code STRING,
status STRING, received_dt TIMESTAMP_NTZ, processed_dt TIMESTAMP_NTZ, payload STRING, error_code STRING, error_message STRING""",
    "metrics": "ts_utc STRING, duration_ms DOUBLE, ok STRING, op STRING, table_hint STRING, path STRING, method STRING, username STRING, rowcount STRING, error_type STRING",
}

# The states of the model's state machines.
OUTBOX_STATUSES = ("pending", "delivering", "received", "processed", "failed", "dead_letter", "rejected", "canceled")
CLAIMABLE = ("pending", "failed", "delivering")
INBOX_STATUSES = ("received", "processing", "processed", "failed", "rejected")
AUDIT_OPERATIONS = ("INSERT", "UPDATE", "DELETE")
DEFAULT_VALIDATOR = "UNIVERSAL_PASS@1"


@dataclass(frozen=True)
class Scope:
    """Whose rows a query may see; every part that is None doesn't restrict."""

    domain: str | None = None
    issuer: str | None = None

    def condition(self) -> Column:
        wanted = [(c, v) for c, v in (("domain_code", self.domain), ("issuer_app_code", self.issuer)) if v is not None]
        return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted], F.lit(True))

    def of(self, frame: DataFrame) -> DataFrame:
        return frame.where(self.condition())


def live(frame: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return frame.where(~F.col("is_deleted"))


def of_kind(frame: DataFrame, discriminator: str) -> DataFrame:
    """The rows of one virtual subclass."""
    return frame.where(F.col("polymorphic_discriminator") == discriminator)


def visible_to(frame: DataFrame, domain: str, issuer: str, tenant: str | None) -> DataFrame:
    """Row visibility: own domain and issuer, and rows without tenant or of the own one."""
    return Scope(domain, issuer).of(frame).where(F.col("tenant_id").isNull() | (F.col("tenant_id") == F.lit(tenant)))
