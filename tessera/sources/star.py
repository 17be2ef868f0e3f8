"""The entity model as a projection of star-schema tables.

Each model table is one SELECT over the star tables, written once for Spark and for DuckDB; where
the dialects differ a small dictionary has both spellings. ``model`` gives the tables as DataFrames,
``prelude`` the same as common table expressions for an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.numbering import dealt

#: The time that queries take for now.
NOW = "2024-06-01 00:00:00"
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
_FIXED = "2024-01-01 00:00:00"

#: Kinds of instances: number, prefix, category, type, table, key, name, subtype, status, created, nation, issuer.
KINDS = [
    (1, "RGN", "geo", "region", "region", "r_regionkey", "r_name", "''", "'active'", None, None, "geo"),
    (2, "NTN", "geo", "nation", "nation", "n_nationkey", "n_name", "''", "'active'", None, "n_nationkey", "geo"),
    (3, "CST", "actor", "customer", "customer", "c_custkey", "c_name", "c_mktsegment", "'active'", None, "c_nationkey", "crm"),
    (4, "SPP", "actor", "supplier", "supplier", "s_suppkey", "s_name", "''", "'active'", None, "s_nationkey", "crm"),
    (5, "PRT", "container", "part", "part", "p_partkey", "p_name", "p_type", "'active'", None, None, "catalog"),
    (6, "RDR", "workflow", "order", "orders", "o_orderkey", "'order ' || CAST(o_orderkey AS {text})", "o_orderpriority", "o_orderstatus", "o_orderdate", None, "sales"),
]
_DELETABLE = (3, 5, 6)

_WORDS = {
    "spark": {"text": "STRING", "ts": "TIMESTAMP_NTZ", "double": "DOUBLE", "minutes": "make_dt_interval(0, 0, CAST({0} AS INT))", "json": "to_json(named_struct({0}))", "nested": "named_struct({0})", "jsonint": "CAST(get_json_object({0}, '$.{1}') AS BIGINT)", "pairs": "pairs"},
    "duckdb": {"text": "VARCHAR", "ts": "TIMESTAMP", "double": "DOUBLE", "minutes": "to_minutes(CAST({0} AS BIGINT))", "json": "CAST(json_object({0}) AS VARCHAR)", "nested": "json_object({0})", "jsonint": "CAST(json_extract_string({0}, '$.{1}') AS BIGINT)", "pairs": "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l"},
}


def euid_sql(domain: str, prefix: str, seq: str) -> str:
    """DuckDB's form of an identifier."""
    body = f"translate(to_base({seq}, 32), '{identity.DIGITS[10:]}', '{identity.ALPHABET[10:]}')"
    return f"({domain} || '-' || {prefix} || '-' || {body} || {check_sql(f'({domain} || {prefix} || {body})')})"


def check_sql(payload: str) -> str:
    """DuckDB's form of the check character."""
    value = f"((strpos('{identity.ALPHABET}', substr({payload}, length({payload}) - i + 1, 1)) - 1) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END)"
    total = f"list_sum(list_transform(range(1, length({payload}) + 1), lambda i: {value} // 32 + {value} % 32))"
    return f"substr('{identity.ALPHABET}', CAST((32 - {total} % 32) % 32 AS INT) + 1, 1)"


def _tables(engine: str) -> dict[str, str]:
    """Model table -> SELECT over the star tables; identifiers are added by the callers."""
    w = _WORDS[engine]
    stamp = f"{w['ts']} '{_FIXED}'"
    now = f"{w['ts']} '{NOW}'"
    minutes = lambda base, n: f"({base} + {w['minutes'].format(n)})"
    templates, instances = [], []
    for k, prefix, category, kind, table, key, name, subtype, status, created, nation, issuer in KINDS:
        templates.append(
            f"SELECT CAST({k} AS BIGINT) AS uid, 'TPX' AS euid_prefix, CAST({k} AS BIGINT) AS euid_seq, '{kind} template' AS name, CAST(NULL AS {w['text']}) AS tenant_id, "
            f"'Z' AS domain_code, '{issuer}' AS issuer_app_code, '{kind}_template' AS polymorphic_discriminator, '{category}' AS category, '{kind}' AS type, 'generic' AS subtype, "
            f"'{'1.10' if k == 6 else '1.9' if k == 5 else '1.0'}' AS version, 'active' AS bstatus, {'true' if k == 1 else 'false'} AS is_singleton, {'true' if k == 2 else 'false'} AS is_deleted, {stamp} AS created_dt, "
            f"'{prefix}' AS instance_prefix, {'NULL' if k % 2 else repr(kind + '_instance')} AS instance_polymorphic_identity, {repr('CUSTOM@1') if k == 6 else repr('UNIVERSAL_PASS@1')} AS validator_ref"
        )
        tenant = f"'00000000-0000-0000-0000-00000000000' || CAST({nation} % 3 AS {w['text']})" if nation else f"CAST(NULL AS {w['text']})"
        json = w["json"].format(f"'kind', '{kind}', 'rank', CAST({key} % 7 AS {w['text']}), 'properties', " + w["nested"].format(f"'owner', 'owner' || CAST({key} % 11 AS {w['text']}), 'shade', CAST({key} % 4 AS {w['text']})"))
        instances.append(
            f"SELECT CAST({k * 100_000_000} + {key} AS BIGINT) AS uid, '{prefix}' AS euid_prefix, CAST({key} AS BIGINT) + 1 AS euid_seq, {name.format(**w)} AS name, {tenant} AS tenant_id, "
            f"'Z' AS domain_code, '{issuer}' AS issuer_app_code, '{kind}_instance' AS polymorphic_discriminator, '{category}' AS category, '{kind}' AS type, {subtype} AS subtype, '1.0' AS version, "
            f"{json} AS json_addl, {status} AS bstatus, {'true' if k == 1 else 'false'} AS is_singleton, {f'{key} % 17 = 0' if k in _DELETABLE else 'false'} AS is_deleted, "
            f"{created or stamp} AS created_dt, CAST({k} AS BIGINT) AS template_uid FROM {table}"
        )
    edge = "SELECT {0} AS parent_instance_uid, {1} AS child_instance_uid, '{2}_instance' AS parent_type, '{3}_instance' AS child_type, '{4}' AS relationship_type FROM {5}"
    uid = lambda k, key: f"CAST({k * 100_000_000} + {key} AS BIGINT)"
    edges = " UNION ALL ".join([
        edge.format(uid(1, "n_regionkey"), uid(2, "n_nationkey"), "region", "nation", "contains", "nation"),
        edge.format(uid(2, "c_nationkey"), uid(3, "c_custkey"), "nation", "customer", "contains", "customer"),
        edge.format(uid(2, "s_nationkey"), uid(4, "s_suppkey"), "nation", "supplier", "contains", "supplier"),
        edge.format(uid(3, "o_custkey"), uid(6, "o_orderkey"), "customer", "order", "placed", "orders"),
        edge.format(uid(6, "l_orderkey"), uid(5, "l_partkey"), "order", "part", "consumes", w["pairs"]),
    ])
    status = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(("pending", "delivering", "received", "processed", "failed", "dead_letter", "rejected", "canceled"))) + " END"
    return {
        "template": " UNION ALL ".join(templates),
        "instance": " UNION ALL ".join(instances),
        "lineage": f"SELECT parent_instance_uid * 1000000000 + child_instance_uid AS uid, 'EDG' AS euid_prefix, parent_instance_uid, child_instance_uid, parent_type, child_type, relationship_type, "
        f"relationship_type || ' edge' AS name, 'Z' AS domain_code, 'lineage' AS category, 'lineage' AS type, 'generic' AS subtype, '1.0' AS version, 'active' AS bstatus, 'generic_instance_lineage' AS polymorphic_discriminator, "
        f"(parent_instance_uid + child_instance_uid) % 23 = 0 AS is_deleted, {stamp} AS created_dt FROM ({edges}) e",
        "audit_log": f"SELECT event_id AS uid, 'Z' AS domain_code, CASE WHEN user_id % 2 = 0 THEN 'crm' ELSE 'sales' END AS issuer_app_code, 'instance' AS rel_table_name, {uid(3, 'user_id')} AS rel_table_uid_fk, user_id + 1 AS rel_seq, "
        f"'User' || CAST(user_id AS {w['text']}) AS changed_by, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation_type, ts AS changed_at, "
        f"{w['jsonint'].format('props', 'k')} AS k, event_id % 29 = 0 AS is_deleted FROM events",
        "outbox_event": f"SELECT o_orderkey AS id, {uid(6, 'o_orderkey')} AS message_uid, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE 'T' END AS domain_code, 'sales' AS issuer_app_code, o_orderpriority AS destination, "
        f"CAST(o_custkey AS {w['text']}) || '|' || CAST(CAST(o_orderdate AS DATE) AS {w['text']}) AS dedupe_key, {status} AS status, CAST(o_orderkey % 12 AS INT) AS attempt_count, "
        f"{minutes(now, '(o_orderkey % 200) - 100')} AS next_attempt_at, o_orderdate AS created_dt, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {minutes(now, '-1 * (o_orderkey % 500)')} END AS claimed_dt, "
        f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {minutes(now, '5 - (o_orderkey % 500)')} END AS lease_expires_dt, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {minutes(now, '-1 * (o_orderkey % 700)')} END AS last_attempt_dt, "
        f"CASE WHEN o_orderkey % 6 = 0 THEN 'receipt-' || CAST(o_orderkey AS {w['text']}) END AS receipt_machine_uuid FROM orders",
        "inbox_message": f"SELECT 'm' || CAST(conv_id AS {w['text']}) AS message_machine_uuid, 'r' || CAST(conv_id AS {w['text']}) || '-' || CAST(turn AS {w['text']}) AS receipt_machine_uuid, turn AS received_seq, "
        f"CASE WHEN conv_id % 2 = 0 THEN 'Z' ELSE 'T' END AS domain_code, 'chat' AS issuer_app_code, CASE role WHEN 'system' THEN 'received' WHEN 'user' THEN 'processing' WHEN 'assistant' THEN 'processed' ELSE 'failed' END AS status, length(text) AS payload_chars FROM conversations",
        "metrics": "SELECT event_id, ts, value AS duration_ms, event_type <> 'error' AS ok, event_type AS path, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'table' || CAST(user_id % 4 AS " + w["text"] + ") END AS table_hint FROM events",
    }


def model(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named model tables over a folder of star tables; unused columns are never computed."""
    star = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR}
    tables, out = _tables("spark"), []
    if "lineage" in names:
        # The distinct pairs of orders and parts, in tasks whose number goes by the rows.
        star["pairs"] = dealt(star["lineitem"].select("l_orderkey", "l_partkey"), star["lineitem"].count(), "l_orderkey", "l_partkey").distinct()
    for name in names:
        if name in star:
            out.append(star[name])
            continue
        text = tables[name].replace("{", "{{").replace("}", "}}")
        for t in (*STAR, "pairs"):
            text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
            text = text[: -len(t)] + f"{{{t}}}" if text.endswith(f"FROM {t}") else text
        frame = spark.sql(text, **{t: f for t, f in star.items() if f"{{{t}}}" in text})
        if name in ("template", "instance"):
            frame = frame.withColumn("euid", identity.build(F.col("domain_code"), F.col("euid_prefix"), F.col("euid_seq")))
        elif name == "lineage":
            frame = frame.withColumn("euid", identity.build(F.col("domain_code"), F.col("euid_prefix"), F.col("uid")))
        elif name == "audit_log":
            frame = frame.withColumn("rel_table_euid_fk", identity.build(F.lit("Z"), F.lit("CST"), F.col("rel_seq")))
        out.append(frame)
    return out


def prelude(*names: str) -> str:
    """WITH RECURSIVE and the named model tables, for DuckDB; the query's own tables may follow."""
    added = {
        "template": euid_sql("domain_code", "euid_prefix", "euid_seq") + " AS euid",
        "instance": euid_sql("domain_code", "euid_prefix", "euid_seq") + " AS euid",
        "lineage": euid_sql("domain_code", "euid_prefix", "uid") + " AS euid",
        "audit_log": euid_sql("'Z'", "'CST'", "rel_seq") + " AS rel_table_euid_fk",
    }
    tables = _tables("duckdb")
    return "WITH RECURSIVE " + ", ".join(f"{n} AS (SELECT *{', ' + added[n] if n in added else ''} FROM ({tables[n]}) base)" for n in names)
