"""Entity operators: golden values, hand-made graphs, state machines, files and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import identity, scalars
from tessera.model import Scope
from tessera.operators import actions, audit, contracts, graph, objects, outbox, search, stats, templates
from tessera.plans import entity
from tessera.sources import files
from tessera.streaming import delivery


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# Identifiers and scalars


def test_identifier_vectors(spark):
    assert value(spark, identity.build(F.lit("z"), F.lit(" agx "), F.lit(42))) == "Z-AGX-1AD"
    for text, good in (("Z-AGX-1Q", True), ("z-agx-1q", False), ("AGX-1Q", False), ("Z:AGX-1Q", False), ("Z-AGX-1R", False), ("", False), (None, False)):
        assert value(spark, identity.is_valid(F.lit(text).cast("string"))) is good
    assert value(spark, identity.is_valid(F.lit("Z-AGX-1Q"), ["Z"])) and not value(spark, identity.is_valid(F.lit("Z-AGX-1Q"), ["T"]))
    parsed = value(spark, identity.parse(F.lit("Z-AGX-1AD")))
    assert tuple(parsed) == ("Z", "AGX", 42, "D")
    assert value(spark, identity.decode32(F.lit("1L"))) is None
    with pytest.raises(Exception, match="positive"):
        value(spark, identity.encode32(F.lit(0)))


def test_identifiers_have_the_check_of_their_payload(spark):
    """The check from the number equals the one over the letters, for bodies of every length."""
    numbers = sorted({n for k in range(1, 64) for n in (2**k - 1, 2**k, 2**k + 12345, 3 * 2**k // 5 + 1) if 0 < n < 2**63})
    rows = spark.createDataFrame([(d, p, n) for n in numbers for d, p in (("Z", "AGX"), ("t", " RGN "), ("AB", "Q"))], "d string, p string, n long")
    plain = identity.check_character(F.concat(F.upper("d"), F.upper(F.trim("p")), identity.encode32(F.col("n"))))
    made = rows.select(identity.build(F.col("d"), F.col("p"), F.col("n")).alias("euid"), plain.alias("check"))
    assert made.count() == 3 * len(numbers) and made.where("right(euid, 1) <> check or check is null or euid is null").count() == 0
    assert made.where(~identity.is_valid(F.col("euid"))).count() == 0
    assert value(spark, identity.build(F.lit("Z"), F.lit("AGX"), F.lit(None).cast("long"))) is None


def test_tokens(spark):
    assert [value(spark, identity.normal_token(F.lit(t))) for t in ("z", "tapd", "a1", "agx", "")] == ["Z", "TAPD", "A1", "AGX", None]
    for bad in ("IL", "A-1", "ABCDE", "AIO"):
        with pytest.raises(Exception, match="token"):
            value(spark, identity.normal_token(F.lit(bad)))
    assert value(spark, identity.is_owner(F.lit("my-repo.x"))) and not value(spark, identity.is_owner(F.lit("My")))


def test_scalar_vectors(spark):
    assert [value(spark, scalars.retry_delay(F.lit(n))) for n in (-5, 0, 1, 2, 31, 999)] == [1, 1, 2, 4, 1800, 1800]
    day = lambda t: value(spark, scalars.two_weeks_from(F.lit(t).cast("timestamp_ntz")))
    assert day("2026-01-05 12:00:00") == datetime.date(2025, 12, 29) and day("2026-01-12 12:00:00") == datetime.date(2026, 1, 12)
    assert value(spark, scalars.statement_kind(F.lit("UPDATE foo x"))) == "UPDATE" and value(spark, scalars.statement_kind(F.lit("VACUUM"))) == "OTHER"
    assert json.loads(value(spark, scalars.json_merged(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')))) == {"a": "1", "b": "3"}
    assert json.loads(value(spark, scalars.json_merged(F.lit('{"a":1.5,"b":[true,null],"c":{"d":1}}'), F.lit('{"c":null}')))) == {"a": 1.5, "b": [True, None], "c": None}
    assert json.loads(value(spark, scalars.json_with(F.lit('{"a":{"b":1}}'), "a.c", F.lit(None).cast("string")))) == {"a": {"b": 1, "c": None}}
    assert json.loads(value(spark, scalars.json_with(F.lit('{"a":5}'), "a.c", F.lit(1)))) == {"a": 5}
    assert value(spark, scalars.lenient_bool(F.lit(" Yes "), False)) and not value(spark, scalars.lenient_bool(F.lit("off"), True)) and value(spark, scalars.lenient_bool(F.lit("?"), True))
    assert value(spark, scalars.discriminator_of(F.lit(" "), F.lit("tube_template"))) == "tube_instance"
    assert value(spark, scalars.child_name(F.lit("{parent_name}_well_{index}"), parent_name=F.lit("P"), index=F.lit(3))) == "P_well_3"
    assert value(spark, scalars.is_template_code(F.lit("/a/b/c/1/"))) and not value(spark, scalars.is_template_code(F.lit("a/*/c/1")))
    assert value(spark, scalars.display_zone(F.lit("gmt"), ["Europe/Rome"])) == "UTC"


# Graphs

EDGES = [(1, 2, "r", False), (1, 3, "r", False), (2, 4, "r", False), (3, 4, "r", False), (4, 5, "r", False), (5, 1, "r", False), (6, 6, "r", False), (1, 2, "s", False), (2, 7, "r", True), (4, 8, "r", False), (8, 9, "r", False)]


@pytest.fixture(scope="module")
def tables(spark):
    """A diamond 1-2-3-4, a cycle over 5, a self-loop 6, parallel edges, a deleted edge to 7, a deleted node 8."""
    nodes = spark.createDataFrame([(i, f"E{i}", f"n{i}", "t", i == 8) for i in range(1, 11)], "uid long, euid string, name string, type string, is_deleted boolean")
    lineage = spark.createDataFrame([(n, *e) for n, e in enumerate(EDGES)], "uid long, parent_instance_uid long, child_instance_uid long, relationship_type string, is_deleted boolean")
    return nodes, lineage


def pairs(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_walk_counts_paths_without_cycles(tables):
    assert pairs(graph.walk(*tables, 1, 4), "uid", "depth") == [(1, 0), (2, 1), (2, 1), (3, 1), (4, 2), (4, 2), (4, 2), (5, 3), (5, 3), (5, 3)]
    assert pairs(graph.walk(*tables, 6, 3), "uid", "depth") == [(6, 0)] and graph.walk(*tables, 99, 3).count() == 0


def test_descendants_follow_deleted_edges_up_to_the_cap(tables):
    assert pairs(graph.descendants(*tables, 2, 2), "uid", "depth") == [(2, 0), (4, 1), (5, 2), (7, 1)]
    assert pairs(graph.descendants(*tables, 8, 3), "uid") == [(8,), (9,)]


def test_neighbourhood_has_least_distances(tables):
    assert pairs(graph.neighbourhood(*tables, 1, 2), "uid", "depth") == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 1)]
    assert graph.neighbourhood(*tables, 8, 2).count() == 0
    edges = graph.incident_edges(graph.neighbourhood(*tables, 1, 1), tables[1])
    assert pairs(edges, "uid") == [(0,), (1,), (5,), (7,)]


def test_payload_edges_may_lead_outside(tables):
    nodes = graph.payload_nodes(*tables, 4, 1)
    assert pairs(nodes, "uid", "depth") == [(2, 1), (3, 1), (4, 0), (5, 1), (8, 1)]
    assert pairs(graph.payload_edges(nodes, tables[1], 1), "source", "target") == [(4, 2), (4, 3), (5, 4), (8, 4)]


def test_waves_degrees_and_endpoints(tables):
    nodes, lineage = tables
    live = graph.live_edges(lineage)
    assert pairs(graph.waves(live, 1, 5), "uid", "depth") == [(2, 1), (3, 1), (4, 2), (5, 3), (8, 3), (9, 4)]
    assert pairs(graph.waves(live, 4, 1, down=False), "uid", "depth") == [(2, 1), (3, 1)]
    assert dict(pairs(graph.degrees(nodes, live), "uid", "degree"))[10] == 0
    assert graph.missing_targets(nodes.select("euid").limit(10), nodes).first()["euid"] == "E8"
    assert pairs(graph.orphan_edges(lineage, nodes), "uid", "side") == [(9, "child"), (10, "parent")]
    assert pairs(graph.merge_new(nodes.select("uid", "name"), nodes.select("uid", "name"), "uid"), "uid")[-1] == (10,)


def test_synthetic_edges_have_no_loops(tables):
    made = graph.synthetic_edges(tables[0], 90)
    assert made.distinct().count() == 90 and made.where("parent = child").count() == 0
    with pytest.raises(ValueError, match="edges"):
        graph.synthetic_edges(tables[0], 91)


# Audit, search, templates


def test_strict_trail_joins_the_named_table_only(spark):
    shown = "uid long, name string, polymorphic_discriminator string, category string, type string, subtype string, bstatus string"
    one = lambda n: spark.createDataFrame([(1, n, "d", "c", "t", "s", "b")], shown)
    log = spark.createDataFrame([(10, "instance", 1, "E1", "me", "UPDATE", datetime.datetime(2024, 1, 1))], "uid long, rel_table_name string, rel_table_uid_fk long, rel_table_euid_fk string, changed_by string, operation_type string, changed_at timestamp_ntz")
    names = [audit.trail(log, one("template"), one("instance"), one("edge"), compat).first()["name"] for compat in (False, True)]
    assert names == ["instance", "template"] and audit.effective_user("x", "me", False) == "me"


def test_changes_are_null_safe(spark):
    schema = "uid long, a string, b int, modified_dt timestamp_ntz, is_deleted boolean"
    old = spark.createDataFrame([(1, "x", None, None, False), (2, None, 1, None, False)], schema)
    new = spark.createDataFrame([(1, "x", 3, None, False), (2, None, 1, None, False), (3, "n", 1, None, False)], schema)
    assert pairs(audit.update_rows(old, new, ["a", "b"]), "uid", "column_name", "new_value") == [(1, "b", "3")]
    assert pairs(audit.insert_rows(old, new), "uid") == [(3,)]
    after, rows = audit.soft_delete(old, old.select("uid").where("uid = 2"))
    assert pairs(after, "uid", "is_deleted") == [(1, False), (2, True)] and json.loads(rows.first()["old_value"])["uid"] == 2
    assert rows.count() == 1 and audit.touched(old, new, ["a", "b"], F.lit("2024-01-01").cast("timestamp_ntz")).where("modified_dt is not null").count() == 1


def test_search_needs_criteria_and_codes(spark):
    with pytest.raises(ValueError, match="criteria"):
        search.members(spark.range(1), {})
    with pytest.raises(ValueError, match="segments"):
        search.template_by_code(spark.range(1), "a/b", "Z")


def test_template_issues_and_layouts(spark):
    rows = [("s", "n", "d", "c", "t", "u", "1", "AGX"), ("s", "n", "d", "c", "t", "u", "1", "AIO"), ("s", "", "d", "c", "t", "u", "2", "AGX")]
    packs = spark.createDataFrame(rows, "source string, name string, polymorphic_discriminator string, category string, type string, subtype string, version string, instance_prefix string")
    assert pairs(templates.issues(packs), "message") == [("duplicate template key",), ("instance_prefix is not a token",), ("name is required",)]
    layouts = spark.createDataFrame([("plate", "well", 96, "{parent_name}_well_{index}", "contains")], "code string, child_code string, count int, name_pattern string, relationship_type string")
    parents = spark.createDataFrame([("p", "plate", "P", None)], "id string, code string, name string, tenant_id string")
    nodes, edges = templates.expand_layouts(parents, layouts)
    assert nodes.count() == 96 == edges.count() and nodes.where("name = 'P_well_96'").count() == 1
    bad = spark.createDataFrame([("x", 0, "r"), ("y", 1, " ")], "code string, count int, relationship_type string")
    assert templates.layout_problems(bad).count() == 2


def test_contract_guard_and_assessment(spark):
    edges = spark.createDataFrame([("CONTAINS", None), ("contains", None), ("CONTAINS", "{}")], "relationship_type string, metadata string")
    good, refused = contracts.creation_guard(edges, spark.createDataFrame([("CONTAINS",)], "edge_type string"))
    assert (good.count(), refused.count()) == (2, 1)
    assert tuple(value(spark, contracts.assessment(F.lit(" "))))[1] == "valid_current" and tuple(value(spark, contracts.assessment(F.lit("X@1"))))[1] == "not_evaluated_current"


# Delivery


def test_inbox_transition_table(spark):
    step = lambda a, b: value(spark, outbox.inbox_transition(F.lit(a), F.lit(b)))
    assert step("received", "processing") == "processing" and step("received", "processed") == "processed"
    assert step("processed", "processing") == "processed" and step("failed", "processed") == "failed" and step("processed", "rejected") == "rejected"


def test_dispatch_settles_a_stream(spark, tmp_path):
    schema = "id long, domain_code string, issuer_app_code string, destination string, dedupe_key string, status string, attempt_count int, next_attempt_at timestamp_ntz, last_error string, created_dt timestamp_ntz, last_attempt_dt timestamp_ntz"
    past = datetime.datetime(2024, 1, 1)
    rows = [(i, "Z", "x", "d", f"k{i % 5}", "pending", 9 if i == 3 else 0, past, None, past, None) for i in range(1, 7)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    now = lambda: F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")

    def send(event):
        if event["id"] in (2, 3):
            raise RuntimeError("down")
        return ("rejected", "no") if event["id"] == 4 else ("processed", "")

    stream = delivery.deduplicated_intake(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = delivery.dispatch(stream, send, str(tmp_path / "state"), str(tmp_path / "attempts"), now)
    run.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    settled = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "state/settled")).collect()}
    assert {i: r["status"] for i, r in settled.items()} == {1: "processed", 2: "failed", 3: "dead_letter", 4: "rejected", 5: "processed"}
    assert settled[2]["next_attempt_at"] == datetime.datetime(2024, 6, 1, 0, 0, 2) and settled[2]["last_error"] == "down"
    assert spark.read.parquet(str(tmp_path / "attempts")).count() == 5


def test_dispatch_keeps_what_waits(spark, tmp_path):
    schema = "id long, domain_code string, issuer_app_code string, destination string, dedupe_key string, status string, attempt_count int, next_attempt_at timestamp_ntz, last_error string, created_dt timestamp_ntz, last_attempt_dt timestamp_ntz"
    start = datetime.datetime(2024, 6, 1)
    minutes = lambda n: start + datetime.timedelta(minutes=n)
    event = lambda i, due, status="pending": (i, "Z", "x", "d", f"k{i}", status, 0, due, None, start, None)
    clock = [0]
    now = lambda: F.lit(str(minutes(clock[0]))).cast("timestamp_ntz")
    tries = tmp_path / "tries"
    tries.mkdir()

    def send(e):
        if e["id"] == 3:  # down twice, then up
            n = len(list(tries.iterdir()))
            (tries / str(n)).touch()
            if n < 2:
                raise RuntimeError("down")
        return "processed", ""

    def turn(at, rows):
        clock[0] = at
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = delivery.dispatch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), send, str(tmp_path / "state"), str(tmp_path / "attempts"), now)
        run.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    # due; due later; fails twice; in delivery with a lease to run; decided already
    turn(0, [event(1, minutes(-1)), event(2, minutes(30)), event(3, minutes(-1)), event(4, minutes(20), "delivering"), event(5, minutes(-1), "canceled")])
    turn(10, [event(9, minutes(-1)), event(2, minutes(-1))])  # the second 2 is a repeat of an event that waits
    turn(40, [event(10, minutes(100))])
    settled = sorted((r["batch"], r["id"], r["status"], r["attempt_count"]) for r in spark.read.parquet(str(tmp_path / "state/settled")).collect())
    assert settled == [(0, 1, "processed", 1), (0, 3, "failed", 1), (0, 5, "canceled", 0), (1, 3, "failed", 2), (1, 9, "processed", 1), (2, 2, "processed", 1), (2, 3, "processed", 3), (2, 4, "processed", 1)]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "state/waiting/batch=2")).collect()] == [10]
    assert spark.read.parquet(str(tmp_path / "attempts")).count() == 7


def test_given_identifiers_and_reserved_prefixes(spark):
    none = spark.createDataFrame([("AGX", 5)], "prefix string, next_seq long")
    rows = [("Z", "AGX", 1, None), ("Z", "AGX", 2, None), ("Z", "CGX", 3, None)]
    got = identity.assign(spark.createDataFrame(rows, "domain_code string, euid_prefix string, k int, euid string"), none, ["k"])
    numbers = {r["k"]: r["euid_seq"] for r in got.collect()}
    assert numbers == {1: 5, 2: 6, 3: 1}
    valid = got.where("k = 2").first()["euid"]
    again = identity.assign(spark.createDataFrame([("Z", "AGX", 1, valid), ("Z", "AGX", 2, None)], "domain_code string, euid_prefix string, k int, euid string"), none, ["k"])
    assert {r["k"]: (r["euid"] == valid, r["euid_seq"]) for r in again.collect()} == {1: (True, 6), 2: (False, 7)}
    for row in (("Z", "GX", 1, None), ("Z", "TGX", 1, None), ("Z", "CGX", 1, valid), ("Z", "AGX", 1, valid[:-1] + ("0" if valid[-1] != "0" else "1"))):
        with pytest.raises(Exception, match="reserved|not an identifier"):
            identity.assign(spark.createDataFrame([row], "domain_code string, euid_prefix string, k int, euid string"), none, ["k"]).collect()


def test_objects(spark):
    t = spark.createDataFrame([(1, "E1", "c", "t", "s", "1", False, None, "generic_template", False, None)], "uid long, euid string, category string, type string, subtype string, version string, is_singleton boolean, instance_polymorphic_identity string, polymorphic_discriminator string, is_deleted boolean, json_addl string")
    wanted = spark.createDataFrame([(1, "c/t/s/1", "n", None, None)], "key long, code string, name string, properties string, tenant_id string")
    made = objects.instances(wanted, t).first()
    assert json.loads(made["json_addl"]) == {"properties": {}, "action_groups": {}, "audit_log": []} and (made["bstatus"], made["polymorphic_discriminator"]) == ("created", "generic_instance")
    with pytest.raises(Exception, match="Template not found"):
        objects.instances(wanted.withColumn("code", F.lit("x/y/z/1")), t).collect()
    with pytest.raises(ValueError, match="depth"):
        objects.graph_meta(t, "lab", 11)
    state = spark.createDataFrame([("E1", "template", "a"), ("E2", "instance", "b")], "euid string, record_type string, bstatus string")
    edits = objects.edited(state, spark.createDataFrame([("E1", "x"), ("E2", " y "), ("E3", "z"), ("E2", None)], "euid string, value string"), "bstatus")
    assert pairs(objects.with_edits(state, edits, "bstatus"), "euid", "bstatus") == [("E1", "a"), ("E2", "y")]
    plain = spark.createDataFrame([(1, "a")], "uid long, name string")
    after, rows = objects.recorded("outbox_event", plain, plain.where("false"), ["name"], F.current_timestamp())
    assert after.count() == 0 and rows.count() == 0


def test_actions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "uid long, name string")

    @actions.action("shout")
    def shout(row):
        return row["name"].upper()

    got = {r["uid"]: r["status"] for r in actions.execute(rows, "shout").collect()}
    assert got == {1: "success", 2: "error"} and actions.execute(rows, "nothing").first()["status"] == "error"


# Files


def test_files(spark, tmp_path):
    packs = tmp_path / "packs"
    for name, text in {"a.json": {"templates": [{"name": "n", "category": "c", "expected_inputs": ["x/y/z/1"]}, {"name": "m"}, 7]}, "_skip.json": {"templates": [{"name": "no"}]}, "list.json": [1], "none.json": {"templates": 5}}.items():
        packs.mkdir(exist_ok=True)
        (packs / name).write_text(json.dumps(text))
    (packs / "broken.json").write_text("{")
    assert pairs(files.template_packs(spark, str(packs)), "name") == [("m",), ("n",)]
    assert [r["refs"] for r in files.template_packs(spark, str(packs)).orderBy("name").collect()] == [[], ["x/y/z/1"]]
    assert sorted(r["message"] for r in files.unreadable_packs(spark, str(packs)).collect()) == ["Config root must be an object", "Invalid JSON", "templates must be a list"]
    (tmp_path / "reg.json").write_text(json.dumps({"ownership": {"Z": {"AGX": "lab"}}, "domains": {"Z": "main"}}))
    assert pairs(files.prefix_registry(spark, str(tmp_path / "reg.json")), "domain", "prefix", "owner") == [("Z", "AGX", "lab")]
    assert pairs(files.domain_registry(spark, str(tmp_path / "reg.json")), "domain") == [("Z",)]
    (tmp_path / "m.tsv").write_text("ts_utc\tduration_ms\tok\top\ttable_hint\tpath\tmethod\tusername\trowcount\terror_type\n2024-01-01T00:00:00Z\t1.0\t1\tSELECT\tt\t/p\tGET\tu\t1\t\nshort\n2024-01-02T00:00:00Z\t9.5\t0\tSELECT\tt\t/p\tGET\tu\t1\tE\n")
    rows = files.read_latencies(spark, str(tmp_path / "m.tsv"))
    assert pairs(rows, "duration_ms", "ok") == [(1.0, True), (9.5, False)] and files.read_latencies(spark, str(tmp_path / "m.tsv"), 1).first()["duration_ms"] == 9.5
    files.write_latencies(rows.withColumn("ok", F.col("ok").cast("int").cast("string")), str(tmp_path / "out"))
    assert any(p.name.startswith("period=") for p in (tmp_path / "out").iterdir())
    (tmp_path / "s.sql").write_text('-- CREATE TABLE no\nCREATE TABLE IF NOT EXISTS "a.b" (x int);\ncreate unique index i on a(x);')
    assert pairs(files.schema_objects(spark, str(tmp_path / "s.sql")), "object_class", "name") == [("index", "i"), ("table", "a.b")]
    files.dump(str(tmp_path / "dump"), t=rows)
    assert files.restore(spark, str(tmp_path / "dump"), "t")["t"].count() == 2


# Queries against DuckDB


@pytest.mark.parametrize("name", ["walk_depth_counts", "graph_neighbourhood", "instance_stats", "audit_trail_strict", "latest_revisions", "search_all", "outbox_settled", "edge_contract_status", "euid_assign", "metrics_two_week"])
def test_queries_equal_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.sql(entity.ORACLES[name])
    got = entity.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(found.columns)
    columns = sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows), key=repr)
    assert plain(got.collect()) == plain([dict(zip(found.columns, r, strict=True)) for r in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert stats.outbox_summary(spark.createDataFrame([("pending", "Z")], "status string, domain_code string"), Scope("T")).first()["pending"] == 0
