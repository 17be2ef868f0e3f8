"""Queries whose tasks hold no more rows on larger tables, with the same results."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbering, packs
from tessera.operators import audit, contracts, graph, objects
from tessera.plans import entity
from tessera.sources.star import model


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(numbering, "ROWS_A_TASK", 50)


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def written(frame):
    """The most rows of one partition."""
    return max(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


# recorded_changes, changed_table


def test_both_states_meet_once_in_tasks_of_few_rows(spark, small_tasks):
    state = "uid long, name string, bstatus string, is_deleted boolean, modified_dt timestamp_ntz"
    day = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame([(i, "n", None if i == 3 else "a", i == 2, day) for i in range(1, 1001) if i != 7], state)
    new = spark.createDataFrame([(i, "m" if i == 4 else "n", "b" if i in (3, 4) else "a", i == 2, day) for i in range(3, 1001) if i != 5], state)
    after, rows = objects.recorded("instance", old, new, ["name", "bstatus"], F.lit("2024-06-01").cast("timestamp_ntz"))
    assert optimized(rows).count("Join ") == 1 and optimized(after).count("Join ") == 1
    assert after.rdd.getNumPartitions() >= 1000 // 50 and written(after) < 200
    got = sorted((r["uid"], r["operation_type"], r["column_name"] or "", r["new_value"]) for r in rows.drop("old_value").collect())
    assert got == [(1, "DELETE", "", None), (3, "UPDATE", "bstatus", "b"), (4, "UPDATE", "bstatus", "b"), (4, "UPDATE", "name", "m"), (5, "DELETE", "", None), (7, "INSERT", "", None)]
    values = {(r["uid"], r["column_name"]): r["old_value"] for r in rows.collect()}
    assert values[3, "bstatus"] is None and values[4, "name"] == "n" and values[5, None].startswith('{"uid":5,"name":"n"')
    table = {r["uid"]: r for r in after.collect()}
    assert len(table) == after.count() == 1000 and [i for i in table if table[i]["is_deleted"]] and {i for i in table if table[i]["is_deleted"]} == {1, 2, 5}
    assert {i for i in table if table[i]["modified_dt"] != day} == {3, 4} and table[4]["name"] == "m"


# template_references


def test_a_template_s_json_is_parsed_once_in_many_tasks(spark, sf, small_tasks):
    json = '{"expected_inputs": ["a/b/c/1"], "action_imports": {"x": "d/e/f/1", "y": {"actions": {"g/h/i/1": {}}}}, "json_addl": {"expected_outputs": ["j/k/l/1"]}}'
    rows = spark.createDataFrame([(json,), ("{}",), (None,)], "json string").select(packs.extracted_refs(F.col("json")).alias("refs"))
    assert optimized(rows).count("from_json") <= 2
    assert [r["refs"] for r in rows.collect()] == [["d/e/f/1", "g/h/i/1", "a/b/c/1", "j/k/l/1"], [], []]
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert entity.QUERIES["template_references"](spark, sf).rdd.getNumPartitions() >= min(4, parts // 50)


# edge_contract_status


def test_edges_meet_the_vocabulary_where_they_are(spark):
    edges = spark.createDataFrame([(1, "contains", None), (2, None, "{}"), (3, "x", None)], "uid long, relationship_type string, metadata string")
    found = contracts.contract_status(edges, *contracts.vocabulary(spark))
    assert planned(found).count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in planned(found)
    assert {r["uid"]: r["compliance_status"] for r in found.collect()} == {1: "legacy_alias", 2: "invalid", 3: "generic"}


def test_pairs_of_the_lineage_are_told_apart_in_tasks_of_few_rows(spark, sf, small_tasks):
    (lineage,) = model(spark, sf, "lineage")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert lineage.rdd.getNumPartitions() >= lines // 50
    assert lineage.where("relationship_type = 'consumes'").count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()


# outbox_dispatch_turns


def test_a_turn_is_not_computed_again_by_the_next(spark, sf, no_small_tables):
    assert optimized(entity.QUERIES["outbox_dispatch_turns"](spark, sf)).count("Join ") == 0


# graph_payload_nodes, graph_payload_edges, khop, graph_neighbourhood, graph_neighbourhood_edges


def brute(edges, start, depth):
    found, near = {start: 0}, {start}
    for level in range(1, depth + 1):
        near = {b for a, b in edges if a in near} - set(found)
        found |= dict.fromkeys(near, level)
    return found


@pytest.mark.parametrize("few", [0, 500_000])
def test_searches_keep_no_edges(spark, monkeypatch, no_small_tables, few):
    monkeypatch.setattr(numbering, "FEW", few)
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: pytest.fail("edges are kept"))
    pairs = [(i, (i * i + 3) % 40) for i in range(40)] + [(i, i // 3) for i in range(40)]
    lineage = spark.createDataFrame([(n, p, c, "r", n % 9 == 0) for n, (p, c) in enumerate(pairs)], "uid long, parent_instance_uid long, child_instance_uid long, relationship_type string, is_deleted boolean")
    instance = spark.createDataFrame([(i, i % 7 == 0) for i in range(38)], "uid long, is_deleted boolean")
    live = [pair for n, pair in enumerate(pairs) if n % 9]
    both = live + [(c, p) for p, c in live]
    table = lambda frame: {r["uid"]: r["depth"] for r in frame.collect()}
    nodes = graph.payload_nodes(instance, lineage, 5, 3)
    assert table(nodes) == brute(both, 5, 3) and nodes.count() == len(brute(both, 5, 3))
    shown = lambda i: i % 7 and i < 38
    assert table(graph.neighbourhood(instance, lineage, 5, 3)) == brute([(a, b) for a, b in both if shown(a) and shown(b)], 5, 3)
    assert table(graph.neighbourhood(instance, lineage, 7, 3)) == {}
    edges = graph.payload_edges(nodes, lineage, 2)
    inner = {i for i, d in brute(both, 5, 3).items() if d < 2}
    assert sorted(r["uid"] for r in edges.collect()) == [n for n, (p, c) in enumerate(pairs) if n % 9 and (p in inner or c in inner)]
    inside = graph.incident_edges(nodes, lineage)
    assert sorted(r["uid"] for r in inside.collect()) == [n for n, (p, c) in enumerate(pairs) if n % 9 and {p, c} <= set(brute(both, 5, 3))]
    assert ("SortMergeJoin" in planned(inside)) == (few == 0)


# low_degree_nodes


def test_degrees_are_counted_in_tasks_of_few_nodes(spark, small_tasks):
    nodes = spark.range(2000).withColumnRenamed("id", "uid")
    edges = spark.range(1, 2000).select(F.col("id").alias("parent"), F.lit(0).cast("long").alias("child"), F.lit("r").alias("relationship_type"))
    found = graph.degrees(nodes, edges)
    assert found.rdd.getNumPartitions() >= 2000 // 50
    assert {r["uid"]: r["degree"] for r in found.where("uid < 3").collect()} == {0: 1999, 1: 1, 2: 1} and found.count() == 2000


# audit_trail_compat


def test_a_trail_reads_only_rows_it_is_about(spark, sf, no_small_tables):
    t, i, e, a = model(spark, sf, "template", "instance", "lineage", "audit_log")
    for compat in (False, True):
        found = audit.query_trail(a, t, i, e, changed_by="User7", compat=compat)
        assert optimized(found).count("LeftSemi") >= 3 and planned(found).count("LeftSemi, BuildRight") >= 3
