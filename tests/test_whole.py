"""Queries over whole tables, and the operators beneath them against brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered
from tessera.operators import graph, outbox, stats, templates
from tessera.plans import detail, entity
from tessera.sources.star import model

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def equal_duckdb(spark, sf, name):
    """The query's rows, after they have been held against its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in STAR:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.sql((entity.ORACLES | detail.ORACLES)[name])
    got = (entity.QUERIES | detail.QUERIES)[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    return rows


# inbox_transition


def folded(wishes):
    status = "received"
    for _, w in sorted(wishes, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        if w == "rejected" or (w == "processing" and status == "received") or (w in ("processed", "failed") and status in ("received", "processing")):
            status = w
    return status


def test_inbox_states_equal_the_fold(spark):
    wishes = ["processing", "processed", "failed", "rejected", None, "other"]
    cases = [list(zip((2, 1, 3), c, strict=True)) for c in itertools.product(wishes, repeat=3)]
    cases += [list(zip((5, 5, None), c, strict=True)) for c in itertools.product(wishes, repeat=3)]
    rows = [(m, n, w) for m, case in enumerate(cases) for n, w in case]
    got = outbox.inbox_states(spark.createDataFrame(rows, "m int, n int, w string"), "m", "n", "w")
    assert {r["m"]: r["status"] for r in got.collect()} == {m: folded(c) for m, c in enumerate(cases)}
    assert "collect_list" not in plan_of(got) and "partial_min" in plan_of(got)


def test_inbox_transition_takes_every_event(spark, sf):
    rows = equal_duckdb(spark, sf, "inbox_transition_all")
    assert len(rows) == spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id")).distinct().count()


# outbox_fanout, outbox_requeue


def test_outbox_queries_take_every_event(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    fanned = equal_duckdb(spark, sf, "outbox_fanout_all")
    assert max(uid for _, uid in fanned) - 600_000_000 >= 500
    assert len(equal_duckdb(spark, sf, "outbox_requeue_all")) == orders.count()


# priority_lineages


def test_numbers_within_keys_and_over_all_rows(spark):
    rows = [(None if i % 50 == 0 else 1 if i % 4 else i % 7, (i * 37) % 2000) for i in range(2000)]
    made = spark.createDataFrame(rows, "k int, v int")
    per, places = {}, {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        per[k] = per.get(k, 0) + 1
        places[v] = per[k]
    within = numbered(made, "n", [F.col("v")], ["k"])
    assert within.columns == ["k", "v", "n"] and {r["v"]: r["n"] for r in within.collect()} == places
    assert sorted((r["v"], r["n"]) for r in numbered(made, "n", [-F.col("v")]).collect()) == [(v, 2000 - v) for v in range(2000)]
    assert numbered(made.where("false"), "n", [F.col("v")], ["k"]).count() == 0


def test_every_parent_s_edges_are_ordered(spark, sf):
    rows = equal_duckdb(spark, sf, "priority_lineages_all")
    assert {uid // 10**17 for _, uid in rows} == {1, 2, 3, 6}


# edge_endpoints, revision_chains, mermaid_lines, graph_presentation


def test_graph_queries_take_whole_tables(spark, sf):
    instance, lineage = (t.count() for t in model(spark, sf, "instance", "lineage"))
    assert len(equal_duckdb(spark, sf, "edge_endpoints_all")) == lineage
    assert len(equal_duckdb(spark, sf, "revision_chains_all")) == 3 * instance
    assert len(equal_duckdb(spark, sf, "graph_presentation_all")) == instance
    lines = equal_duckdb(spark, sf, "mermaid_lines_all")
    assert sorted(position for _, part, position in lines if part == 1) == list(range(1, instance + 1))


def test_mermaid_has_no_window_over_all_rows(spark, sf):
    assert "Window [row_number" not in plan_of(entity.QUERIES["mermaid_lines_all"](spark, sf))
    equal_duckdb(spark, sf, "mermaid_lines")


# descendants_of_customer, duplicate_dedupe_keys


def test_walks_end_or_fail(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "MAX_LEVELS", 7)
    nodes = spark.range(1, 10).select(F.col("id").alias("uid"), F.lit(False).alias("is_deleted"))
    edges = lambda n: spark.range(1, n).select(F.col("id").alias("parent_instance_uid"), (F.col("id") + 1).alias("child_instance_uid"))
    assert graph.descendants(nodes, edges(8), 1).count() == 8
    with pytest.raises(ValueError, match="levels"):
        graph.descendants(nodes, edges(9), 1)
    assert max(n for n, _ in equal_duckdb(spark, sf, "descendants_of_region")) >= 1
    assert equal_duckdb(spark, sf, "descendants_of_customer")


def test_layouts_end_or_fail(spark, monkeypatch):
    monkeypatch.setattr(templates, "MAX_DEPTH", 2)
    parents = spark.createDataFrame([("p", "c0", "P", None)], "id string, code string, name string, tenant_id string")
    layouts = lambda n: spark.createDataFrame([(f"c{i}", f"c{i + 1}", 2, None, "contains") for i in range(n)], "code string, child_code string, count int, name_pattern string, relationship_type string")
    assert templates.expand_layouts(parents, layouts(2))[0].count() == 6
    with pytest.raises(ValueError, match="deeper"):
        templates.expand_layouts(parents, layouts(3))


def test_duplicates_list_every_member(spark, sf):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "b"), (5, "a")], "id int, k string")
    assert sorted(r["id"] for r in stats.duplicate_members(rows, ["k"], "id").collect()) == [1, 2, 3, 5]
    equal_duckdb(spark, sf, "duplicate_dedupe_members")


# synthetic_edges, euid_assign


@pytest.mark.parametrize("name", ["synthetic_edges", "euid_assign"])
def test_numbers_without_a_window_over_all_rows(spark, sf, name):
    assert "Window [row_number" not in plan_of(entity.QUERIES[name](spark, sf))
    equal_duckdb(spark, sf, name)
