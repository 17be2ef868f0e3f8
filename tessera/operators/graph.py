"""Lineage graph: walks that count paths, searches that count nodes, payloads and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import among, cut, dealt, numbered
from ..functions.scalars import clean, mermaid_text
from ..model import live

#: Most levels of a walk without a depth of its own.
MAX_LEVELS = 100

# Display colours of categories.
COLOURS = {
    "workflow": "#00FF7F", "workflow_step": "#ADFF2F", "container": "#8B00FF", "content": "#00BFFF", "equipment": "#FF4500", "data": "#FFD700", "actor": "#FF69B4", "action": "#FF8C00",
    "test_requisition": "#FFA500", "health_event": "#DC143C", "file": "#00FF00", "subject": "#9370DB", "lineage": "#C49BFF", "generic": "#888888",
}


def live_edges(lineage: DataFrame) -> DataFrame:
    return live(lineage).select(F.col("parent_instance_uid").alias("parent"), F.col("child_instance_uid").alias("child"), "relationship_type")


def doubled(edges: DataFrame) -> DataFrame:
    """Edges in both directions, so that a search both ways is one equi-join."""
    return edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))


def _paths(start: DataFrame, edges: DataFrame, depth: int, once: bool, whole: bool = False) -> DataFrame:
    """uid, depth, one row per path from the start's uids, level by level; ``once``: no node twice on a path;
    ``whole``: an error if there are rows beyond the depth.

    Edges and levels are cut, so a level costs one join and no earlier one is computed again.
    """
    edges = cut(edges.select("parent", "child"))
    level = cut(start.select("uid", F.lit(0).alias("depth"), F.array("uid").alias("path")))
    found = level.select("uid", "depth")
    for d in range(1, depth + 1):
        ahead = level.join(edges, F.col("uid") == F.col("parent"))
        if once:
            ahead = ahead.where(~F.array_contains("path", F.col("child")))
        path = F.array_append("path", F.col("child")) if once else F.col("path")
        level = cut(ahead.select(F.col("child").alias("uid"), F.lit(d).alias("depth"), path.alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level.select("uid", "depth"))
    else:
        if whole and not level.join(edges, F.col("uid") == F.col("parent")).isEmpty():
            raise ValueError(f"the walk has not ended after {depth} levels; the graph may have a cycle")
    return found


def walk(instance: DataFrame, lineage: DataFrame, root: int, depth: int) -> DataFrame:
    """uid, depth, one row per path (a bag): downward over live edges to live nodes, no node twice on a path."""
    edges = live_edges(lineage).join(live(instance).select(F.col("uid").alias("child")), "child", "left_semi")
    return _paths(instance.where(F.col("uid") == root), edges, depth, once=True)


def walk_summary(walked: DataFrame) -> DataFrame:
    return walked.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def descendants(instance: DataFrame, lineage: DataFrame, root: int, levels: int | None = None) -> DataFrame:
    """uid, depth, one row per path, the root first: edges count even if deleted, children must be live.

    Without a number of levels the walk goes on until no rows are left; as nothing keeps a graph free of
    cycles, it is an error if there are some after MAX_LEVELS.
    """
    edges = lineage.select(F.col("parent_instance_uid").alias("parent"), F.col("child_instance_uid").alias("child"))
    edges = edges.join(live(instance).select(F.col("uid").alias("child")), "child", "left_semi")
    return _paths(instance.where(F.col("uid") == root), edges, MAX_LEVELS if levels is None else levels, once=False, whole=levels is None)


def newest(walked: DataFrame, instance: DataFrame, limit: int) -> DataFrame:
    return walked.join(instance.select("uid", "euid", "created_dt"), "uid").orderBy(F.col("created_dt").desc(), "uid").limit(limit)


def reach(start: DataFrame, steps: DataFrame, depth: int, nodes: DataFrame | None = None) -> DataFrame:
    """uid, depth: every node once, at its least distance along the steps (a, b) from the start's uids;
    only over ``nodes`` (uid), if given.

    A level reads the steps from its nodes alone, so steps are neither kept nor made distinct.
    """
    found = frontier = cut(start.select("uid").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        ahead = among(steps, "a", frontier).select(F.col("b").alias("uid")).distinct().join(found, "uid", "left_anti")
        if nodes is not None:
            ahead = among(nodes.select("uid"), "uid", cut(ahead)).distinct()
        frontier = cut(ahead.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def neighbourhood(instance: DataFrame, lineage: DataFrame, root: int, depth: int) -> DataFrame:
    """Nodes within a distance in both directions; start, nodes and edges are live."""
    nodes = live(instance).select("uid")
    return reach(nodes.where(F.col("uid") == root), doubled(live_edges(lineage)), depth, nodes)


def incident_edges(nodes: DataFrame, lineage: DataFrame) -> DataFrame:
    """Live edges with both ends among the nodes, each once."""
    ids = cut(nodes.select("uid").distinct())
    edges = live(lineage).select("uid", "parent_instance_uid", "child_instance_uid", "relationship_type")
    return among(among(edges, "parent_instance_uid", ids), "child_instance_uid", ids)


def payload_nodes(instance: DataFrame, lineage: DataFrame, root: int, depth: int) -> DataFrame:
    """Nodes of a graph payload: deleted nodes count, deleted edges don't; breadth first."""
    return reach(instance.where(F.col("uid") == root), doubled(live_edges(lineage)), depth)


def payload_edges(nodes: DataFrame, lineage: DataFrame, depth: int) -> DataFrame:
    """Edges of a graph payload: those of every node nearer than the depth, so some lead outside.

    source is the child and target the parent; the semantic ends are the other way round.
    """
    inner = cut(nodes.where(F.col("depth") < depth).select("uid").distinct())
    edges = live(lineage).select("uid", "parent_instance_uid", "child_instance_uid", "relationship_type")
    parts = [among(edges, end, inner) for end in ("parent_instance_uid", "child_instance_uid")]
    both = parts[0].unionByName(parts[1]).distinct()
    return both.select("uid", F.col("child_instance_uid").alias("source"), F.col("parent_instance_uid").alias("target"), F.col("parent_instance_uid").alias("semantic_source"), F.col("child_instance_uid").alias("semantic_target"), "relationship_type")


def overview(instance: DataFrame, lineage: DataFrame, nodes: int, edges: int) -> DataFrame:
    """Up to so many edges among the first so many live instances, both in the order of their uids."""
    first = live(instance).orderBy("uid").limit(nodes)
    return incident_edges(first, lineage).orderBy("uid").limit(edges)


def with_endpoints(lineage: DataFrame, instance: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with the names and identifiers of both ends; edges with a missing end go (or have nulls)."""
    out = lineage
    for end in ("parent", "child"):
        side = instance.select(F.col("uid").alias(f"{end}_instance_uid"), F.col("euid").alias(f"{end}_euid"), F.col("name").alias(f"{end}_name"))
        out = out.join(side, f"{end}_instance_uid", how)
    return out


def relationships(instance: DataFrame, lineage: DataFrame, uid: int) -> DataFrame:
    """direction, other_uid, relationship_type of an object's live edges."""
    edges = live_edges(lineage)
    down = edges.where(F.col("parent") == uid).select(F.lit("parent_of").alias("direction"), F.col("child").alias("uid"), "relationship_type")
    up = edges.where(F.col("child") == uid).select(F.lit("child_of").alias("direction"), F.col("parent").alias("uid"), "relationship_type")
    return down.unionByName(up).join(instance.select("uid", "euid", "name"), "uid", "left")


def by_priority(edges: DataFrame, first: list[str], kind: str = "child_type", key: str = "child_instance_uid") -> DataFrame:
    return edges.orderBy(F.when(F.col(kind).isin(*first), 0).otherwise(1), F.coalesce(F.col(key).cast("string"), F.lit("")))


def numbered_by_priority(edges: DataFrame, first: list[str], parent: str = "parent_instance_uid", kind: str = "child_type", key: str = "child_instance_uid") -> DataFrame:
    """uid, place: each parent's edges numbered in the order of by_priority, equal ones by their uids."""
    order = [F.when(F.col(kind).isin(*first), 0).otherwise(1), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("uid")]
    return numbered(edges.select("uid", parent, kind, key), "place", order, [parent]).select("uid", "place")


def waves(edges: DataFrame, start: int, levels: int, down: bool = True) -> DataFrame:
    """uid, depth of the nodes reached level by level in one direction, without the start."""
    a, b = ("parent", "child") if down else ("child", "parent")
    steps = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    root = edges.sparkSession.range(start, start + 1).withColumnRenamed("id", "uid")
    return reach(root, steps, levels).where("depth > 0")


def induced(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> DataFrame:
    """Edges between nodes whose type isn't hidden."""
    shown = nodes.where(~F.col("type").isin(*hidden)).select("uid")
    for end in ("parent", "child"):
        edges = edges.join(shown.withColumnRenamed("uid", end), end, "left_semi")
    return edges.select("parent", "child", "relationship_type")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, degree over the edges given; nodes without edges have 0."""
    n = nodes.count()
    ends = dealt(doubled(edges).select(F.col("a").alias("uid")), n, "uid").groupBy("uid").agg(F.count("*").alias("degree"))
    return dealt(nodes.select("uid"), n, "uid").join(ends, "uid", "left").fillna(0, ["degree"])


def graph_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with the query in any single field."""
    q = query.strip().lower()
    fields = ("euid", "name", "type", "category", "subtype")
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.coalesce(F.col(f), F.lit(""))).contains(q)
    return nodes.where(hit)


def colour(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return F.coalesce(table[clean(category)], F.lit(COLOURS["generic"]))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """position, line of a Mermaid chart: nodes numbered in the order of their uids, then edges.

    Both are numbered by ranges, so the graph shown may be the whole one.
    """
    shown = numbered(nodes.select("uid", "name"), "n", [F.col("uid")]).withColumn("n", F.col("n").cast("int"))
    lines = shown.select(F.lit(1).alias("part"), F.col("n").alias("position"), F.concat(F.lit("N"), F.col("n").cast("string"), F.lit('["'), mermaid_text(F.col("name")), F.lit('"]')).alias("line"))
    ids = shown.select("uid", F.col("n").cast("string").alias("n"))
    joined = edges.join(ids.select(F.col("uid").alias("parent"), F.col("n").alias("p")), "parent").join(ids.select(F.col("uid").alias("child"), F.col("n").alias("c")), "child")
    placed = numbered(joined, "position", [F.col("parent"), F.col("child"), F.col("relationship_type")])
    links = placed.select(F.lit(2).alias("part"), F.col("position").cast("int").alias("position"), F.concat(F.lit("N"), F.col("p"), F.lit(" -->|"), mermaid_text(F.col("relationship_type")), F.lit("| N"), F.col("c")).alias("line"))
    return lines.unionByName(links)


def namespaced(nodes: DataFrame, edges: DataFrame, system: str, tenant: str | None, bridge_from: str, root: str) -> tuple[DataFrame, DataFrame]:
    """A remote graph's nodes (id) and edges (source, target) under names of their own, with one edge from a local node."""
    name = lambda c: F.concat_ws("::", F.lit("ext"), F.lit(system), F.lit(tenant or "global"), F.col(c))
    kept = nodes.where(F.trim("id") != "").withColumn("id", name("id"))
    links = edges.where((F.trim("source") != "") & (F.trim("target") != "")).select(name("source").alias("source"), name("target").alias("target"))
    bridge = nodes.sparkSession.createDataFrame([(bridge_from, f"ext::{system}::{tenant or 'global'}::{root}")], "source string, target string")
    return kept, links.unionByName(bridge)


def merge_new(shown: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """What is shown, and the added elements whose key isn't."""
    return shown.unionByName(added.dropDuplicates([key]).join(shown.select(key), key, "left_anti").select(*shown.columns))


def synthetic_edges(nodes: DataFrame, count: int) -> DataFrame:
    """parent, child: ``count`` distinct edges over n nodes without self-loops; needs count <= n (n - 1).

    The i-th edge goes from node i mod n; its child lies 1 + (i / n) mod (n - 1) nodes further.
    """
    spark, n = nodes.sparkSession, nodes.count()
    if not 0 <= count <= n * (n - 1):
        raise ValueError("more edges than pairs of nodes")
    indexed = numbered(nodes.select("uid"), "n", [F.col("uid")]).select("uid", (F.col("n") - 1).alias("idx"))
    pairs = spark.range(count).select((F.col("id") % n).alias("p"), F.pmod(F.col("id") % n + 1 + F.expr(f"id div {n}") % max(n - 1, 1), F.lit(n)).alias("c"))
    parents, children = (indexed.select(F.col("uid").alias(name), F.col("idx").alias(k)) for name, k in (("parent", "p"), ("child", "c")))
    return pairs.join(parents, "p").join(children, "c").select("parent", "child")


def revision_chains(bases: DataFrame, revisions: int) -> DataFrame:
    """newer, older: each base's revisions, every revision the parent of the one before it."""
    step = bases.select("uid", F.explode(F.sequence(F.lit(1), F.lit(revisions))).alias("revision"))
    name = lambda r: F.concat(F.col("uid").cast("string"), F.lit("/"), r.cast("string"))
    return step.select(name(F.col("revision")).alias("newer"), name(F.col("revision") - 1).alias("older"), F.lit("revision_of").alias("relationship_type"))


def new_edge(parents: DataFrame, children: DataFrame, pairs: DataFrame, relationship: str) -> DataFrame:
    """Edge rows for pairs (parent, child), with one spelling of the edge's type; a node isn't its own child."""
    p = parents.select(F.col("uid").alias("parent"), F.col("polymorphic_discriminator").alias("parent_type"))
    c = children.select(F.col("uid").alias("child"), F.col("polymorphic_discriminator").alias("child_type"))
    joined = pairs.where("parent <> child").join(p, "parent").join(c, "child")
    return joined.select(F.col("parent").alias("parent_instance_uid"), F.col("child").alias("child_instance_uid"), "parent_type", "child_type", F.lit(relationship).alias("relationship_type"), F.lit("lineage").alias("category"), F.lit("lineage").alias("type"), F.lit("generic").alias("subtype"), F.lit("1.0").alias("version"))


def missing_targets(wanted: DataFrame, instance: DataFrame) -> DataFrame:
    """Identifiers (euid) that are asked for, each once, and stand for no live instance."""
    return wanted.select(F.trim("euid").alias("euid")).distinct().join(live(instance).select("euid"), "euid", "left_anti")


def orphan_edges(lineage: DataFrame, instance: DataFrame) -> DataFrame:
    """Edges with an end that is no live instance, and which."""
    ids = live(instance).select("uid")
    ends = [live(lineage).select("uid", F.lit(e).alias("side"), F.col(f"{e}_instance_uid").alias("missing")) for e in ("parent", "child")]
    return ends[0].unionByName(ends[1]).join(ids.withColumnRenamed("uid", "missing"), "missing", "left_anti").select("uid", "side", "missing")
