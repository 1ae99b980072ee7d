"""Directed multigraphs of flow, over a whole corpus: reachability, components, containment, loops, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import row_numbers
from tessella.runtime import cut_lineage

MOST_ROUNDS = 10_000
MOST_EDGES = 100_000


def reachable(starts: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, node, depth`` of nodes reached from ``starts`` (keys, node) along ``edges`` (keys, source, target).

    Breadth first: each round joins the frontier with the edges and leaves out what was seen; the state is cut in the
    shared folder, so a lost executor costs no round. Cycles end, as nothing is visited twice.
    """
    keys = keys or []
    links = cut_lineage(edges.select(*keys, F.col("source").alias("node"), "target").filter("node is not null and target is not null").distinct())
    frontier = cut_lineage(starts.select(*keys, "node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, MOST_ROUNDS):
        found = frontier.join(links, [*keys, "node"]).select(*keys, F.col("target").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            return seen
        seen = cut_lineage(seen.unionByName(frontier))
    raise RuntimeError("reachability not settled")


def unreachable(nodes: DataFrame, starts: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return nodes.join(reachable(starts, edges, keys), [*keys, "node"], "left_anti")


def dead_ends(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes that are no terminal and have no edge out."""
    keys = keys or []
    return nodes.filter("not is_terminal").join(edges.select(*keys, F.col("source").alias("node")), [*keys, "node"], "left_anti")


def without_terminal_path(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes from which no terminal is reached: what the reversed edges don't reach from the terminals."""
    keys = keys or []
    back = edges.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))
    return unreachable(nodes, nodes.filter("is_terminal").select(*keys, "node"), back, keys)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components, named by their smallest node.

    Trims nodes without an edge in or out, then colours: every node takes the smallest node that reaches it, and a
    colour's nodes that reach back to the colour's own node are a component; they leave and the rest goes on.
    """
    rest = cut_lineage(nodes.select("node").filter("node is not null").distinct())
    links = cut_lineage(edges.select("source", "target").filter("source is not null and target is not null and source != target").distinct().join(rest.withColumnRenamed("node", "source"), "source", "left_semi").join(rest.withColumnRenamed("node", "target"), "target", "left_semi"))
    done = None
    for _ in range(MOST_ROUNDS):
        # Nodes without an edge in and one out are components by themselves.
        while True:
            kept = links.select(F.col("source").alias("node")).intersect(links.select(F.col("target").alias("node")))
            kept = cut_lineage(kept)
            alone = rest.join(kept, "node", "left_anti").withColumn("component", F.col("node"))
            if not alone.head(1):
                break
            done = cut_lineage(alone if done is None else done.unionByName(alone))
            rest = kept
            links = cut_lineage(links.join(rest.withColumnRenamed("node", "source"), "source", "left_semi").join(rest.withColumnRenamed("node", "target"), "target", "left_semi"))
        if not rest.head(1):
            return done if done is not None else rest.withColumn("component", F.col("node"))
        colours = cut_lineage(rest.withColumn("colour", F.col("node")))
        while True:
            passed = links.join(colours.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("other"))
            moved = cut_lineage(colours.join(passed, "node", "left").select("node", F.least("colour", F.coalesce("other", "colour")).alias("colour")))
            changed = moved.join(colours, ["node", "colour"], "left_anti").head(1)
            colours = moved
            if not changed:
                break
        same = links.join(colours.select(F.col("node").alias("source"), F.col("colour").alias("c1")), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("c2")), "target").filter("c1 = c2")
        back = same.select(F.col("c1").alias("colour"), F.col("target").alias("source"), F.col("source").alias("target"))
        found = reachable(colours.filter("node = colour").select("colour", "node"), back, ["colour"]).select("node", F.col("colour").alias("component"))
        done = cut_lineage(found if done is None else done.unionByName(found))
        rest = cut_lineage(rest.join(found, "node", "left_anti"))
        links = cut_lineage(links.join(rest.withColumnRenamed("node", "source"), "source", "left_semi").join(rest.withColumnRenamed("node", "target"), "target", "left_semi"))
    raise RuntimeError("components not settled")


def cyclic_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, n_nodes`` of components with two nodes or more, or with an edge from a node to itself."""
    loops = edges.filter("source = target").select(F.col("source").alias("node")).distinct().withColumn("loops", F.lit(1))
    return components.join(loops, "node", "left").groupBy("component").agg(F.count("*").alias("n_nodes"), F.coalesce(F.max("loops"), F.lit(0)).alias("loops")).filter("n_nodes > 1 or loops = 1").select("component", "n_nodes")


def loop_edge_roles(components: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """``component, source, target, role`` of edges at cyclic components: entry, exit, return (to itself or not onwards) or internal."""
    cyclic = components.join(cyclic_components(components, edges).select("component"), "component", "left_semi")
    at = lambda end: order.select(F.col("node").alias(end), F.col("ord").alias(f"{end}_ord"))
    told = (
        edges.join(cyclic.select(F.col("node").alias("source"), F.col("component").alias("c1")), "source", "left")
        .join(cyclic.select(F.col("node").alias("target"), F.col("component").alias("c2")), "target", "left")
        .join(at("source"), "source").join(at("target"), "target")
        .filter("c1 is not null or c2 is not null")
    )
    inside = F.col("c1") == F.col("c2")
    role = F.when(inside & (F.col("target_ord") <= F.col("source_ord")), "return").when(inside, "internal")
    one = told.filter(F.coalesce(inside, F.lit(False))).select(F.col("c1").alias("component"), "source", "target", role.alias("role"))
    out = told.filter(~F.coalesce(inside, F.lit(False)) & F.col("c1").isNotNull()).select(F.col("c1").alias("component"), "source", "target", F.lit("exit").alias("role"))
    into = told.filter(~F.coalesce(inside, F.lit(False)) & F.col("c2").isNotNull()).select(F.col("c2").alias("component"), "source", "target", F.lit("entry").alias("role"))
    return one.unionByName(out).unionByName(into)


def loops(roles: DataFrame) -> DataFrame:
    """``component, kind, has_exit``: a loop with one return edge is a correction, one with more is general."""
    n = F.count(F.when(F.col("role") == "return", 1))
    return roles.groupBy("component").agg(F.when(n == 1, "correction_return").otherwise("general").alias("kind"), (F.count(F.when(F.col("role") == "exit", 1)) > 0).alias("has_exit"))


def descendants(parents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, ancestor, node, depth`` from (keys, node, parent): a fixpoint by doubling; a node that is its own ancestor shows a cycle."""
    keys = keys or []
    known = cut_lineage(parents.filter("parent is not null").select(*keys, F.col("parent").alias("ancestor"), "node", F.lit(1).alias("depth")))
    count = known.count()
    while True:
        further = known.join(known.select(*keys, F.col("ancestor").alias("node"), F.col("node").alias("below"), F.col("depth").alias("more")), [*keys, "node"])
        longer = further.select(*keys, "ancestor", F.col("below").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        known = cut_lineage(known.unionByName(longer).groupBy(*keys, "ancestor", "node").agg(F.min("depth").alias("depth")))
        now = known.count()
        if now == count:
            return known
        count = now


def containment_faults(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, node, fault``: a parent that doesn't exist, or a node inside itself."""
    keys = keys or []
    has = nodes.filter("parent is not null")
    dangling = has.join(nodes.select(*keys, F.col("node").alias("parent")), [*keys, "parent"], "left_anti").select(*keys, "node", F.lit("missing_parent").alias("fault"))
    cycle = descendants(has.select(*keys, "node", "parent"), keys).filter("ancestor = node").select(*keys, "node", F.lit("cycle").alias("fault"))
    return dangling.unionByName(cycle)


def duplicate_edges(edges: DataFrame, identity: list[str]) -> DataFrame:
    """Edges that mean the same: the ``identity`` columns and how often they come."""
    return edges.groupBy(*identity).agg(F.count("*").alias("n")).filter("n > 1")


def dangling_edges(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, edge_id, missing`` (source or target) of ends that are no node."""
    keys = keys or []
    out = None
    for end in ("source", "target"):
        gone = edges.join(nodes.select(*keys, F.col("node").alias(end)), [*keys, end], "left_anti").select(*keys, "edge_id", F.lit(end).alias("missing"))
        out = gone if out is None else out.unionByName(gone)
    return out


def adjacency(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, node, edge_ids, neighbours``: edges out in order of ``rank``; each neighbour once, where it comes first.

    A node's arrays are one row's; a node of more than MOST_EDGES edges is refused, and ``numbered_edges`` is for such graphs.
    """
    keys = keys or []
    if edges.groupBy(*keys, "source").count().filter(F.col("count") > MOST_EDGES).head(1):
        raise ValueError(f"a node has more than {MOST_EDGES} edges")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "edge_id", "target")))
    return edges.groupBy(*keys, F.col("source").alias("node")).agg(ordered.alias("e")).select(*keys, "node", F.transform("e", lambda x: x["edge_id"]).alias("edge_ids"), F.array_distinct(F.transform("e", lambda x: x["target"])).alias("neighbours"))


def scale_graph(spark, n_nodes: int, n_edges: int) -> DataFrame:
    """``source, target``: an acyclic graph of a chain, then of edges two apart, three apart and so on, made where it is read."""
    full = 1
    while sum(n_nodes - d for d in range(1, full + 1)) < n_edges and full < n_nodes - 1:
        full += 1
    distances = spark.range(1, full + 1).select(F.col("id").alias("distance"))
    edges = distances.select("distance", F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1) - F.col("distance"))).alias("source")).withColumn("target", F.col("source") + F.col("distance"))
    rank = (F.col("distance") - 1) * n_nodes - (F.col("distance") * (F.col("distance") - 1) / 2).cast("long") + F.col("source")
    return edges.filter(rank < n_edges).select("source", "target")


def containers_without_entry(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, node, n``: nodes that hold others and have not exactly one unconditional edge to their entry child.

    ``nodes``: keys, node, parent, is_entry; ``edges``: keys, source, target, kind.
    """
    keys = keys or []
    holders = nodes.filter("parent is not null").select(*keys, F.col("parent").alias("node")).distinct()
    doors = nodes.filter("parent is not null and is_entry").select(*keys, F.col("parent").alias("source"), F.col("node").alias("target"))
    inward = edges.filter("kind = 'unconditional'").select(*keys, "source", "target").join(doors, [*keys, "source", "target"], "left_semi")
    counts = inward.groupBy(*keys, F.col("source").alias("node")).agg(F.count("*").alias("n"))
    return holders.join(counts, [*keys, "node"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n != 1")


def declared_regions(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, region, node, size``: each repeat group with all that it holds, itself too. ``nodes``: keys, node, parent, kind."""
    keys = keys or []
    groups = nodes.filter("kind = 'repeat_group'").select(*keys, F.col("node").alias("region"))
    inner = descendants(nodes.select(*keys, "node", "parent"), keys).select(*keys, F.col("ancestor").alias("region"), "node").join(groups, [*keys, "region"], "left_semi")
    members = inner.unionByName(groups.withColumn("node", F.col("region"))).distinct()
    return members.join(members.groupBy(*keys, "region").agg(F.count("*").alias("size")), [*keys, "region"])


def declared_edge_roles(regions: DataFrame, edges: DataFrame, order: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, region, edge_id, role`` of edges at declared repeats: entry, exit, and inside the smallest repeat that holds both
    ends (of equal ones the first) return or internal.

    ``edges``: keys, edge_id, source, target; ``order``: keys, node, ord.
    """
    keys = keys or []
    at = lambda end: order.select(*keys, F.col("node").alias(end), F.col("ord").alias(f"{end}_ord"))
    member = lambda end: regions.select(*keys, F.col("region").alias(f"{end}_region"), F.col("node").alias(end), "size")
    out = edges.join(member("source"), [*keys, "source"]).withColumnRenamed("source_region", "region")
    into = edges.join(member("target"), [*keys, "target"]).withColumnRenamed("target_region", "region")
    inside = out.join(into.select(*keys, "region", "edge_id"), [*keys, "region", "edge_id"])
    placed = inside.join(order.select(*keys, F.col("node").alias("region"), F.col("ord").alias("region_ord")), [*keys, "region"])
    owner = placed.groupBy(*keys, "edge_id").agg(F.min_by("region", F.struct("size", "region_ord")).alias("region"))
    owned = edges.join(owner, [*keys, "edge_id"]).join(at("source"), [*keys, "source"]).join(at("target"), [*keys, "target"])
    turn = F.when(F.col("target_ord") <= F.col("source_ord"), "return").otherwise("internal")
    beyond = lambda one, other, role: one.join(other.select(*keys, "region", "edge_id"), [*keys, "region", "edge_id"], "left_anti").select(*keys, "region", "edge_id", F.lit(role).alias("role"))
    return owned.select(*keys, "region", "edge_id", turn.alias("role")).unionByName(beyond(out, into, "exit")).unionByName(beyond(into, out, "entry"))


def undeclared_components(components: DataFrame, regions: DataFrame) -> DataFrame:
    """``component`` of those that no declared repeat holds whole. ``regions``: region, node, over the same nodes."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    held = components.join(regions.select("region", "node"), "node").groupBy("component", "region").agg(F.count("*").alias("inside"))
    whole = held.join(sizes, "component").filter("inside = n").select("component").distinct()
    return sizes.join(whole, "component", "left_anti").select("component")


def numbered_edges(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``edges`` with ``place``: each edge's number, from 1, among those of its source in order of ``rank``; for nodes of any degree."""
    return row_numbers(edges, [*(keys or []), "source"], ["rank", "edge_id"], "place")
