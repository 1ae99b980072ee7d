"""Which items of a questionnaire need a second look: nine predicates over evidence whose references have been looked up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import claims, graph

#: The predicates in their order, and the defaults of their limits.
PREDICATES = (
    "unresolved_target", "ambiguous_target", "cross_section", "opaque_condition", "low_confidence", "branch_target", "unusual_out_degree", "unusual_in_degree", "cycle",
)
LOW_CONFIDENCE, MOST_CANDIDATES, OUT_DEGREE, IN_DEGREE, BRANCH = 0.7, 10, 3, 4, 2


def findings(moves: DataFrame, inventory: DataFrame, keys: list[str], examined: DataFrame | None = None, low: float = LOW_CONFIDENCE) -> DataFrame:
    """``keys, node, reason``: what each predicate finds.

    ``moves``: keys, move_id, source (its node, null if it isn't told), targets (array of candidate nodes, none if
    unresolved), is_opaque, confidence; ``inventory``: keys, node_id, section. A finding is laid on a move's targets, or on
    its source where it has none; more than MOST_CANDIDATES targets are laid on the source. ``examined`` (keys, node) are
    the items of answers that listed references they couldn't tell. Degrees and cycles count moves with one target only.
    """
    sections = inventory.select(*keys, F.col("node_id").alias("node"), "section")
    told = moves.withColumn("n", F.size("targets"))
    laid = F.when(F.col("n") > 0, F.col("targets")).otherwise(F.when(F.col("source").isNotNull(), F.array("source")))
    few = F.when(F.col("n") <= MOST_CANDIDATES, F.col("targets")).otherwise(F.when(F.col("source").isNotNull(), F.array("source")))
    on = lambda df, nodes, reason: df.select(*keys, F.explode(nodes).alias("node"), F.lit(reason).alias("reason"))
    ends = told.filter("source is not null").select(*keys, "move_id", "source", F.explode("targets").alias("node"))
    placed = ends.join(sections, [*keys, "node"], "left").join(sections.select(*keys, F.col("node").alias("source"), F.col("section").alias("own")), [*keys, "source"], "left")
    crossing = placed.filter(~F.equal_null("section", "own")).select(*keys, "move_id").distinct()
    sure = told.filter("n = 1 and source is not null").select(*keys, "source", F.element_at("targets", 1).alias("target"))
    out_degrees = sure.groupBy(*keys, "source").agg(F.count("*").alias("n"))
    branches = sure.join(out_degrees.filter(F.col("n") >= BRANCH), [*keys, "source"])
    in_degrees = sure.groupBy(*keys, F.col("target").alias("node")).agg(F.count("*").alias("n"))
    whole = lambda c: F.concat_ws("\u0001", *keys, c)
    links = sure.select(whole("source").alias("source"), whole("target").alias("target")).distinct()
    nodes = sections.select(*keys, "node", whole("node").alias("flat"))
    components = graph.strong_components(nodes.select(F.col("flat").alias("node")), links)
    cyclic = components.join(graph.cyclic_components(components, links).select("component"), "component", "left_semi").select(F.col("node").alias("flat"))
    parts = [
        on(told.filter("n = 0"), laid, "unresolved_target"),
        on(told.filter("n > 1"), few, "ambiguous_target"),
        on(told.join(crossing, [*keys, "move_id"], "left_semi"), laid, "cross_section"),
        on(told.filter("is_opaque"), laid, "opaque_condition"),
        on(told.filter(F.col("confidence") < low), laid, "low_confidence"),
        branches.select(*keys, F.col("target").alias("node"), F.lit("branch_target").alias("reason")),
        branches.filter(F.col("n") >= OUT_DEGREE).select(*keys, F.col("target").alias("node"), F.lit("unusual_out_degree").alias("reason")),
        in_degrees.filter(F.col("n") >= IN_DEGREE).select(*keys, "node", F.lit("unusual_in_degree").alias("reason")),
        nodes.join(cyclic, "flat", "left_semi").select(*keys, "node", F.lit("cycle").alias("reason")),
    ]
    if examined is not None:
        parts.append(examined.select(*keys, "node", F.lit("unresolved_target").alias("reason")))
    return reduce(DataFrame.unionByName, parts).filter("node is not null").distinct()


def select_targets(moves: DataFrame, inventory: DataFrame, keys: list[str], examined: DataFrame | None = None, low: float = LOW_CONFIDENCE) -> DataFrame:
    """``keys, node, reasons``: items with at least one finding, the reasons in the order of PREDICATES."""
    return claims.risk_targets(inventory, findings(moves, inventory, keys, examined, low), keys, PREDICATES)
