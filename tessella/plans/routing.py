"""Questionnaire flow over a corpus: inventory, evidence of native forms, accepted edges, analysis of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import conditions as C
from tessella.functions import identity as I
from tessella.operators import claims, graph, resolve
from tessella.operators.ordered import row_numbers
from tessella.runtime import cut_lineage

#: Findings of a graph's analysis, in order.
CODES = ("dangling_edge", "duplicate_edge", "missing_parent", "containment_cycle", "container_without_entry", "several_defaults", "unreachable", "dead_end", "no_terminal_path", "loop_without_exit", "opaque_condition")


def text_inventory(blocks: DataFrame) -> DataFrame:
    """``doc_id, source_order, kind, printed, text``: an entry, the questions printed in the blocks, a terminal.

    A question line is a number or an id, a mark and a text, or an ITEM line.
    """
    lines = blocks.select("doc_id", "ord", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    numbered = F.regexp_extract("line", r"^\s*([A-Za-z]{0,3}[0-9]{1,4}[a-z]?)\s*[.):]\s+\S", 1)
    item = F.regexp_extract("line", r"^\s*ITEM\s+(\S+)", 1)
    printed = F.when(item != "", item).when(numbered != "", numbered)
    asked = lines.withColumn("printed", printed).filter("printed is not null").select("doc_id", F.struct(F.lit(1).alias("part"), "ord", "line_no").alias("source_order"), F.lit("question").alias("kind"), "printed", F.trim("line").alias("text"))
    docs = blocks.select("doc_id").distinct()
    ends = [docs.select("doc_id", F.struct(F.lit(p).alias("part"), F.lit(0).alias("ord"), F.lit(0).alias("line_no")).alias("source_order"), F.lit(k).alias("kind"), F.lit(n).alias("printed"), F.lit(None).cast("string").alias("text")) for p, k, n in ((0, "entry", "ENTRY"), (2, "terminal", "END"))]
    return reduce(DataFrame.unionByName, [asked, *ends])


def inventory_nodes(inventory: DataFrame) -> DataFrame:
    """Adds alias, section and node_id."""
    told = inventory.withColumn("alias", I.alias_of(F.col("printed"))).withColumn("section", F.lit("root"))
    return resolve.node_ids(told, ["doc_id"], F.col("kind"), F.col("section"), F.col("alias"), F.sha2(F.coalesce("text", F.lit("")), 256))


def form_evidence(tables: dict[str, DataFrame]) -> DataFrame:
    """Native transitions as evidence: what a form states is certain and needs no other view."""
    moves = tables["transitions"].filter("target is not null")
    return moves.select(
        "form_id", "source", "target", "kind", F.lit("null").alias("condition_key"), F.xxhash64("form_id", "source", "target").alias("pos"), F.concat_ws(">", "source", "target").alias("evidence_id"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("int").alias("priority"), F.lit("native").alias("perspective"),
    )


def form_graph(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """nodes, edges, candidates and activations of native forms."""
    keys = ["form_id"]
    marked = cut_lineage(claims.mark_issues(claims.build_claims(form_evidence(tables), keys), keys))
    edges = claims.accepted_edges(marked).withColumn("edge_id", claims.edge_id(F.col("source"), F.col("target"), F.col("kind"), F.col("condition_key"), F.col("priority")))
    nodes = tables["items"].select("form_id", F.col("item").alias("node"), "parent", "kind", "ord", (F.col("kind") == "terminal").alias("is_terminal"))
    seen = tables["activations"].select("form_id", F.col("item").alias("node"), "condition", C.condition_key(F.col("condition")).alias("condition_key"), F.col("row_no").alias("pos"))
    return {"nodes": nodes, "edges": edges, "candidates": claims.candidates(marked), "activations": claims.activation_consensus(seen, keys)}


def analyse(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, code, node`` of everything that is wrong with the graphs, all graphs in one job.

    Strong components are found over nodes that carry their graph's key, so graphs don't mix.
    """
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    whole = lambda c: F.concat_ws("\u0001", *keys, c)
    marked = lambda df, code: df.select(*keys, F.lit(code).alias("code"), F.col("node").cast("string").alias("node"))
    starts = nodes.filter("kind = 'entry'").select(*keys, "node")
    ends = graph.dangling_edges(edges, nodes, keys)
    same = graph.duplicate_edges(edges, [*keys, "source", "target", "kind", "condition_key"]).withColumnRenamed("source", "node")
    containment = graph.containment_faults(nodes, keys)
    children = nodes.filter("parent is not null").select(*keys, F.col("parent").alias("node")).distinct()
    inward = edges.filter("kind = 'unconditional'").groupBy(*keys, F.col("source").alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select(*keys, "node")
    defaults = edges.filter("kind = 'default'").groupBy(*keys, F.col("source").alias("node")).agg(F.count("*").alias("n")).filter("n > 1")
    flat_nodes = nodes.select(whole("node").alias("node"), "ord")
    flat_edges = edges.select(whole("source").alias("source"), whole("target").alias("target")).distinct()
    components = cut_lineage(graph.strong_components(flat_nodes, flat_edges))
    loops = graph.loops(graph.loop_edge_roles(components, flat_edges, flat_nodes)).filter("not has_exit")
    stuck = loops.select(*(F.split("component", "\u0001")[n].cast(nodes.schema[k].dataType).alias(k) for n, k in enumerate(keys)), F.split("component", "\u0001")[len(keys)].alias("node"))
    found = [
        marked(ends.withColumnRenamed("edge_id", "node"), "dangling_edge"), marked(same, "duplicate_edge"), marked(containment.filter("fault = 'missing_parent'"), "missing_parent"), marked(containment.filter("fault = 'cycle'"), "containment_cycle"),
        marked(children.join(inward, [*keys, "node"], "left_anti"), "container_without_entry"), marked(defaults, "several_defaults"), marked(graph.unreachable(nodes, starts, edges, keys), "unreachable"), marked(graph.dead_ends(nodes, edges, keys), "dead_end"),
        marked(graph.without_terminal_path(nodes, edges, keys), "no_terminal_path"), marked(stuck, "loop_without_exit"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def reconcile(inventory: DataFrame, evidence: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """edges, candidates and discrepancies of evidence whose ends are printed references.

    ``inventory``: keys, node_id, kind, alias, section, source_order; ``evidence``: keys, source_ref, target_ref (aliases),
    section, target_section (explicit, nullable), kind, condition (JSON, nullable), pos, evidence_id, confidence, priority,
    perspective. A reference that isn't told stays in the claim by its alias and is an issue of the claim.
    """

    def told(df, end, explicit):
        asked = df.withColumn("alias", F.col(f"{end}_ref")).withColumnRenamed("kind", "edge_kind").withColumn("kind", F.lit("question")).withColumn("explicit", explicit).withColumn("default_section", F.col("section_of_chunk"))
        found = resolve.resolve(asked.withColumn("section", F.col("explicit")), inventory, keys)
        return found.withColumn(end, F.coalesce(F.col("node_id").cast("string"), F.concat(F.lit("ref:"), "alias"))).withColumnRenamed("resolution", f"{end}_resolution").drop("alias", "kind", "explicit", "default_section", "section", "node_id", "n_candidates").withColumnRenamed("edge_kind", "kind")

    base = evidence.withColumn("section_of_chunk", F.col("section")).withColumn("condition_key", C.condition_key(F.col("condition"))).withColumn("is_opaque", F.coalesce(F.contains("condition", F.lit('"opaque"')), F.lit(False)))
    ends = told(told(base, "source", F.lit(None).cast("string")), "target", F.col("target_section"))
    claimed = [*keys, "source", "target", "kind", "condition_key"]
    codes = {"ambiguous_target": F.col("target_resolution") == "ambiguous", "unresolved_target": (F.col("target_resolution") == "unresolved") | (F.col("source_resolution") != "resolved"), "opaque_condition": F.col("is_opaque")}
    local = ends.groupBy(*claimed).agg(*(F.max(c.cast("int")).alias(n) for n, c in codes.items())).select(*claimed, F.array_compact(F.array(*(F.when(F.col(n) == 1, F.lit(n)) for n in codes))).alias("local_issues"))
    built = claims.build_claims(ends, keys).join(local, claimed)
    marked = cut_lineage(claims.mark_issues(built, keys, has_local=True))
    edges = claims.accepted_edges(marked).withColumn("edge_id", claims.edge_id(F.col("source"), F.col("target"), F.col("kind"), F.col("condition_key"), F.col("priority")))
    return {"edges": edges, "candidates": claims.candidates(marked), "discrepancies": claims.discrepancies(marked, keys)}


def ordered_findings(found: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with ``place``: their order in a graph, by the code's place in CODES and then by node."""
    rank = F.create_map(*(x for n, c in enumerate(CODES) for x in (F.lit(c), F.lit(n))))
    return row_numbers(found.withColumn("rank", rank[F.col("code")]), keys, ["rank", "node"], "place").drop("rank")
