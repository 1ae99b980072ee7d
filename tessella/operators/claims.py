"""Evidence of flow brought together: claims, their issues, accepted edges, activation consensus, branch coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import identity as I

#: Issues of a claim in their order, and those that a person must settle.
ISSUES = (
    "ambiguous_target", "unresolved_target", "fuzzy_target", "opaque_condition", "unresolved_condition", "unclear_statement",
    "conflicting_target", "conflicting_default", "conflicting_priority", "incoming_only", "bypassed_successor", "inferred_cycle", "unsupported_inference",
)
FOR_PEOPLE = ("ambiguous_target", "opaque_condition", "conflicting_target", "unclear_statement")


def build_claims(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence grouped by (source, target, kind, condition): order of first sight, best confidence, agreed priority, perspectives.

    ``evidence``: keys, source, target, kind, condition_key, pos, evidence_id, confidence, priority, perspective. The
    priority is the only one named, else null with ``priorities_differ``. Evidence ids are in order of sight.
    """
    grouped = evidence.groupBy(*keys, "source", "target", "kind", "condition_key").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_evidence"),
        F.max("confidence").alias("confidence"),
        F.min("priority").alias("low"),
        F.max("priority").alias("high"),
        F.transform(F.sort_array(F.collect_set(F.struct("pos", "evidence_id"))), lambda e: e["evidence_id"]).alias("evidence_ids"),
        F.max((F.col("perspective") == "forward").cast("int")).alias("forward"),
        F.max((F.col("perspective") == "native").cast("int")).alias("native"),
        F.max((F.col("perspective") == "incoming").cast("int")).alias("incoming"),
    )
    same = F.col("low") == F.col("high")
    return grouped.withColumn("priority", F.when(same, F.col("low"))).withColumn("priorities_differ", F.coalesce(~same, F.lit(False))).drop("low", "high")


def count_beside(df: DataFrame, by: list[str], condition: Column, name: str) -> DataFrame:
    """Adds how many rows of the same ``by`` meet ``condition``: an aggregate joined back, as one source may have very many."""
    counts = df.filter(condition).groupBy(*by).agg(F.count("*").alias(name))
    return df.join(counts, by, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def mark_issues(claims: DataFrame, keys: list[str], has_local: bool = False) -> DataFrame:
    """Adds ``issues`` (array, in the order of ISSUES): conflicts between a source's claims, and claims that only an incoming view has.

    Local issues (an array column ``local_issues``) are kept if the claims bring them.
    """
    source = [*keys, "source"]
    told = count_beside(claims, source, F.col("kind") == "default", "n_default")
    shared = told.filter("priority is not null").groupBy(*source, "priority").agg(F.count("*").alias("n_priority"))
    told = told.join(shared, [*source, "priority"], "left")
    branch = [*source, "kind", "condition_key"]
    forward = told.filter("forward = 1 or native = 1").groupBy(*branch).agg(F.min("target").alias("low_target"), F.max("target").alias("high_target"), F.lit(True).alias("has_forward"))
    incoming = told.filter("incoming = 1 and forward = 0 and native = 0").groupBy(*branch).agg(F.lit(True).alias("has_incoming"), F.min("target").alias("low_in"), F.max("target").alias("high_in"))
    told = told.join(forward, branch, "left").join(incoming, branch, "left")
    only_incoming = (F.col("incoming") == 1) & (F.col("forward") == 0) & (F.col("native") == 0)
    disagrees = F.when(only_incoming, F.col("has_forward")).otherwise(F.col("has_incoming"))
    codes = {
        "conflicting_target": F.coalesce(disagrees, F.lit(False)),
        "conflicting_default": (F.col("kind") == "default") & (F.col("n_default") > 1),
        "conflicting_priority": F.col("priorities_differ") | (F.coalesce("n_priority", F.lit(0)) > 1),
        "incoming_only": only_incoming & F.col("has_forward").isNull(),
    }
    found = F.array_compact(F.array(*(F.when(codes[i], F.lit(i)) for i in ISSUES if i in codes)))
    issues = F.concat(F.col("local_issues"), found) if has_local else found
    return told.withColumn("issues", issues).drop("n_default", "n_priority", "low_target", "high_target", "has_forward", "has_incoming", "low_in", "high_in")


def accepted_edges(marked: DataFrame) -> DataFrame:
    """Claims without an issue that a forward or native view supports."""
    return marked.filter((F.size("issues") == 0) & ((F.col("forward") == 1) | (F.col("native") == 1)))


def candidates(marked: DataFrame) -> DataFrame:
    """Claims with issues, and who has to settle them."""
    people = F.arrays_overlap("issues", F.array(*map(F.lit, FOR_PEOPLE)))
    return marked.filter(F.size("issues") > 0).withColumn("status", F.when(people, "needs_human_review").otherwise("needs_agent_review"))


def discrepancies(marked: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source, issue, n_claims, first_pos, needs_human``: one row for each issue of each source."""
    rank = F.create_map(*(x for n, i in enumerate(ISSUES) for x in (F.lit(i), F.lit(n))))
    return (
        marked.select(*keys, "source", "first_pos", F.explode("issues").alias("issue"))
        .groupBy(*keys, "source", "issue")
        .agg(F.count("*").alias("n_claims"), F.min("first_pos").alias("first_pos"))
        .withColumn("needs_human", F.col("issue").isin(*FOR_PEOPLE))
        .withColumn("issue_rank", rank[F.col("issue")])
    )


def edge_id(source: Column, target: Column, kind: Column, condition_key: Column, priority: Column) -> Column:
    """Content id of an edge; the texts are ASCII."""
    number = F.coalesce(priority.cast("string"), F.lit("null"))
    return I.stable_id_of("edge", I.canonical_object(condition=I.json_string(condition_key), kind=I.json_string(kind), priority=number, source=I.json_string(source), target=I.json_string(target)))


def merge_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row an edge id: highest confidence, evidence once each in order of sight, the latest decision; ``rank`` orders a graph's edges."""
    merged = edges.groupBy(*keys, "edge_id").agg(
        F.first("source").alias("source"), F.first("target").alias("target"), F.first("kind").alias("kind"), F.min("priority").alias("priority"), F.max("confidence").alias("confidence"), F.min("first_pos").alias("first_pos"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first_pos", "evidence_ids"))), lambda e: e["evidence_ids"]))).alias("evidence_ids"), F.max_by("decision_id", "decision_ord").alias("decision_id"),
    )
    return merged.withColumn("rank", F.struct(F.coalesce("priority", F.lit(2**31 - 1)).alias("p"), "first_pos", "edge_id"))


def expected_successors(inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``successor``: the next item, no entry, of the same section and parent."""
    w = Window.partitionBy(*keys, "section", "parent").orderBy("source_order")
    return inventory.filter("kind != 'entry'").withColumn("successor", F.lead("node_id").over(w))


def inference_issues(claims: DataFrame, successors: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``inference_issue`` of inferred sequential claims: an edge back is a cycle, one past the successor bypasses it."""
    at = lambda end: order.select(*keys, F.col("node_id").alias(end), F.col("source_order").alias(f"{end}_order"))
    told = claims.join(successors.select(*keys, F.col("node_id").alias("source"), "successor"), [*keys, "source"], "left").join(at("source"), [*keys, "source"], "left").join(at("target"), [*keys, "target"], "left")
    inferred = (F.col("kind") == "sequential") & F.col("is_inferred")
    issue = F.when(inferred & (F.col("target_order") <= F.col("source_order")), "inferred_cycle").when(inferred & ~F.equal_null("target", F.col("successor")), "bypassed_successor")
    return told.withColumn("inference_issue", issue).drop("successor", "source_order", "target_order")


def activation_consensus(activations: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, condition, n_conditions, is_conflict``: one agreed condition a node, or a conflict."""
    found = activations.groupBy(*keys, "node").agg(F.countDistinct("condition_key").alias("n_conditions"), F.min_by("condition", "pos").alias("condition"))
    return found.withColumn("is_conflict", F.col("n_conditions") > 1).withColumn("condition", F.when(F.col("n_conditions") == 1, F.col("condition")))


def branch_coverage(branches: DataFrame, domains: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source, n_known, n_covered, is_covered, has_overlap`` of sources with a known domain of values.

    ``branches``: keys, source, branch, value (the values a branch certainly takes, one a row; a null value is a branch
    that proves nothing). ``domains``: keys, source, value. Counts are aggregates; nothing is collected a source.
    """
    known = domains.groupBy(*keys, "source").agg(F.countDistinct("value").alias("n_known"))
    inside = branches.join(domains.select(*keys, "source", "value").distinct(), [*keys, "source", "value"], "left_semi").distinct()
    taken = inside.groupBy(*keys, "source", "value").agg(F.count("*").alias("n_branches"))
    covered = taken.groupBy(*keys, "source").agg(F.count("*").alias("n_covered"), F.max("n_branches").alias("most"))
    unproven = branches.groupBy(*keys, "source").agg(F.max(F.col("value").isNull().cast("int")).alias("unproven"))
    told = known.join(unproven, [*keys, "source"]).join(covered, [*keys, "source"], "left")
    n = F.coalesce("n_covered", F.lit(0))
    return told.select(*keys, "source", "n_known", n.alias("n_covered"), ((n == F.col("n_known")) & (F.col("unproven") == 0)).alias("is_covered"), ((F.coalesce("most", F.lit(0)) > 1) | (F.col("unproven") == 1)).alias("has_overlap"))


def agreed_codes(options: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, codes`` where all variables linked to a node have the same ordered codes; others have no known domain."""
    w = options.groupBy(*keys, "node", "variable").agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", "code")))).alias("codes"))
    return w.groupBy(*keys, "node").agg(F.countDistinct("codes").alias("n"), F.min("codes").alias("codes")).filter("n = 1").drop("n")


def risk_targets(inventory: DataFrame, findings: DataFrame, keys: list[str], predicates: tuple[str, ...]) -> DataFrame:
    """``keys, node, reasons``: nodes with at least one risk, the reasons in the order of ``predicates``.

    ``findings`` (keys, node, reason) is the union of what the single predicates found.
    """
    rank = F.create_map(*(x for n, p in enumerate(predicates) for x in (F.lit(p), F.lit(n))))
    ranked = findings.withColumn("r", rank[F.col("reason")]).filter("r is not null").join(inventory.select(*keys, F.col("node_id").alias("node")), [*keys, "node"], "left_semi")
    names = F.array(*map(F.lit, predicates))
    return ranked.groupBy(*keys, "node").agg(F.sort_array(F.collect_set("r")).alias("rs")).select(*keys, "node", F.transform("rs", lambda r: F.element_at(names, r + 1)).alias("reasons"))


def unknown_codes(values: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` (keys, node, t, s and what else they bring) that aren't among the node's known codes, by type and text.

    ``codes``: keys, node, t, s. Nodes without known codes have nothing to be compared with.
    """
    known = codes.select(*keys, "node").distinct()
    return values.join(known, [*keys, "node"], "left_semi").join(codes.select(*keys, "node", "t", "s"), [*keys, "node", "t", "s"], "left_anti")


def local_issues(observations: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source, target, kind, condition_key, local_issues``: what each claim's own observations show, in the order of ISSUES.

    ``observations``: the claim's columns and target_resolution, source_resolution, is_fuzzy, is_opaque, is_condition_resolved,
    is_clear, is_supported (booleans, null for what isn't known).
    """
    said = {
        "ambiguous_target": F.col("target_resolution") == "ambiguous",
        "unresolved_target": (F.col("target_resolution") == "unresolved") | (F.col("source_resolution") != "resolved"),
        "fuzzy_target": F.col("is_fuzzy"),
        "opaque_condition": F.col("is_opaque"),
        "unresolved_condition": ~F.col("is_condition_resolved"),
        "unclear_statement": ~F.col("is_clear"),
        "unsupported_inference": ~F.col("is_supported"),
    }
    claim = [*keys, "source", "target", "kind", "condition_key"]
    seen = observations.groupBy(*claim).agg(*(F.max(F.coalesce(said[i], F.lit(False)).cast("int")).alias(i) for i in ISSUES if i in said))
    return seen.select(*claim, F.array_compact(F.array(*(F.when(F.col(i) == 1, F.lit(i)) for i in ISSUES if i in said))).alias("local_issues"))
