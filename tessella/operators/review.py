"""Append-only review: active decisions, statuses, packets of what belongs together, integrity of references."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.components import connected_components
from tessella.operators.ordered import ordered_fold

MOST_IN_PACKET = 25


def active_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that no other supersedes; ``decisions`` has decision_id and supersedes (nullable)."""
    gone = decisions.filter("supersedes is not null").select(F.col("supersedes").alias("decision_id"))
    return decisions.join(gone, "decision_id", "left_anti")


def latest_decision(decisions: DataFrame, by: list[str]) -> DataFrame:
    """The last decision by ``ord`` of each subject."""
    last = decisions.groupBy(*by).agg(F.max(F.struct("ord", "decision_id")).alias("last"))
    return last.select(*by, F.col("last.decision_id").alias("decision_id"), F.col("last.ord").alias("ord"))


def candidate_status(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with ``status`` by their last active decision: confirmed, rejected, replaced, else as they were."""
    last = latest_decision(active_decisions(decisions).select("decision_id", "ord", "action", F.explode("candidate_ids").alias("candidate_id")), ["candidate_id"])
    told = last.join(decisions.select("decision_id", "action"), "decision_id")
    status = F.create_map(*map(F.lit, ("confirm", "confirmed", "reject", "rejected", "replace", "replaced")))[F.col("action")]
    return candidates.join(told.select("candidate_id", "action"), "candidate_id", "left").withColumn("status", F.coalesce(status, F.col("status"))).drop("action")


def packets(discrepancies: DataFrame, key: str = "survey_id", most: int = MOST_IN_PACKET) -> DataFrame:
    """``key, discrepancy_id, packet``: a survey's discrepancies that share candidates stay together, packed in order up to ``most``.

    Components come from links between each candidate's first discrepancy and its others, so a candidate that all
    discrepancies share gives a star, not all pairs. A component above ``most`` is a packet of its own.
    """
    pairs = discrepancies.select("discrepancy_id", "ord", F.explode("candidate_ids").alias("candidate_id"))
    hub = pairs.groupBy("candidate_id").agg(F.min_by("discrepancy_id", "ord").alias("hub"))
    links = pairs.join(hub, "candidate_id").select("discrepancy_id", "hub")
    components = connected_components(links, "discrepancy_id", "hub")
    placed = discrepancies.select(key, "discrepancy_id", "ord").join(components.withColumnRenamed("node", "discrepancy_id"), "discrepancy_id", "left").withColumn("component", F.coalesce("component", "discrepancy_id"))
    sizes = placed.groupBy(key, "component").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    schema = T.StructType([T.StructField("component", placed.schema["component"].dataType), T.StructField("packet", T.IntegerType())])

    def step(state, row):
        if state["n"] and state["n"] + row["n"] > most:
            state["packet"] += 1
            state["n"] = 0
        state["n"] += row["n"]
        return [(row["component"], state["packet"])]

    numbered = ordered_fold(sizes, [key], ["first"], lambda: {"n": 0, "packet": 0}, step, lambda s, k: [], schema)
    return placed.join(numbered, "component").select(key, "discrepancy_id", "packet")


def missing_references(owners: DataFrame, owner_id: str, array: str, targets: DataFrame, target_id: str) -> DataFrame:
    """``owner_id, missing``: ids in an array column that no target row has."""
    used = owners.select(owner_id, F.explode(array).alias("missing"))
    return used.join(targets.select(F.col(target_id).alias("missing")), "missing", "left_anti").select(owner_id, "missing")


def neighbours_of(targets: DataFrame, inventory: DataFrame, keys: list[str], before: int = 3) -> DataFrame:
    """``keys, target, node_id, why``: the items just before a target and the last item of each other section before it.

    One fold over the inventory in order: it holds the last items and the last item of each section seen.
    """
    kind = inventory.schema["node_id"].dataType
    schema = T.StructType([*(inventory.schema[k] for k in keys), T.StructField("target", kind), T.StructField("node_id", kind), T.StructField("why", T.StringType())])
    marked = inventory.select(*keys, "source_order", "node_id", "section").join(targets.select(*keys, "node_id", F.lit(True).alias("is_target")), [*keys, "node_id"], "left")

    def step(seen, row):
        near, ends = seen
        out = []
        if row["is_target"]:
            own = (*(row[k] for k in keys), row["node_id"])
            out = [(*own, item, "preceding") for item in near] + [(*own, item, "section_end") for section, item in ends.items() if section != row["section"]]
        near.append(row["node_id"])
        ends[row["section"]] = row["node_id"]
        return out

    return ordered_fold(marked, keys, ["source_order", "node_id"], lambda: (deque(maxlen=before), {}), step, lambda seen, key: [], schema)


def reviewed_edges(accepted: DataFrame, candidates: DataFrame, decisions: DataFrame, replacements: DataFrame) -> DataFrame:
    """Accepted edges, those of candidates whose last active decision confirms them, and those put in their place.

    ``candidates``: candidate_id, status and an edge's columns; ``replacements``: decision_id and an edge's columns. Edges
    that earlier reviews brought are not kept: they are derived anew from the decisions that are active now. Adds
    ``origin`` and ``decision_id``.
    """
    edge = [c for c in accepted.columns if c in replacements.columns]
    active = active_decisions(decisions)
    last = latest_decision(active.select("decision_id", "ord", F.explode("candidate_ids").alias("candidate_id")), ["candidate_id"]).join(active.select("decision_id", "action"), "decision_id")
    confirmed = candidates.join(last.filter("action = 'confirm'").select("candidate_id", "decision_id"), "candidate_id").select(*edge, F.lit("confirmed").alias("origin"), "decision_id")
    put = replacements.join(last.filter("action = 'replace'").select("decision_id").distinct(), "decision_id").select(*edge, F.lit("replacement").alias("origin"), "decision_id")
    return accepted.select(*edge, F.lit("accepted").alias("origin"), F.lit(None).cast(decisions.schema["decision_id"].dataType).alias("decision_id")).unionByName(confirmed).unionByName(put)


def resolve_discrepancies(discrepancies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``is_resolved``: every candidate of a discrepancy has been confirmed, rejected or replaced."""
    told = discrepancies.select("discrepancy_id", F.explode("candidate_ids").alias("candidate_id")).join(candidates.select("candidate_id", "status"), "candidate_id", "left")
    done = told.groupBy("discrepancy_id").agg(F.bool_and(F.coalesce(F.col("status").isin("confirmed", "rejected", "replaced"), F.lit(False))).alias("is_resolved"))
    return discrepancies.join(done, "discrepancy_id", "left").withColumn("is_resolved", F.coalesce("is_resolved", F.lit(False)))


def packet_closure(placed: DataFrame, discrepancies: DataFrame, candidates: DataFrame, evidence: DataFrame, key: str = "survey_id") -> DataFrame:
    """``key, packet, what, id``: everything that a packet's discrepancies lead to: candidates, their evidence, its spans and ends."""
    one = placed.join(discrepancies.select(key, "discrepancy_id", "candidate_ids"), [key, "discrepancy_id"])
    cs = one.select(key, "packet", F.explode("candidate_ids").alias("candidate_id")).distinct()
    es = cs.join(candidates.select("candidate_id", "source", "target", F.explode("evidence_ids").alias("evidence_id")), "candidate_id")
    spans = es.select(key, "packet", "evidence_id").distinct().join(evidence.select("evidence_id", "span_id"), "evidence_id")
    rows = lambda df, what, column: df.select(key, "packet", F.lit(what).alias("what"), F.col(column).cast("string").alias("id"))
    parts = [rows(one, "discrepancy", "discrepancy_id"), rows(cs, "candidate", "candidate_id"), rows(es, "evidence", "evidence_id"), rows(spans, "span", "span_id"), rows(es, "node", "source"), rows(es, "node", "target")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def audit_faults(candidates: DataFrame, discrepancies: DataFrame, decisions: DataFrame, evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """``owner, owner_id, what, missing``: every reference of a review's tables that leads nowhere.

    Candidates name evidence; discrepancies candidates, evidence and spans; decisions candidates, discrepancies and the
    decision they supersede; evidence names its span.
    """
    ids = {"evidence": evidence.select("evidence_id"), "candidate": candidates.select("candidate_id"), "discrepancy": discrepancies.select("discrepancy_id"), "decision": decisions.select("decision_id"), "span": spans.select("span_id")}
    one = lambda df, own, column: df.select(own, F.array(column).alias(column))
    named = [
        ("candidate", candidates, "evidence_ids", "evidence"),
        ("discrepancy", discrepancies, "candidate_ids", "candidate"),
        ("discrepancy", discrepancies, "evidence_ids", "evidence"),
        ("discrepancy", discrepancies, "span_ids", "span"),
        ("decision", decisions, "candidate_ids", "candidate"),
        ("decision", decisions, "discrepancy_ids", "discrepancy"),
        ("decision", one(decisions.filter("supersedes is not null"), "decision_id", "supersedes"), "supersedes", "decision"),
        ("evidence", one(evidence, "evidence_id", "span_id"), "span_id", "span"),
    ]
    out = None
    for owner, df, column, what in named:
        if column not in df.columns:
            continue
        gone = missing_references(df, f"{owner}_id", column, ids[what], f"{what}_id").select(F.lit(owner).alias("owner"), F.col(f"{owner}_id").cast("string").alias("owner_id"), F.lit(what).alias("what"), F.col("missing").cast("string").alias("missing"))
        out = gone if out is None else out.unionByName(gone)
    return out


def citation_faults(answers: DataFrame, packets: DataFrame, candidates: DataFrame, evidence: DataFrame, most_spans: int = 8) -> DataFrame:
    """``answer_id, fault`` of review answers that cite what they may not.

    ``answers``: answer_id, packet, action, discrepancy_ids, candidate_ids, evidence_ids, span_ids; ``packets``: packet,
    discrepancy_ids, candidate_ids; ``candidates``: candidate_id, evidence_ids; ``evidence``: evidence_id, span_id. Cited
    discrepancies and candidates must be the packet's, cited evidence that of the cited candidates, cited spans those of
    the cited evidence; something is cited of each, and at most ``most_spans`` spans.
    """
    asked = answers.join(packets.select("packet", F.col("discrepancy_ids").alias("own_discrepancies"), F.col("candidate_ids").alias("own_candidates")), "packet", "left")
    none = F.array().cast("array<string>")
    held = lambda column, own: F.size(F.array_except(F.coalesce(column, none), F.coalesce(own, none))) > 0
    rules = {
        "packet": F.col("own_candidates").isNull(),
        "discrepancy": held("discrepancy_ids", "own_discrepancies"),
        "candidate": held("candidate_ids", "own_candidates"),
        "nothing_cited": (F.coalesce(F.size("candidate_ids"), F.lit(0)) <= 0) | (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0) | (F.coalesce(F.size("span_ids"), F.lit(0)) <= 0),
        "too_many_spans": F.size("span_ids") > most_spans,
        "action": ~F.coalesce(F.col("action").isin("confirm", "reject", "replace"), F.lit(False)),
    }
    shapes = asked.select("answer_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules.items())))).alias("fault"))
    cited = answers.select("answer_id", F.explode("candidate_ids").alias("candidate_id")).join(candidates.select("candidate_id", F.explode("evidence_ids").alias("evidence_id")), "candidate_id").select("answer_id", "evidence_id").distinct()
    said = answers.select("answer_id", F.explode("evidence_ids").alias("evidence_id"))
    stray = said.join(cited, ["answer_id", "evidence_id"], "left_anti").select("answer_id", F.lit("evidence").alias("fault"))
    shown = said.join(evidence.select("evidence_id", "span_id"), "evidence_id").select("answer_id", "span_id").distinct()
    lost = answers.select("answer_id", F.explode("span_ids").alias("span_id")).join(shown, ["answer_id", "span_id"], "left_anti").select("answer_id", F.lit("span").alias("fault"))
    return shapes.unionByName(stray).unionByName(lost).distinct()


def supersession_faults(decisions: DataFrame) -> DataFrame:
    """``decision_id, fault``: a decision that supersedes one of other candidates, itself or a later one; ids given twice."""
    sets = decisions.select(F.col("decision_id").alias("supersedes"), F.sort_array(F.array_distinct("candidate_ids")).alias("before"), F.col("ord").alias("before_ord"))
    told = decisions.join(sets, "supersedes").withColumn("now", F.sort_array(F.array_distinct("candidate_ids")))
    other = told.filter("now != before").select("decision_id", F.lit("other_candidates").alias("fault"))
    late = told.filter("before_ord >= ord").select("decision_id", F.lit("not_earlier").alias("fault"))
    twice = decisions.groupBy("decision_id").agg(F.count("*").alias("n")).filter("n > 1").select("decision_id", F.lit("repeated").alias("fault"))
    return other.unionByName(late).unionByName(twice).distinct()
