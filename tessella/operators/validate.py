"""Shapes of evidence, edges, nodes and batches as rows of faults, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import conditions as C
from tessella.functions import text as X

#: Kinds and limits.
NODE_KINDS = ("entry", "question", "section", "repeat_group", "terminal")
EDGE_KINDS = ("sequential", "unconditional", "default", "conditional")
PASSES = ("forward", "incoming_activation")
MOST_QUOTE = 2_000


def _faults(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return df.select(key, F.explode(found).alias("fault"))


def _blank(column: str) -> Column:
    return F.coalesce(F.length(F.trim(column)), F.lit(0)) == 0


def evidence_faults(evidence: DataFrame) -> DataFrame:
    """``evidence_id, fault`` of (evidence_id, evidence_type, kind, source, target, item, condition, origin, native_expression, confidence, quote)."""
    move, active = F.col("evidence_type") == "transition", F.col("evidence_type") == "activation"
    sure = F.col("confidence")
    return _faults(
        evidence,
        "evidence_id",
        {
            "type": ~F.coalesce(move | active, F.lit(False)),
            "transition_ends": move & (_blank("source") | _blank("target") | ~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False))),
            "transition_item": move & F.col("item").isNotNull(),
            "activation_item": active & (_blank("item") | F.col("condition").isNull()),
            "activation_target": active & F.col("target").isNotNull(),
            "native_origin": (F.col("origin") == "native") != F.col("native_expression").isNotNull(),
            "confidence": sure.isNull() | F.isnan(sure) | ~sure.between(0, 1),
            "quote": _blank("quote") | (F.length("quote") > MOST_QUOTE),
        },
    )


def edge_faults(edges: DataFrame) -> DataFrame:
    """``edge_id, fault``: a conditional edge has a condition, others none; a priority isn't negative."""
    conditional = F.col("kind") == "conditional"
    return _faults(
        edges,
        "edge_id",
        {"kind": ~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False)), "condition": conditional != F.col("condition").isNotNull(), "priority": F.col("priority") < 0, "ends": _blank("source") | _blank("target")},
    )


def node_faults(nodes: DataFrame) -> DataFrame:
    """``node, fault``: known kinds; only terminals have a terminal kind, and all of them; no entry or terminal holds children."""
    terminal = F.col("kind") == "terminal"
    return _faults(
        nodes,
        "node",
        {
            "kind": ~F.coalesce(F.col("kind").isin(*NODE_KINDS), F.lit(False)),
            "terminal_kind": terminal != F.col("terminal_kind").isNotNull(),
            "children": F.col("kind").isin("entry", "terminal", "question") & (F.coalesce(F.col("n_children"), F.lit(0)) > 0),
        },
    )


def batch_faults(batches: DataFrame, evidence: DataFrame) -> DataFrame:
    """``chunk_id, fault`` of answers: the pass asked for, exactly the items asked for in their order, unique local ids, only
    what the pass may hold, and conditions within limits.

    ``batches``: chunk_id, pass_kind, asked_pass, examined, asked (arrays); ``evidence``: chunk_id, local_id, evidence_type,
    condition, quote.
    """
    own = _faults(batches, "chunk_id", {"pass": ~F.coalesce(F.col("pass_kind").isin(*PASSES), F.lit(False)) | (F.col("pass_kind") != F.col("asked_pass")), "examined": ~F.equal_null("examined", F.col("asked"))})
    twice = evidence.groupBy("chunk_id", "local_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id", F.lit("local_id").alias("fault"))
    held = evidence.join(batches.select("chunk_id", "pass_kind"), "chunk_id").filter("pass_kind = 'forward' and evidence_type = 'activation'").select("chunk_id", F.lit("activation_in_forward").alias("fault"))
    shapes = evidence.filter("condition is not null").select("chunk_id", F.explode(C.condition_faults(F.col("condition"))).alias("fault"))
    long = evidence.filter(F.length("quote") > MOST_QUOTE).select("chunk_id", F.lit("quote").alias("fault"))
    return own.unionByName(twice).unionByName(held).unionByName(shapes).unionByName(long).distinct()


def sound_batches(evidence: DataFrame, faults: DataFrame) -> DataFrame:
    """Evidence of batches without a fault: a batch is dropped as a whole."""
    return evidence.join(faults.select("chunk_id").distinct(), "chunk_id", "left_anti")


def merge_diagnostics(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Existing findings, then generated ones whose id isn't there and whose code isn't either; of equal ids one."""
    fresh = generated.dropDuplicates(["diagnostic_id"]).join(existing.select("diagnostic_id"), "diagnostic_id", "left_anti").join(existing.select("code").distinct(), "code", "left_anti")
    return existing.withColumn("is_carried", F.lit(True)).unionByName(fresh.withColumn("is_carried", F.lit(False)))


def unresolved_rollup(discrepancies: DataFrame, key: str) -> DataFrame:
    """``key, issue, n, needs_human`` of what is still open."""
    return discrepancies.filter("not is_resolved").groupBy(key, "issue").agg(F.count("*").alias("n"), F.bool_or("needs_human").alias("needs_human"))


def ordered_unique(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, value, place``: distinct values of a key, numbered by first appearance."""
    from pyspark.sql import Window

    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first", value)) - 1).drop("first")


#: Fixed value: the version of what a conversion gives, which bindings name.
CONVERSION = "1.0"


def source_bindings(documents: DataFrame, version: str = CONVERSION) -> DataFrame:
    """``doc_id, source_name, media_type, source_format, snapshot_sha256, version``: what a result says of the source it was made from."""
    return documents.select("doc_id", "source_name", "media_type", X.source_format(F.col("source_name"), F.col("media_type")).alias("source_format"), "snapshot_sha256", F.lit(version).alias("version"))


def binding_faults(bindings: DataFrame, documents: DataFrame, version: str = CONVERSION) -> DataFrame:
    """``doc_id, fault`` of bindings that aren't those of their document as it is now; a source without a digest binds nothing."""
    now = source_bindings(documents, version).select("doc_id", F.lit(True).alias("known"), *(F.col(c).alias(f"{c}_now") for c in ("source_name", "media_type", "source_format", "snapshot_sha256", "version")))
    told = bindings.join(now, "doc_id", "left")
    rules = {"missing_document": F.col("known").isNull()}
    rules |= {c: F.col("known").isNotNull() & ~F.equal_null(c, f"{c}_now") for c in ("source_name", "media_type", "source_format", "version")}
    rules["digest"] = F.col("known").isNotNull() & (F.col("snapshot_sha256").isNull() | ~F.equal_null("snapshot_sha256", "snapshot_sha256_now"))
    return _faults(told, "doc_id", rules)
