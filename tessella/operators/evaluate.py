"""Scores of results against what was expected: multisets, rates, deltas, field accuracy, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import graph


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return part / F.nullif(whole, F.lit(0))


def multiset_metrics(expected: DataFrame, actual: DataFrame, by: list[str], identity: list[str]) -> DataFrame:
    """``by, n_expected, n_actual, n_matched, precision, recall``: matches are the smaller of both counts of an identity."""
    e = expected.groupBy(*by, *identity).agg(F.count("*").alias("e"))
    a = actual.groupBy(*by, *identity).agg(F.count("*").alias("a"))
    both = e.unionByName(a, allowMissingColumns=True).groupBy(*by, *identity).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    sums = both.groupBy(*by).agg(F.sum("e").alias("n_expected"), F.sum("a").alias("n_actual"), F.sum(F.least("e", "a")).alias("n_matched"))
    return sums.withColumn("precision", ratio(F.col("n_matched"), F.col("n_actual"))).withColumn("recall", ratio(F.col("n_matched"), F.col("n_expected")))


def deltas(after: DataFrame, before: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Differences of the metrics; null where either side has none."""
    old = before.select(*by, *(F.col(m).alias(f"{m}_before") for m in metrics))
    return after.join(old, by, "full").select(*by, *((F.col(m) - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics))


def field_accuracy(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """``by, n_fields, n_equal, accuracy`` over leaves (by, path, value); a leaf that is missing counts as null."""
    joined = expected.join(actual.select(*by, "path", F.col("value").alias("got"), F.lit(True).alias("there")), [*by, "path"], "left")
    equal = F.equal_null("value", F.col("got"))
    out = joined.groupBy(*by).agg(F.count("*").alias("n_fields"), F.sum(equal.cast("int")).alias("n_equal"))
    return out.withColumn("accuracy", ratio(F.col("n_equal"), F.col("n_fields")))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metric, value, threshold, verdict``: passed, failed, or unavailable where there is no value."""
    return thresholds.join(metrics, "metric", "left").select(
        "metric", "value", "threshold", F.when(F.col("value").isNull(), "unavailable").when(F.col("value") >= F.col("threshold"), "passed").otherwise("failed").alias("verdict")
    )


def digest(rows: DataFrame, by: list[str], text: Column) -> DataFrame:
    """A digest of a multiset that doesn't depend on order: row digests summed, so nothing is collected."""
    part = lambda k: F.conv(F.substring(F.sha2(text, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"d{k}") for k in range(3))).select(*by, F.sha2(F.concat_ws(":", "n", *(F.col(f"d{k}").cast("string") for k in range(3))), 256).alias("digest"))


def result_status(results: DataFrame, key: str) -> DataFrame:
    """``key, status``: failed without output, partial with a failure, an error or a partial code, else success.

    ``results`` has key, has_output, n_failed, n_errors, n_partial_codes, one or more rows a key.
    """
    agg = results.groupBy(key).agg(F.bool_or("has_output").alias("any_output"), F.sum("n_failed").alias("f"), F.sum("n_errors").alias("e"), F.sum("n_partial_codes").alias("p"))
    return agg.select(key, F.when(~F.col("any_output"), "failed").when(F.col("f") + F.col("e") + F.col("p") > 0, "partial").otherwise("success").alias("status"))


def first_success(parts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, value, is_incomplete``: the first part that succeeded wins; incomplete if one failed or another differs."""
    out = parts.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value].alias(value), F.countDistinct(value).alias("n_values"), F.count(F.when(F.col(value).isNull(), 1)).alias("n_failed"))
    return out.select(key, value, ((F.col("n_values") > 1) | (F.col("n_failed") > 0)).alias("is_incomplete"))


def stage_rows(nodes: DataFrame, edges: DataFrame, loops: DataFrame, unresolved: DataFrame) -> DataFrame:
    """``stage, metric, identity``: what each part of a snapshot is told apart by; rows are counted, so repeats count.

    ``nodes``: stage, node, kind; ``edges``: stage, source, target, kind, condition_key, is_opaque; ``loops``: stage, kind,
    members (array); ``unresolved``: stage, source, reference. An unresolved route is an edge and a target of its own, so
    it is matched by none; conditions count where they aren't opaque.
    """
    row = lambda df, metric, *parts: df.select("stage", F.lit(metric).alias("metric"), F.to_json(F.array(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))).alias("identity"))
    lost = unresolved.withColumn("n", F.concat(F.col("stage"), F.lit("?"), F.xxhash64("source", "reference").cast("string")))
    parts = [
        row(nodes, "node", "node", "kind"),
        row(nodes.filter("kind = 'terminal'"), "terminal", "node"),
        row(edges, "edge", "source", "target", "kind", "condition_key"),
        row(lost, "edge", "source", "reference", "n"),
        row(edges, "target", "source", "target"),
        row(lost, "target", "reference", "n"),
        row(edges.filter("kind = 'conditional' and not is_opaque"), "condition", "source", "target", "condition_key"),
        row(loops.withColumn("m", F.array_join(F.sort_array("members"), "\u0001")), "loop", "kind", "m"),
    ]
    return reduce(DataFrame.unionByName, parts)


def stage_metrics(rows: DataFrame, expected: str) -> DataFrame:
    """``stage, metric, n_expected, n_actual, n_matched, precision, recall`` of every stage but the expected one against it."""
    counts = rows.groupBy("stage", "metric", "identity").agg(F.count("*").alias("n"))
    want = counts.filter(F.col("stage") == expected)
    whole = want.groupBy("metric").agg(F.sum("n").alias("n_expected"))
    got = counts.filter(F.col("stage") != expected).join(want.select("metric", "identity", F.col("n").alias("e")), ["metric", "identity"], "left")
    sums = got.groupBy("stage", "metric").agg(F.sum("n").alias("n_actual"), F.sum(F.least("n", F.coalesce("e", F.lit(0)))).alias("n_matched"))
    sums = sums.join(whole, "metric", "left").withColumn("n_expected", F.coalesce("n_expected", F.lit(0))).select("stage", "metric", "n_expected", "n_actual", "n_matched")
    return sums.withColumn("precision", ratio(F.col("n_matched"), F.col("n_actual"))).withColumn("recall", ratio(F.col("n_matched"), F.col("n_expected")))


def stage_rates(edges: DataFrame, unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """``stage, n_routes, unresolved_rate, opaque_rate, n_invented``: routes without a target, conditions that can't be told, ends that are no node."""
    known = nodes.select("stage", "node")
    ends = edges.select("stage", F.explode(F.array("source", "target")).alias("node")).distinct()
    invented = ends.join(known, ["stage", "node"], "left_anti").groupBy("stage").agg(F.count("*").alias("n_invented"))
    routes = edges.select("stage", F.lit(0).alias("lost"), (F.col("kind") == "conditional").cast("int").alias("asks"), (F.coalesce("is_opaque", F.lit(False)) & (F.col("kind") == "conditional")).cast("int").alias("opaque"))
    lost = unresolved.select("stage", F.lit(1).alias("lost"), F.lit(0).alias("asks"), F.lit(0).alias("opaque"))
    sums = routes.unionByName(lost).groupBy("stage").agg(F.count("*").alias("n_routes"), F.sum("lost").alias("lost"), F.sum("asks").alias("asks"), F.sum("opaque").alias("opaque"))
    told = sums.join(invented, "stage", "left")
    return told.select("stage", "n_routes", ratio(F.col("lost"), F.col("n_routes")).alias("unresolved_rate"), ratio(F.col("opaque"), F.col("asks")).alias("opaque_rate"), F.coalesce("n_invented", F.lit(0)).alias("n_invented"))


def stage_faults(nodes: DataFrame, edges: DataFrame, loops: DataFrame) -> DataFrame:
    """``stage, fault, subject``: what makes a snapshot no graph of flow.

    Ends that are no node, edges out of a terminal or into an entry, several defaults of a source, members of a loop that
    don't reach each other. ``loops``: stage, loop_id, members.
    """
    kinds = lambda end: nodes.select("stage", F.col("node").alias(end), F.col("kind").alias("end_kind"))
    row = lambda df, fault, subject: df.select("stage", F.lit(fault).alias("fault"), F.col(subject).cast("string").alias("subject"))
    parts = [row(edges.join(kinds(end), ["stage", end], "left_anti"), "unknown_end", end) for end in ("source", "target")]
    parts.append(row(edges.join(kinds("source").filter("end_kind = 'terminal'"), ["stage", "source"], "left_semi"), "terminal_leads_on", "source"))
    parts.append(row(edges.join(kinds("target").filter("end_kind = 'entry'"), ["stage", "target"], "left_semi"), "entry_is_reached", "target"))
    parts.append(row(edges.filter("kind = 'default'").groupBy("stage", "source").agg(F.count("*").alias("n")).filter("n > 1"), "several_defaults", "source"))
    members = loops.select("stage", "loop_id", F.explode("members").alias("node"))
    flat = lambda c: F.concat_ws("\u0001", "stage", "loop_id", c)
    end = lambda c: members.select("stage", "loop_id", F.col("node").alias(c))
    inner = edges.join(end("source"), ["stage", "source"]).join(end("target"), ["stage", "loop_id", "target"]).select(flat("source").alias("source"), flat("target").alias("target"))
    placed = members.withColumn("flat", flat("node"))
    components = graph.strong_components(placed.select(F.col("flat").alias("node")), inner)
    cyclic = graph.cyclic_components(components, inner).select("component", F.lit(True).alias("cyclic"))
    told = placed.join(components.join(cyclic, "component", "left").select(F.col("node").alias("flat"), "component", "cyclic"), "flat", "left")
    broken = told.groupBy("stage", "loop_id").agg(F.countDistinct("component").alias("n"), F.bool_and(F.coalesce("cyclic", F.lit(False))).alias("cyclic")).filter("n > 1 or not cyclic")
    parts.append(row(broken, "loop_is_open", "loop_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def corpus_recall(expected: DataFrame, actual: DataFrame, by: list[str], name: str, fields: list[str], dense: str) -> DataFrame:
    """``by, n_expected, n_found, recall, n_judged, n_equal, field_accuracy, n_dense, n_dense_found, dense_recall``.

    An expected record is found as often as its name comes in the result; judged fields are those of the first of each name
    on both sides; ``dense`` marks records of crowded tables, which are counted by themselves as well.
    """
    key = [*by, name]
    want = expected.groupBy(*key).agg(F.count("*").alias("e"), F.sum(F.col(dense).cast("int")).alias("d"), *(F.min(f).alias(f"{f}_e") for f in fields))
    got = actual.groupBy(*key).agg(F.count("*").alias("a"), *(F.min(f).alias(f"{f}_a") for f in fields))
    told = want.join(got, key, "left").withColumn("found", F.least("e", F.coalesce("a", F.lit(0)))).withColumn("dense_found", F.least("d", F.coalesce("a", F.lit(0))))
    equal = reduce(lambda a, b: a + b, [(F.col("a").isNotNull() & F.equal_null(f"{f}_e", F.col(f"{f}_a"))).cast("int") for f in fields])
    sums = told.groupBy(*by).agg(F.sum("e").alias("n_expected"), F.sum("found").alias("n_found"), F.sum(F.when(F.col("a").isNotNull(), len(fields)).otherwise(0)).alias("n_judged"), F.sum(equal).alias("n_equal"), F.sum("d").alias("n_dense"), F.sum("dense_found").alias("n_dense_found"))
    rates = {"recall": ("n_found", "n_expected"), "field_accuracy": ("n_equal", "n_judged"), "dense_recall": ("n_dense_found", "n_dense")}
    return sums.withColumns({n: ratio(F.col(p), F.col(w)) for n, (p, w) in rates.items()})


def golden_pairs(fixtures: DataFrame) -> DataFrame:
    """``source_id, source_path, output_path`` of fixtures (fixture_id, role, source_id, path) whose source and output are both there."""
    source = fixtures.filter("role = 'source'").select(F.col("fixture_id").alias("source_id"), F.col("path").alias("source_path"))
    return source.join(fixtures.filter("role = 'output'").select("source_id", F.col("path").alias("output_path")), "source_id")
