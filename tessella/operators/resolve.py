"""References to printed ids resolved by scoped look-ups; node ids; quotes checked against their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import identity as I
from tessella.operators.ordered import row_numbers


def resolve(references: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``resolution`` (resolved, ambiguous, unresolved), ``node_id`` and ``n_candidates``.

    ``references`` has keys, kind, alias, section (explicit, nullable) and default_section (nullable); ``inventory`` has
    keys, node_id, kind, alias, section, source_order. An explicit section is looked up alone. A default section is
    looked up first, then all sections if it has no match; without either all sections are looked up. Matches are
    counted and the first kept by aggregates, so a printed id that stands everywhere costs one row.
    """
    first = F.min(F.struct("source_order", "node_id"))["node_id"]
    scoped = inventory.groupBy(*keys, "kind", "alias", "section").agg(F.count("*").alias("n_scoped"), first.alias("scoped_node"))
    whole = inventory.groupBy(*keys, "kind", "alias").agg(F.count("*").alias("n_whole"), first.alias("whole_node"))
    looked = (
        references.withColumn("scope", F.coalesce("section", "default_section"))
        .join(scoped.withColumnRenamed("section", "scope"), [*keys, "kind", "alias", "scope"], "left")
        .join(whole, [*keys, "kind", "alias"], "left")
    )
    in_scope = F.col("section").isNotNull() | (F.col("default_section").isNotNull() & F.col("n_scoped").isNotNull())
    n = F.coalesce(F.when(in_scope, F.col("n_scoped")).otherwise(F.col("n_whole")), F.lit(0))
    node = F.when(in_scope, F.col("scoped_node")).otherwise(F.col("whole_node"))
    return (
        looked.withColumn("n_candidates", n)
        .withColumn("node_id", F.when(n == 1, node))
        .withColumn("resolution", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved"))
        .drop("scope", "n_scoped", "scoped_node", "n_whole", "whole_node")
    )


def resolve_conditions(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, is_resolved``: a condition counts only if each of its leaf references does."""
    return leaves.groupBy(*keys).agg(F.bool_and(F.col("resolution") == "resolved").alias("is_resolved"))


def node_ids(items: DataFrame, keys: list[str], kind: Column, section: Column, printed: Column, fallback: Column) -> DataFrame:
    """Adds ``node_id``: kind:section:alias, all members of a repeated id numbered; without a printed id a content hash.

    Repeats are counted by an aggregate and joined back, and numbered range by range, so one id that fills a third of all
    rows is no one task's. ``source_order`` is total within an id.
    """
    based = items.withColumn("base", F.when(printed.isNotNull() & (printed != ""), F.concat_ws(":", kind, section, printed)).otherwise(F.concat_ws(":", kind, F.lit("fallback"), fallback)))
    counts = based.groupBy(*keys, "base").agg(F.count("*").alias("n_same"))
    many = row_numbers(based.join(counts.filter("n_same > 1"), [*keys, "base"]), [*keys, "base"], ["source_order"], "number")
    many = many.withColumn("node_id", F.concat(F.col("base"), F.lit(":duplicate-"), F.col("number").cast("string"))).drop("number")
    alone = based.join(counts.filter("n_same = 1"), [*keys, "base"]).withColumn("node_id", F.col("base"))
    return alone.unionByName(many).drop("base", "n_same")


def printed_ambiguities(items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, section, kind, alias, n, first_order`` of printed ids that come more than once."""
    return items.groupBy(*keys, "section", "kind", "alias").agg(F.count("*").alias("n"), F.min("source_order").alias("first_order")).filter("n > 1")


def check_quotes(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``quote_fault`` (null if the quote stands in its block): missing_block, other_page, row_range or not_found.

    ``spans``: doc_id, block_id, page, row_start, row_end, quote; ``blocks``: doc_id, block_id, page, pages, text, table_rows.
    """
    own = blocks.select("doc_id", "block_id", F.col("page").alias("b_page"), "pages", F.col("text").alias("b_text"), "table_rows")
    joined = spans.join(own, ["doc_id", "block_id"], "left")
    rows = F.size("table_rows")
    ranged = F.col("row_start").isNotNull()
    outside = ranged & (F.col("table_rows").isNull() | (F.col("row_start") < 1) | (F.col("row_end") > rows) | (F.col("row_end") < F.col("row_start")))
    sliced = F.slice("table_rows", F.coalesce("row_start", F.lit(1)), F.greatest(F.coalesce(F.col("row_end") - F.col("row_start") + 1, F.lit(0)), F.lit(0)))
    lines = F.array_join(F.transform(F.when(ranged & ~outside, sliced).otherwise(F.col("table_rows")), lambda r: F.array_join(r, " | ", "")), "\n")
    source = I.quote_of(F.coalesce(F.when(ranged, lines), F.col("b_text"), lines, F.lit("")))
    known = F.coalesce("pages", F.array("b_page"))
    fault = (
        F.when(F.col("b_page").isNull() & F.col("b_text").isNull() & F.col("table_rows").isNull(), "missing_block")
        .when(F.col("page").isNotNull() & ~F.array_contains(known, F.col("page")), "other_page")
        .when(outside, "row_range")
        .when(~F.contains(source, I.quote_of(F.col("quote"))), "not_found")
    )
    return joined.withColumn("quote_fault", fault).drop("b_page", "pages", "b_text", "table_rows")


def unique_matches(lines: DataFrame, variables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line_id, variable_id`` where a line has one variable of its text and the variable one line.

    Both sides have ``keys`` and ``match`` (a normal form); ties on either side link nothing.
    """
    one_line = lines.groupBy(*keys, "match").agg(F.count("*").alias("n"), F.min("line_id").alias("line_id")).filter("n = 1").drop("n")
    one_variable = variables.groupBy(*keys, "match").agg(F.count("*").alias("n"), F.min("variable_id").alias("variable_id")).filter("n = 1").drop("n")
    return one_line.join(one_variable, [*keys, "match"]).select(*keys, "line_id", "variable_id")


def evidence_ids(evidence: DataFrame, canonical: Column, namespace: str, order: str) -> DataFrame:
    """Content ids; of observations that say the same the first stays."""
    told = evidence.withColumn("evidence_id", I.stable_id_of(namespace, canonical))
    first = told.groupBy("evidence_id").agg(F.min(order).alias(order))
    return told.join(first, ["evidence_id", order], "left_semi")


def linked_variables(items: DataFrame, variables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node_id, n_linked, first_index``: items and the variables of their name, which may be several.

    ``items``: keys, node_id, name; ``variables``: keys, index, name. A name that two items bear links neither, as a
    variable has one item.
    """
    one = items.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).filter("n = 1").drop("n")
    named = variables.groupBy(*keys, "name").agg(F.count("*").alias("n_linked"), F.min("index").alias("first_index"))
    return one.join(named, [*keys, "name"]).select(*keys, "node_id", "n_linked", "first_index")


def printed_text(text: Column) -> Column:
    """A printed label as it is compared: compatibility form, single blanks, case folded, without full stops and colons at its end."""
    return F.rtrim(F.regexp_replace(I.quote_of(text), r"[.:]+$", ""))


def line_matches(lines: DataFrame, variables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line_id, variable_id``: printed lines and the one variable each means, by its id, else by its label or question.

    ``lines``: keys, line_id, printed, text; ``variables``: keys, variable_id, name, label, question (the texts as
    ``printed_text`` gives them). A line that means several variables, and a variable that several lines mean, link nothing.
    """
    folded = F.lower(F.trim("printed"))
    names = variables.select(*keys, "variable_id", F.lower(F.trim("name")).alias("match"))
    by_id = lines.select(*keys, "line_id", folded.alias("match")).filter("match != ''").join(names, [*keys, "match"]).select(*keys, "line_id", "variable_id")
    texts = variables.select(*keys, "variable_id", F.explode(F.array("label", "question")).alias("match")).filter("match != ''").distinct()
    rest = lines.join(by_id.select(*keys, "line_id").distinct(), [*keys, "line_id"], "left_anti")
    by_text = rest.select(*keys, "line_id", F.col("text").alias("match")).join(texts, [*keys, "match"]).select(*keys, "line_id", "variable_id")
    meant = by_id.unionByName(by_text).distinct()
    lines_of = meant.groupBy(*keys, "line_id").agg(F.count("*").alias("n"), F.min("variable_id").alias("variable_id")).filter("n = 1").drop("n")
    claimed = meant.groupBy(*keys, "variable_id").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return lines_of.join(claimed, [*keys, "variable_id"]).select(*keys, "line_id", "variable_id")
