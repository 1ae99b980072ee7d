"""Blocks of documents: paragraphs, sections, coverage and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessella.functions import text as T
from tessella.operators.ordered import ordered_fold


def block_id(ordinal: Column) -> Column:
    """block-000001 for the first."""
    return F.format_string("block-%06d", ordinal.cast("int"))


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ord, block_id, text``: paragraphs parted by blank lines, trimmed, empty ones dropped, numbered from 0."""
    parts = F.filter(F.transform(F.split(text, r"\r?\n[ \t\n\r\f\x0b]*\r?\n"), T.trim_blank), lambda p: p != "")
    return documents.select(key, F.posexplode(parts).alias("ord", "text")).select(key, "ord", block_id(F.col("ord") + 1).alias("block_id"), "text")


def sections(blocks: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """Adds ``section``: the last heading up to each block of its document (flat, as a new heading replaces the old)."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(upto))


def heading_paths(headings: DataFrame, key: str, order: str, level: str, text: str) -> DataFrame:
    """``key, order, path``: ancestors and self of nested headings; a heading closes those of its level and below."""
    schema = StructType([headings.schema[key], StructField("ord", IntegerType()), StructField("path", ArrayType(StringType()))])

    def step(stack, row):
        while stack and stack[-1][0] >= row[level]:
            stack.pop()
        stack.append((row[level], row[text]))
        return [(row[key], row[order], [t for _, t in stack])]

    return ordered_fold(headings.select(key, order, level, text), [key], [order], list, step, lambda stack, k: [], schema)


def number_blocks(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Empty blocks dropped, the rest renumbered from 0 in order, with ids."""
    w = Window.partitionBy(key).orderBy(order)
    return blocks.filter(F.length(T.trim_blank(F.col(text))) > 0).withColumn("ord", F.row_number().over(w) - 1).withColumn("block_id", block_id(F.col("ord") + 1))


def coverage_faults(coverage: DataFrame) -> DataFrame:
    """``doc_id, fault`` of coverage rows whose converted and failed units aren't a partition of 1..total."""
    converted, failed = F.coalesce("converted_units", F.array()), F.coalesce("failed_units", F.array())
    all_units = F.when(F.col("total_units") >= 1, F.sequence(F.lit(1), F.col("total_units"))).otherwise(F.array().cast("array<int>"))
    both = F.concat(converted, failed)
    faults = F.array_compact(
        F.array(
            F.when(~F.col("unit_kind").isin("document", "page", "sheet"), F.lit("unit_kind")),
            F.when(F.coalesce("total_units", F.lit(0)) < 1, F.lit("total_units")),
            F.when(F.size(F.array_intersect(converted, failed)) > 0, F.lit("overlap")),
            F.when(F.size(F.array_distinct(both)) != F.size(both), F.lit("repeated")),
            F.when(F.size(F.array_except(all_units, both)) > 0, F.lit("missing")),
            F.when(F.size(F.array_except(both, all_units)) > 0, F.lit("outside")),
        )
    )
    return coverage.select("doc_id", F.explode(faults).alias("fault"))


def failed_units(coverage: DataFrame) -> DataFrame:
    """``doc_id, unit_index, message``: one row for each unit that wasn't converted."""
    return coverage.select("doc_id", "unit_kind", F.explode("failed_units").alias("unit_index")).select(
        "doc_id", "unit_index", F.format_string("%s %d could not be converted", F.col("unit_kind"), F.col("unit_index")).alias("message")
    )


def provenance_faults(blocks: DataFrame) -> DataFrame:
    """``block_key, fault`` of blocks whose pages aren't sorted, unique and begun by page, or whose parts of a path are empty."""
    pages = F.col("pages")
    faults = F.array_compact(
        F.array(
            F.when(pages.isNotNull() & (F.size(pages) > 0) & ~F.equal_null(F.element_at(pages, 1), F.col("page")), F.lit("page")),
            F.when(pages.isNotNull() & (F.sort_array(F.array_distinct(pages)) != pages), F.lit("pages")),
            F.when(F.exists("section_path", lambda p: F.length(T.trim_blank(p)) == 0), F.lit("section_path")),
            F.when(F.exists(pages, lambda p: p < 1), F.lit("range")),
            F.when(F.col("table_rows").isNull() & (F.length(F.coalesce("text", F.lit(""))) == 0), F.lit("empty")),
        )
    )
    return blocks.select("block_key", F.explode(faults).alias("fault"))
