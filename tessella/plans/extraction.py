"""From documents to surveys: blocks, chunks, model calls, quality policy, results. One job over a whole corpus."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import Config
from tessella.functions import text as T
from tessella.functions.prompts import EXTRACT, METADATA
from tessella.operators import chunking, evaluate, provider, quality
from tessella.runtime import cut_lineage
from tessella.sources.reader import oversized_files, parse_files, read_files

PAYLOAD = (
    "chunk_id string, variables array<struct<raw_name string, label string, question_text string, data_type string, module string, "
    "categories array<struct<code struct<t string, s string>, label string, is_missing boolean>>, numeric_range struct<min_value double, max_value double, notes string>, "
    "extraction_confidence double, needs_review boolean, source_block_ids array<string>>>"
)
SURVEY = "survey_id string, country_code string, year int, survey_name string, study_type string, data_collection_mode string, language string"


def document_chunks(blocks: DataFrame, config: Config) -> DataFrame:
    """Chunks whose rendered requests, with the prompt and the document's inventory, are within the request's limit."""
    empty = F.lit("")
    prompts = [EXTRACT.render(chunk_id=empty, inventory=F.coalesce("inventory", F.lit("[]")), text=empty), METADATA.render(chunk_id=empty, text=empty)]
    beside = F.greatest(*map(F.octet_length, prompts)) + provider.OVERHEAD
    read = blocks.filter("fault is null").join(row_inventory(blocks), "doc_id", "left").withColumn("beside", beside)
    return chunking.chunk_blocks(read, config.request_tokens, config.overlap_tokens, "beside")


def row_inventory(blocks: DataFrame) -> DataFrame:
    """``doc_id, inventory``: what repeats in a document's tables, as JSON or its digest."""
    rows = blocks.filter("kind = 'table'").select("doc_id", "ord", F.posexplode("table_rows").alias("row_no", "cells")).withColumn("line", T.render_row(F.col("cells")))
    summary = chunking.repeated_summary(chunking.repeated_rows(rows, "doc_id", ["ord", "row_no"], "line"), "doc_id")
    return summary.select("doc_id", F.coalesce("inventory", "digest").alias("inventory"))


def extract_records(chunks: DataFrame, blocks: DataFrame, make_provider: Callable, config: Config) -> tuple[DataFrame, DataFrame]:
    """``(records, calls)``: variables in order of chunk and place, and one row a chunk with how its call went.

    An answer must name its chunk and cite only its blocks, else the whole chunk fails.
    """
    asked = chunks.filter("error is null").join(row_inventory(blocks), "doc_id", "left")
    message = EXTRACT.render(chunk_id=F.col("chunk_id"), inventory=F.coalesce("inventory", F.lit("[]")), text=F.col("text"))
    requests = asked.withColumn("message", message).withColumn("request_sha", provider.request_digest(F.lit(EXTRACT.digest), F.col("message")))
    retry = provider.Retry(config.transport_tries, config.invalid_tries)
    told = provider.map_fitting(requests, make_provider, config.request_tokens, retry=retry, most_calls=config.concurrency).withColumn("answer", F.from_json("payload", PAYLOAD))
    cited = F.array_distinct(F.flatten(F.transform("answer.variables", lambda v: F.coalesce(v["source_block_ids"], F.array().cast("array<string>")))))
    sound = F.col("ok") & (F.col("answer.chunk_id") == F.col("chunk_id")) & (F.size(F.array_except(cited, "block_ids")) == 0)
    calls = cut_lineage(told.withColumn("reason", F.when(F.coalesce(sound, F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce("reason", F.lit(provider.INVALID)))))
    found = calls.filter("reason is null").select("doc_id", "chunk_ord", "overlap_block_ids", "block_ids", F.posexplode("answer.variables").alias("place", "v"))
    records = found.select(
        F.col("doc_id").alias("survey_id"), F.xxhash64("doc_id", "chunk_ord", "place").alias("record_id"), (F.col("chunk_ord") * 10_000 + F.col("place")).alias("source_order"), F.element_at("block_ids", 1).alias("block_id"),
        "overlap_block_ids", F.lit(None).cast("struct<page int, sheet string, section_path array<string>>").alias("prov"), "v.*",
    )
    return records, calls.select("doc_id", "chunk_ord", "chunk_id", F.col("reason").isNull().alias("ok"), "reason", "tries", "input_tokens", "output_tokens")


def survey_metadata(chunks: DataFrame, blocks: DataFrame, make_provider: Callable, config: Config, extraction_date: datetime.date) -> tuple[DataFrame, DataFrame]:
    """``(metadata, calls)``: one row a document that was read, and one row a chunk with how its call went.

    The first chunk with a sound answer decides; ``is_incomplete`` where a call failed or another answer differs. Without
    any sound answer the row is made of the file's name and the date, and ``is_fallback``.
    """
    asked = chunks.filter("error is null").withColumn("message", METADATA.render(chunk_id=F.col("chunk_id"), text=F.col("text")))
    requests = asked.withColumn("request_sha", provider.request_digest(F.lit(METADATA.digest), F.col("message")))
    retry = provider.Retry(config.transport_tries, config.invalid_tries)
    told = provider.map_fitting(requests, make_provider, config.request_tokens, retry=retry, most_calls=config.concurrency).withColumn("answer", F.from_json("payload", SURVEY))
    named = [F.length(F.trim(F.col("answer")[c])) > 0 for c in ("survey_id", "country_code", "survey_name")]
    sound = F.coalesce(F.col("ok") & named[0] & named[1] & named[2] & F.col("answer.year").between(1000, 9999), F.lit(False))
    calls = cut_lineage(told.withColumn("answer", F.when(sound, F.col("answer"))).withColumn("reason", F.when(~sound, F.coalesce("reason", F.lit(provider.INVALID)))))
    stem = F.regexp_replace("source_name", r"(?<=.)\.[^.]*$", "")
    name = F.initcap(F.trim(F.regexp_replace(stem, "[_-]+", " ")))
    year = F.lit(extraction_date.year)
    fallback = F.struct(F.lit(f"UNK_{extraction_date.year}_SURVEY").alias("survey_id"), F.lit("UNK").alias("country_code"), year.alias("year"), F.when(name == "", "Survey").otherwise(F.coalesce(name, F.lit("Survey"))).alias("survey_name"), *(F.lit(None).cast("string").alias(c) for c in ("study_type", "data_collection_mode", "language")))
    won = evaluate.first_success(calls, "doc_id", "chunk_ord", "answer")
    read = blocks.filter("fault is null").groupBy("doc_id").agg(F.min("source_name").alias("source_name"))
    told = read.join(won, "doc_id", "left").withColumn("is_fallback", F.col("answer").isNull()).withColumn("answer", F.coalesce("answer", fallback))
    metadata = told.select("doc_id", "answer.*", (F.col("is_fallback") | F.coalesce("is_incomplete", F.lit(True))).alias("is_incomplete"), "is_fallback")
    return metadata, calls.select("doc_id", "chunk_ord", "chunk_id", F.col("reason").isNull().alias("ok"), "reason", "tries", "input_tokens", "output_tokens")


def with_provenance(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records with the place of the first block they cite: its page, sheet and section; ``source_page`` counts from 0."""
    place = blocks.select(F.col("doc_id").alias("survey_id"), F.col("block_id").alias("first_block"), "page", "sheet", "section_path")
    first = F.element_at(F.when(F.size("source_block_ids") > 0, F.col("source_block_ids")), 1)
    told = records.withColumn("first_block", first).join(place, ["survey_id", "first_block"], "left")
    return told.withColumn("prov", F.struct("page", "sheet", "section_path")).withColumn("source_page", F.col("page") - 1).drop("first_block", "page", "sheet", "section_path")


def convert_blocks(blocks: DataFrame, make_provider: Callable, config: Config = Config(), extraction_date: datetime.date | None = None) -> dict[str, DataFrame]:
    """variables, metadata, diagnostics, calls, metadata_calls and results (one row a document, also where its source failed)."""
    chunks = cut_lineage(document_chunks(blocks, config))
    metadata, metadata_calls = survey_metadata(chunks, blocks, make_provider, config, extraction_date or datetime.date.today())
    records, calls = extract_records(chunks, blocks, make_provider, config)
    records = cut_lineage(with_provenance(records, blocks))
    policy = quality.apply_policy(records, config.confidence_threshold, config.similarity_threshold)
    variables = records.join(policy.filter("status = 'kept'").select("record_id", "reasons", F.col("needs_review").alias("review"), F.col("module").alias("final_module")), "record_id").drop("needs_review", "module").withColumnsRenamed({"review": "needs_review", "final_module": "module"})
    diagnostics = quality.policy_diagnostics(records, config.confidence_threshold, config.similarity_threshold)
    parts = [
        blocks.groupBy("doc_id").agg(F.bool_and(F.col("fault").isNull()).alias("has_output"), F.count("fault").alias("n_failed")).select("doc_id", "has_output", "n_failed", F.lit(0).alias("n_errors"), F.lit(0).alias("n_partial_codes")),
        calls.select("doc_id", F.lit(False).alias("has_output"), (~F.col("ok")).cast("int").alias("n_failed"), F.lit(0).alias("n_errors"), F.lit(0).alias("n_partial_codes")),
        chunks.filter("error is not null").select("doc_id", F.lit(False).alias("has_output"), F.lit(1).alias("n_failed"), F.lit(0).alias("n_errors"), F.lit(0).alias("n_partial_codes")),
        policy.filter("status = 'excluded'").select(F.col("survey_id").alias("doc_id"), F.lit(False).alias("has_output"), F.lit(1).alias("n_failed"), F.lit(1).alias("n_errors"), F.lit(0).alias("n_partial_codes")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return {"variables": variables, "metadata": metadata, "diagnostics": diagnostics, "calls": calls, "metadata_calls": metadata_calls, "results": evaluate.result_status(rows, "doc_id")}


def convert_folder(spark: SparkSession, path: str, make_provider: Callable, config: Config = Config()) -> dict[str, DataFrame]:
    """As ``convert_blocks``; a file above the configured size is a document whose source failed."""
    blocks = parse_files(read_files(spark, path, most_bytes=config.most_source_bytes)).unionByName(oversized_files(spark, path, config.most_source_bytes))
    return convert_blocks(cut_lineage(blocks), make_provider, config)
