"""The quality policy of extracted records: exclusion, overlap duplicates, review reasons, similar questions, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X
from tessella.operators.ordered import ordered_fold
from tessella.runtime import cut_lineage

CONFIDENCE = 0.70
SIMILARITY = 0.8
#: Words whose frequency tasks are told, at most, and their characters.
MOST_KNOWN, LONGEST_KNOWN = 50_000, 64
#: Ids of dropped records that are sent to all tasks, at most; more are joined by shuffle.
MOST_SENT = 100_000
REASONS = ("model_flagged", "low_confidence", "missing_categories", "duplicate_raw_name", "possible_duplicate")


def range_is_inverted(numeric_range: Column) -> Column:
    return F.coalesce(numeric_range["min_value"] > numeric_range["max_value"], F.lit(False))


def record_signature() -> Column:
    return X.signature(F.coalesce("raw_name", F.lit("")), F.col("question_text"), F.col("label"), F.col("data_type"))


def overlap_duplicates(records: DataFrame) -> DataFrame:
    """``record_id`` of records that repeat a kept, earlier record of equal signature from a block they overlap with.

    Dropped records shield nothing, so each (survey, signature) is folded in order; only signatures that come twice and
    whose records name overlap blocks at all are folded, and the state is the kept blocks' ids. The groups are joined by
    shuffle: what Spark takes their size for, a share of a compressed file's, says nothing about how many there are.
    """
    keyed = records.select("survey_id", F.md5(F.to_json(record_signature())).alias("sig"), "source_order", "record_id", "source_block_ids", "overlap_block_ids")
    twice = keyed.groupBy("survey_id", "sig").agg(F.count("*").alias("n"), F.max(F.size(F.coalesce("overlap_block_ids", F.array()))).alias("lap")).filter("n > 1 and lap > 0").select("survey_id", "sig")
    schema = T.StructType([T.StructField("record_id", T.LongType())])

    def step(kept: set, row):
        if kept.intersection(row["overlap_block_ids"] or ()):
            return [(row["record_id"],)]
        kept.update(row["source_block_ids"] or ())
        return []

    return ordered_fold(keyed.join(twice.hint("merge"), ["survey_id", "sig"], "left_semi"), ["survey_id", "sig"], ["source_order", "record_id"], set, step, lambda kept, key: [], schema)


def dropped_records(sound: DataFrame) -> DataFrame:
    """``record_id`` of overlap duplicates, each once, written and counted: sent to all tasks only if they are few."""
    dropped = cut_lineage(overlap_duplicates(sound).distinct())
    return dropped.hint("broadcast" if dropped.count() <= MOST_SENT else "merge")


def token_sets(records: DataFrame) -> DataFrame:
    """``survey_id, record_id, tokens``: the distinct words compared, sorted and joined by blanks; records without any left out."""
    tokens = F.sort_array(F.array_distinct(F.split(X.similarity_text(X.first_filled(F.col("question_text"), F.col("label"))), " ")))
    return records.select("survey_id", "record_id", F.array_join(tokens, " ").alias("tokens")).filter("tokens != ''")


def token_classes(records: DataFrame) -> DataFrame:
    """``survey_id, tokens, rep``: the smallest record id of each token set of a named survey, written once."""
    return cut_lineage(token_sets(records.filter("survey_id is not null")).groupBy("survey_id", "tokens").agg(F.min("record_id").alias("rep")))


def frequent_words(classes: DataFrame) -> dict[str, int]:
    """Words that make up at least one in MOST_KNOWN of all words, which are MOST_KNOWN at most, and how often they come.

    Only the order of words hangs on them, so a word that is left out for its length costs time, not pairs.
    """
    words = classes.select(F.explode(F.split("tokens", " ")).alias("word"))
    total = classes.agg(F.sum(F.size(F.split("tokens", " ")))).first()[0] or 0
    counted = words.groupBy("word").agg(F.count("*").alias("f")).filter((F.col("f") * MOST_KNOWN >= total) & (F.length("word") <= LONGEST_KNOWN))
    return {r["word"]: r["f"] for r in counted.collect()}


def word_map(words: list[str]) -> int:
    """A map of 128 bits with a bit for each word; two words may have one bit, so maps differ in as many bits as sets in words at most."""
    bits = 0
    for w in words:
        bits |= 1 << (crc32(w.encode()) & 127)
    return bits


def rare_first(words: list[str], known: dict[str, int], least: float) -> list[str]:
    """The words, rarest first, of which sets with a similarity of ``least`` can't miss all."""
    ranked = sorted(words, key=lambda w: (known.get(w, 0), w))
    return ranked[: len(words) - math.ceil(len(words) * least - 1e-9) + 1]


def _word_prefixes(known, least: float):
    halves = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split(" ") for t in batch.column(2).to_pylist()]
            maps = [word_map(w) for w in words]
            bits = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([m & halves for m in maps], [m >> 64 for m in maps])]
            sizes = pa.array([len(w) for w in words], pa.int32())
            prefixes = pa.array([rare_first(w, known.value, least) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, *bits, prefixes], ["survey_id", "rep", "n", "bits", "more_bits", "words"])

    return run


def similar_questions(records: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of unequal token sets of a survey with a Jaccard similarity of ``least`` or more: ``survey_id, a, b, similarity``.

    a and b are the smallest record ids of their sets; equal sets are one class, so copies aren't paired. Candidates share
    one of the rarest words of both (prefix filter): sets of n words with similarity t share at least ceil(t*n) words, so
    the first n - ceil(t*n) + 1 words in any one order of all words can't all be missing from the other. Frequent words come
    last; how frequent is told to the tasks, so no word is joined with its frequency. The key has the band of sizes besides
    the word, as sets of too unlike sizes can't be similar; a pair goes on only from words that leave enough of both, and
    if the maps of its words differ in no more bits than the sets may in words, so few pairs but the similar ones are
    written anywhere. Keys are hashes: one that two words share costs a candidate. The sets themselves decide.
    """
    return similar_classes(token_classes(records), least)


def similar_classes(classes: DataFrame, least: float) -> DataFrame:
    """The pairs of ``similar_questions`` from the token sets of ``token_classes``."""
    known = classes.sparkSession.sparkContext.broadcast(frequent_words(classes))
    ranked = classes.select("survey_id", "rep", "tokens").mapInArrow(_word_prefixes(known, least), "survey_id string, rep long, n int, bits long, more_bits long, words array<string>")
    band = F.floor(F.log(F.col("n")) / math.log(1 / least) + 1e-9).cast("int")
    prefix = ranked.select("survey_id", "rep", "n", "bits", "more_bits", band.alias("band"), F.posexplode("words").alias("at", "word"))
    prefix = prefix.select(F.xxhash64("survey_id", "word").alias("word"), "band", "rep", "n", "at", "bits", "more_bits")
    # The larger set meets those of its own band and of the one below.
    larger = prefix.select("word", F.col("rep").alias("y"), F.col("n").alias("m"), F.col("at").alias("at_y"), F.col("bits").alias("bits_y"), F.col("more_bits").alias("more_bits_y"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("rep") < F.col("y")))
    left_over = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at_y"))
    unlike = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_y"))) + F.bit_count(F.col("more_bits").bitwiseXOR(F.col("more_bits_y")))
    of_both = F.col("n") + F.col("m")
    close = smaller & (F.col("n") >= least * F.col("m") - 1e-9) & (left_over >= least / (1 + least) * of_both - 1e-9) & (unlike <= (1 - least) / (1 + least) * of_both + 1e-9)
    met = prefix.join(larger.hint("merge"), ["word", "band"]).filter(close)
    candidates = cut_lineage(met.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")).distinct())
    # How large these are can't be told beforehand, so none is sent to all tasks.
    ends = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    asked = cut_lineage(classes.join(ends.hint("merge"), "rep", "left_semi").select("survey_id", "rep", F.split("tokens", " ").alias("words")))
    left = asked.select("survey_id", F.col("rep").alias("a"), F.col("words").alias("x"))
    right = asked.select(F.col("survey_id").alias("survey_y"), F.col("rep").alias("b"), F.col("words").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    scored = candidates.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("survey_id = survey_y").select("survey_id", "a", "b", both.alias("common"), (F.size("x") + F.size("y") - both).alias("either"))
    return scored.filter(F.col("common") / F.col("either") >= least).select("survey_id", "a", "b", "common", "either")


def similar_records(records: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``record_id`` of every record, copies included, whose token set is similar to another."""
    classes = token_classes(records)
    pairs = cut_lineage(similar_classes(classes, least))
    linked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    alike = classes.join(linked.hint("merge"), "rep", "left_semi").select("survey_id", "tokens")
    return token_sets(records).join(alike.hint("merge"), ["survey_id", "tokens"], "left_semi").select("record_id")


def repeated_names(records: DataFrame) -> DataFrame:
    """``survey_id, name, n, first_order`` of names that a survey gives to two or more records."""
    named = records.filter("raw_name is not null").withColumn("name", F.lower("raw_name"))
    return named.groupBy("survey_id", "name").agg(F.count("*").alias("n"), F.min("source_order").alias("first_order")).filter("n > 1")


def source_module() -> Column:
    """The innermost section, else the sheet; null where a source has neither."""
    path = F.col("prov.section_path")
    return F.nullif(F.coalesce(F.when(F.size(path) > 0, F.element_at(path, -1)), F.col("prov.sheet")), F.lit(""))


def record_flags(records: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Adds what a record shows by itself: is_inverted, low_confidence, missing_categories and the reconciled module."""
    categorical = F.col("data_type").isin("categorical_single", "categorical_multi")
    module = source_module()
    return (
        records.withColumn("is_inverted", range_is_inverted(F.col("numeric_range")))
        .withColumn("low_confidence", F.coalesce(F.col("extraction_confidence") < threshold, F.lit(False)))
        .withColumn("missing_categories", categorical & (F.coalesce(F.size("categories"), F.lit(0)) <= 0))
        .withColumn("module_replaced", module.isNotNull() & ~F.equal_null(module, F.col("module")))
        .withColumn("final_module", F.coalesce(module, F.col("module")))
    )


def apply_policy(records: DataFrame, threshold: float = CONFIDENCE, similarity: float = SIMILARITY) -> DataFrame:
    """``survey_id, record_id, source_order, status, needs_review, reasons, module``: status is kept, excluded (an inverted
    range) or duplicate; reasons stand in the policy's order."""
    flagged = record_flags(records, threshold)
    sound = flagged.filter("not is_inverted")
    dropped = dropped_records(sound)
    kept = sound.join(dropped, "record_id", "left_anti")
    names = repeated_names(kept).select("survey_id", "name", F.lit(True).alias("name_repeats"))
    similar = similar_records(kept, similarity).distinct().withColumn("is_similar", F.lit(True))
    # Names and similar records may be as many as records, whatever Spark takes their size for.
    marked = flagged.withColumn("name", F.lower("raw_name")).join(dropped.withColumn("dropped", F.lit(True)), "record_id", "left").join(similar.hint("merge"), "record_id", "left")
    out = marked.join(names.hint("merge"), ["survey_id", "name"], "left")
    status = F.when(F.col("is_inverted"), F.lit("excluded")).when(F.col("dropped"), F.lit("duplicate")).otherwise(F.lit("kept"))
    flags = (F.col("needs_review"), F.col("low_confidence"), F.col("missing_categories"), F.col("name_repeats"), F.col("is_similar"))
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(f, F.lit(False)), F.lit(r)) for f, r in zip(flags, REASONS))))
    return out.withColumn("status", status).withColumn("reasons", F.when(status == "kept", F.array_join(reasons, ",")).otherwise("")).select(
        "survey_id", "record_id", "source_order", "status", (F.col("reasons") != "").alias("needs_review"), "reasons", F.when(F.col("status") == "kept", F.col("final_module")).otherwise(F.col("module")).alias("module")
    )


def policy_diagnostics(records: DataFrame, threshold: float = CONFIDENCE, similarity: float = SIMILARITY) -> DataFrame:
    """``survey_id, phase, position, seq, code, subject``: records' own findings first, then names, then pairs."""
    flagged = record_flags(records, threshold)
    sound = flagged.filter("not is_inverted")
    dropped = dropped_records(sound)
    kept = sound.join(dropped, "record_id", "left_anti")
    marked = flagged.join(dropped.withColumn("dropped", F.lit(True)), "record_id", "left")
    is_dropped = ~F.col("is_inverted") & F.col("dropped").isNotNull()
    is_kept = ~F.col("is_inverted") & F.col("dropped").isNull()
    found = [
        (F.col("is_inverted"), "validation_failed"),
        (is_dropped, "overlap_deduped"),
        (is_kept & F.col("low_confidence"), "low_confidence"),
        (is_kept & F.col("missing_categories"), "missing_categories"),
        (is_kept & F.col("module_replaced"), "module_reconciled"),
    ]
    codes = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(seq).alias("seq"), F.lit(code).alias("code"))) for seq, (holds, code) in enumerate(found))))
    own = marked.select("survey_id", F.lit(1).alias("phase"), "source_order", F.col("record_id").cast("string").alias("subject"), F.explode(codes).alias("own"))
    out = own.select("survey_id", "phase", "source_order", "own.seq", "own.code", "subject")
    names = repeated_names(kept).select("survey_id", F.lit(2).alias("phase"), F.col("first_order").alias("source_order"), F.lit(5).alias("seq"), F.lit("duplicate_raw_name").alias("code"), F.col("name").alias("subject"))
    pairs = similar_questions(kept, similarity).select("survey_id", F.lit(3).alias("phase"), F.col("a").cast("int").alias("source_order"), F.lit(6).alias("seq"), F.lit("possible_duplicate").alias("code"), F.concat_ws(":", "a", "b").alias("subject"))
    return out.unionByName(names).unionByName(pairs).withColumnRenamed("source_order", "position")
