"""Batch plans over a landing folder that grows: each micro-batch runs the same plan, decisions supersede by a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.sources.reader import parse_files


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Documents that land in a folder, as blocks."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return parse_files(raw.select(F.sha2(F.concat_ws(":", name, F.sha2("content", 256)), 256).alias("doc_id"), name.alias("source_name"), "content"))


def run_plan(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger_now: bool = True) -> StreamingQuery:
    """Runs a batch plan on each micro-batch and writes it under its batch number, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_now else writer).start()


def late_counts(events: DataFrame, time: str, late: str, window: str, by: list[str]) -> DataFrame:
    """Counts in windows of event time, closed by a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
