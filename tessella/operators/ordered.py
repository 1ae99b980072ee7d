"""Ordered folds: operators whose next row depends on what was done with the rows before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.runtime import cut_lineage, shuffle_partitions

ROWS_PER_BATCH = 5_000


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], finish: Callable[[Any, tuple], list[tuple]], schema: StructType
) -> DataFrame:
    """Folds each key's rows in ``order``; ``step`` and ``finish`` give output rows, as tuples of ``schema``.

    Rows are partitioned by key and sorted there, then streamed through the fold: a key of any size needs the memory of
    its state and of one batch, and nothing is collected. Ties in ``order`` are as the sort leaves them, so ``order``
    should be total. Null keys are a key of their own.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, state = None, None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    if key is not None:
                        out += finish(state, key)
                    key, state = own, start()
                out += step(state, row)
                if len(out) >= ROWS_PER_BATCH:
                    yield batch_of(out)
                    out = []
        if key is not None:
            out += finish(state, key)
        if out:
            yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: each row's number, from 1, among those of its ``by`` in ``order``, which should be total.

    Rows are sorted by ranges of (by, order), so rows of one hot key lie in many ranges, each numbered by itself; what the
    ranges before hold of the key is added. The ranges are cut in the shared folder, as they must not be drawn again.
    """
    ranged = cut_lineage(df.repartitionByRange(shuffle_partitions(df.sparkSession), *by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    same = [F.equal_null(F.col(b), F.col(f"_{b}")) for b in by]
    numbered = ranged.withColumn("_own", own).join(offsets, [F.col("_range") == F.col("_at"), *same])
    return numbered.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_at", "_before", *(f"_{b}" for b in by))
