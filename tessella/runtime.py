"""Session-level helpers shared by every operator: reading, spreading, cutting lineage."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Task slots of the session."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Give a scan enough partitions for a CPU-heavy Python stage.

    A large input already has more splits than slots and passes through without a shuffle; only an input of
    fewer than ``least`` splits a slot (a single small file) is redistributed, by round robin, so no key is hot.
    """
    slots = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= least * slots else df.repartition(2 * slots)


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder that a session's checkpoints go to."""
    if named:
        return named
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tessella-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder of the cluster.

    The folder is that of ``spark.checkpoint.dir``. Where the session names none, a folder of this machine is taken on a
    local master (unit tests); on a cluster that is an error, as executors don't share the driver's folders. A lost
    executor costs nothing, as the files are shared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), context.master))
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of DataFrames that nothing holds any more are deleted now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` by name, so operators read alike."""
    return df.mapInArrow(function, schema)
