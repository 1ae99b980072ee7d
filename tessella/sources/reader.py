"""Files to tables: a directory of documents as blocks, tables and faults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources.parsers import SourceFault, parse_document

BLOCKS = "doc_id string, source_name string, ord int, block_id string, kind string, text string, table_id string, table_rows array<array<string>>, section_path array<string>, sheet string, page int, fault string"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string()]
_NAMES = [f.split(" ")[0] for f in BLOCKS.split(", ")]


#: Fixed value: the code of a file that a parser stumbles over.
UNFORESEEN = "SOURCE_FORMAT_INVALID"


def rows_of(doc_id: str, name: str, content: bytes, registry: dict | None = None) -> Iterator[tuple]:
    """A document's block rows, or one row with its fault; what a parser doesn't foresee is a fault of the format."""
    try:
        blocks, code = parse_document(content, name, registry), None
    except SourceFault as fault:
        code = fault.code
    except Exception:
        code = UNFORESEEN
    if code is not None:
        yield (doc_id, name, None, None, None, None, None, None, None, None, None, code)
        return
    tables = 0
    for n, b in enumerate(blocks):
        tables += b["kind"] == "table"
        yield (doc_id, name, n, f"block-{n + 1:06d}", b["kind"], b["text"], f"table-{tables:06d}" if b["kind"] == "table" else None, b["rows"], b["section"], b["sheet"], b.get("page"), None)


def parse_files(files: DataFrame, registry: dict[str, Callable] | None = None) -> DataFrame:
    """Blocks of (doc_id, source_name, content); a file that can't be read gives a row with ``fault``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(rows_of(row["doc_id"], row["source_name"], row["content"] or b"", registry))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TYPES)], _NAMES)

    return files.select("doc_id", "source_name", "content").mapInArrow(run, BLOCKS)


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """Files below a directory with their digest: doc_id is the digest of name and content. Those above ``most_bytes`` are left to ``oversized_files``."""
    raw = _listed(spark, path, pattern)
    if most_bytes is not None:
        raw = raw.filter(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("source_name"), "content", F.sha2("content", 256).alias("snapshot_sha256"), F.col("length").alias("n_bytes")).withColumn("doc_id", F.sha2(F.concat_ws(":", "source_name", "snapshot_sha256"), 256))


def oversized_files(spark: SparkSession, path: str, most_bytes: int, pattern: str = "*") -> DataFrame:
    """A row of blocks with its fault for each file above ``most_bytes``, whose content isn't loaded: doc_id is the digest of path and length."""
    large = _listed(spark, path, pattern).select("path", "length").filter(F.col("length") > most_bytes)
    told = {"doc_id": F.sha2(F.concat_ws(":", "path", "length"), 256), "source_name": F.element_at(F.split("path", "/"), -1), "fault": F.lit("SOURCE_LIMIT_EXCEEDED")}
    return large.select(*(told.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (f.split(" ") for f in BLOCKS.split(", "))))


def bundle_digests(files: DataFrame) -> DataFrame:
    """``bundle_id, digest``: one digest of a primary file and its companions, from (bundle_id, path, is_primary, n_bytes, sha256).

    Each file is told by its path's length, path, size and own digest, so no two bundles read alike; the primary comes
    first, companions by path. A bundle is a form and the few files that it names.
    """
    record = F.concat(F.length("path").cast("string"), F.lit(":"), F.col("path"), F.lit(":"), F.col("n_bytes").cast("string"), F.lit(":"), F.col("sha256"))
    told = files.select("bundle_id", F.struct((~F.col("is_primary")).alias("later"), "path", record.alias("record")).alias("f"))
    return told.groupBy("bundle_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["record"]), "\n"), 256).alias("digest"))


def read_blocks(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return parse_files(read_files(spark, path, pattern))


#: Bytes of files that one task reads, about.
LOT = 32 * 1024 * 1024


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """Files in lots of about LOT bytes; the walk lists names and sizes only."""
        import os

        lots, size = [[]], 0
        for path in sorted(os.path.join(root, f) for root, _, files in os.walk(self.path) for f in files):
            own = os.path.getsize(path)
            if lots[-1] and size + own > LOT:
                lots.append([])
                size = 0
            lots[-1].append(path)
            size += own
        return [_Files(paths) for paths in lots]

    def read(self, partition):
        import hashlib
        import os

        for path in partition.paths:
            with open(path, "rb") as file:
                content = file.read()
            name = os.path.basename(path)
            doc_id = hashlib.sha256(f"{name}:{hashlib.sha256(content).hexdigest()}".encode()).hexdigest()
            yield from rows_of(doc_id, name, content)


class DocumentFolder(DataSource):
    """``spark.read.format("tessella_documents").load(path)`` over a shared folder: one task a lot of files."""

    @classmethod
    def name(cls):
        return "tessella_documents"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return _FolderReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFolder)
