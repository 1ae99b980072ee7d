"""Filling fixed-capacity containers with texts measured in tokens.

Bounded-space online best-fit. Every partition keeps at most ``open_bins`` open containers a profile in a bitset keyed
by free space: bit f is set while some open container has f tokens free. A piece goes to the open container with the
least free space that still holds it (the lowest set bit at or above its size); if none does, a container is opened,
and when ``open_bins`` are open already, the fullest closes first. A text over the capacity is divided into full pieces,
each a container of its own, and a rest that is packed like any other; no other text is divided.

What a partition leaves open (at most ``open_bins`` a profile) is packed again, whole containers as items, in groups
of ``GROUP`` partitions, so half-empty containers don't remain at each partition's end. A task of that second round
gets at most GROUP * open_bins small rows, whatever the corpus.

Cases: null, empty and blank texts are measured like any other (0 tokens for null and empty; they get a container too);
equal texts and repeated rows are packed each; a profile without max_size or with max_size < 1 is left out; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tokenizer import VOCABULARY, encoder_of, ship_vocabulary
from tessella.runtime import cut_lineage, read_table, spread

OPEN_BINS = 256
GROUP = 64
MAX_PROFILES = 1000
ROWS_PER_BATCH = 20_000


class OpenBins:
    """Open containers of one capacity; ``put`` gives the container of a piece, ``left`` what is still open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def _keep(self, number: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.count += 1

    def whole(self) -> int:
        """A container that one piece fills."""
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> int:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.whole()
        self._keep(number, free - size)
        return number

    def left(self) -> dict[int, int]:
        """Number to filled tokens of the containers still open."""
        return {n: self.capacity - free for free, stack in self.by_free.items() for n in stack}


def _pack_partition(profiles: list[tuple[str, int]], count, limit: int):
    """The first round over one partition: a ledger of pieces, then one row for each container left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        measure = count()
        bins = [OpenBins(capacity, limit) for _, capacity in profiles]
        names = ["profile", "part", "bin", "key", "piece_no", "token_start", "n_tokens", "open"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = [pa.int32(), pa.int32(), pa.int64(), key_kind, pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        rows, key_kind = [], None
        for batch in batches:
            key_kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size = measure(text.as_py())
                for p, (_, capacity) in enumerate(profiles):
                    b = bins[p]
                    full, rest = divmod(size, capacity) if size > capacity else (0, size)
                    for n in range(full):
                        rows.append((p, part, b.whole(), key, n, n * capacity, capacity, False))
                    if rest or not full:
                        rows.append((p, part, b.put(rest), key, full, full * capacity, rest, False))
                if len(rows) >= ROWS_PER_BATCH:
                    yield out(rows)
                    rows = []
        rows += [(p, part, n, None, None, None, filled, True) for p, b in enumerate(bins) for n, filled in b.left().items()]
        if rows:
            yield out(rows)

    return run


def _pack_leftovers(capacities: dict[int, int]):
    """The second round over the open containers of a group of partitions: larger ones first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "part", "bin"], ascending=[False, True, True])
        bins = OpenBins(capacities[int(frame["profile"].iloc[0])], len(frame))
        target: dict[int, tuple[int, int]] = {}
        to = []
        for part, number, size in zip(frame["part"], frame["bin"], frame["n_tokens"]):
            to.append(target.setdefault(bins.put(int(size)), (part, number)))
        return pd.DataFrame({"profile": frame["profile"], "part": frame["part"], "bin": frame["bin"], "to_part": [a for a, _ in to], "to_bin": [b for _, b in to]})

    return run


def pack_texts(documents: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``profile_name, container_id, key, piece_no, token_start, n_tokens`` for every text and packing profile.

    ``profiles`` has profile_name and max_size; it is a fixed table, refused above MAX_PROFILES rows.
    """
    chosen = profiles.filter("max_size >= 1").select("profile_name", F.col("max_size").cast("long")).distinct().orderBy("profile_name", "max_size").limit(MAX_PROFILES + 1).collect()
    if len(chosen) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} packing profiles")
    plan = [(r[0], r[1]) for r in chosen]
    spark = documents.sparkSession
    vocabulary = ship_vocabulary(spark, path)
    kind = documents.schema[key].dataType.simpleString()
    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    ledger = source.mapInArrow(
        _pack_partition(plan, lambda: encoder_of(vocabulary.value).count, open_bins),
        f"profile int, part int, bin long, key {kind}, piece_no int, token_start long, n_tokens int, open boolean",
    )
    ledger = cut_lineage(ledger)
    moved = (
        ledger.filter("open")
        .select("profile", "part", "bin", "n_tokens", F.floor(F.col("part") / GROUP).alias("set"))
        .groupBy("profile", "set")
        .applyInPandas(_pack_leftovers({p: c for p, (_, c) in enumerate(plan)}), "profile int, part int, bin long, to_part int, to_bin long")
    )
    names = F.element_at(F.array(*[F.lit(n) for n, _ in plan]) if plan else F.array(F.lit(None).cast("string")), F.col("profile") + 1)
    return (
        ledger.filter("not open")
        .join(moved, ["profile", "part", "bin"], "left")
        .select(
            names.alias("profile_name"),
            F.concat_ws("-", F.coalesce("to_part", "part"), F.coalesce("to_bin", "bin")).alias("container_id"),
            F.col("key").alias(key),
            "piece_no",
            "token_start",
            "n_tokens",
        )
    )


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = read_table(spark, sf_dir, "size_limits").filter("used_for = 'packing' and size_unit = 'tokens'")
    return pack_texts(read_table(spark, sf_dir, "documents"), limits)


QUERIES = {"p7_containers": p7_containers}
SQL: dict[str, str] = {}
