"""Encoding of a corpus with a public byte-level BPE vocabulary.

Words are cut by the vocabulary's pattern and merged with a contiguous rank array: the boundaries of a word's parts
and the ranks of adjacent parts stand in two plain arrays; the lowest rank is searched by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed. Words are short, so the scan beats a heap; words over
``LONG_WORD`` bytes (unbroken runs) are merged in the same order with a heap, as the scan would be quadratic.

Cases: a null text has the ids of an empty text, an empty list; strings of special tokens are ordinary text; equal
texts have equal ids; every row gives one row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import read_table, spread

#: Place of the vocabulary and the pattern that cuts a text into words before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

LONG_WORD = 96
CACHED_WORDS = 200_000
LONG_TEXT = 1_000_000
IDS_PER_BATCH = 1_000_000
NO_RANK = 1 << 60


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by repeated scans of its rank array."""
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while adjacent:
        lowest = min(adjacent)
        if lowest == NO_RANK:
            break
        i = adjacent.index(lowest)
        del adjacent[i], bounds[i + 1]
        if i < len(adjacent):
            adjacent[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NO_RANK)
        if i:
            adjacent[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges in the same order, found by a heap over linked parts."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Word to ids (or to their number), filled on first use, emptied when it holds CACHED_WORDS."""

    def __init__(self, ranks: dict[bytes, int], counts: bool):
        super().__init__()
        self.ranks, self.counts = ranks, counts

    def __missing__(self, word: str):
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = (whole,)
        else:
            ids = tuple((merge_scan if len(raw) <= LONG_WORD else merge_heap)(raw, self.ranks))
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(raw) <= LONG_WORD:
            self[word] = len(ids) if self.counts else ids
        return len(ids) if self.counts else ids


class Encoder:
    """A vocabulary of ranks, given as the bytes of its file."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.ids, self.counts = _Words(self.ranks, False), _Words(self.ranks, True)
        self.any, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)

    def words(self, text: str):
        pattern = self.ascii if text.isascii() else self.any
        if len(text) <= LONG_TEXT:
            return pattern.findall(text)
        return (m.group() for m in pattern.finditer(text))

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.ids.__getitem__, self.words(text or ""))), np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.words(text or "")))


_loaded: dict[int, Encoder] = {}


def encoder_of(vocabulary: bytes) -> Encoder:
    """The worker's encoder, built once a process."""
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded[key] = Encoder(vocabulary)
    return _loaded[key]


def ship_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast the vocabulary file: its size is fixed (under 1 MB), whatever the corpus."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) for every row; no shuffle, one pass over the text column."""
    vocabulary = ship_vocabulary(documents.sparkSession, path)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocabulary.value).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, parts, size = 0, [], 0
            for i in range(len(texts)):
                parts.append(encode(texts[i].as_py()))
                size += len(parts[-1])
                if size >= IDS_PER_BATCH or i == len(texts) - 1:
                    offsets = np.zeros(len(parts) + 1, np.int32)
                    np.cumsum([len(p) for p in parts], out=offsets[1:])
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(parts)), ids], ["key", "ids"])
                    start, parts, size = i + 1, [], 0

    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return source.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
