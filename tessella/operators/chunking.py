"""Chunks under a budget: splitting blocks, greedy packing, overlap, and inventories of what repeats."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X
from tessella.operators.ordered import ordered_fold

SEPARATOR = 2


class Unsplittable(ValueError):
    """A character or cell alone exceeds the budget."""


def size_of(text: str) -> int:
    return len(text.encode())


def split_text(text: str, budget: int) -> list[str]:
    """Pieces of at most ``budget`` bytes, cut after the last blank that fits, else between characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sums = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    blanks = [i + 1 for i, c in enumerate(text) if c in " \n\t"]
    out, at = [], 0
    while at < len(text):
        end = int(np.searchsorted(sums, sums[at] + budget, "right")) - 1
        if end < len(text):
            if end == at:
                raise Unsplittable("a character exceeds the budget")
            last = bisect_right(blanks, end) - 1
            if last >= 0 and blanks[last] > at:
                end = blanks[last]
        out.append(text[at:end])
        at = end
    return out


def _rendered(rows) -> str:
    escape = lambda c: (c or "").replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n").replace("|", "\\|")
    return "\n".join(" | ".join(map(escape, r)) for r in rows)


def _row_groups(header, rows, first: int, most: int, shared: int):
    """(rows with header, first row, last row): groups within ``shared``; a row by itself may take ``most``."""
    group, start = [], first
    for number, row in enumerate(rows, first):
        if group and size_of(_rendered([header, *group, row])) > shared:
            yield [header, *group], start, number - 1
            group, start = [], number
        if not group and size_of(_rendered([header, row])) > most:
            raise Unsplittable("a row exceeds the budget")
        group.append(row)
    if group:
        yield [header, *group], start, first + len(rows) - 1


def split_table(rows: list[list[str]], most: int, shared: int) -> list[dict]:
    """Parts of a table under the budget, each with the header: row groups, or column bands where a row is too wide."""
    width = max(map(len, rows), default=0)
    padded = [list(r) + [""] * (width - len(r)) for r in rows]
    header, body = padded[0], padded[1:]
    fits = lambda columns: all(size_of(_rendered([[header[c] for c in columns], [r[c] for c in columns]])) <= most for r in body or [[""] * width])
    bands, band = [], []
    for column in range(width):
        if band and not fits([*band, column]):
            bands.append(band)
            band = []
        band.append(column)
    bands.append(band)
    if len(bands) == 1:
        bands = [list(range(width))]
    out = []
    for columns in bands:
        narrow = [[r[c] for c in columns] for r in body]
        for piece, first, last in _row_groups([header[c] for c in columns], narrow, 2, most, shared):
            out.append({"rows": piece, "row_start": first, "row_end": last, "columns": columns})
    return out


PART = T.StructType(
    [
        T.StructField("part_id", T.StringType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("n_columns", T.IntegerType()),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_ord", T.IntegerType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("block_ids", T.ArrayType(T.StringType())),
        T.StructField("new_block_ids", T.ArrayType(T.StringType())),
        T.StructField("overlap_block_ids", T.ArrayType(T.StringType())),
        T.StructField("part_ids", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def parts_of(block: dict, most: int, overlap: int) -> list[dict]:
    """A block's parts: a table whole if it fits ``most``, a text if it fits what overlap leaves, else split."""
    shared = most - overlap
    if block["kind"] == "table" and block["table_rows"]:
        text = _rendered(block["table_rows"])
        if size_of(text) <= most:
            made = [(text, None, block["table_rows"])]
        else:
            made = [(_rendered(p["rows"]), len(p["columns"]), p["rows"]) for p in split_table(block["table_rows"], most, shared)]
    else:
        text = block["text"] or ""
        made = [(text, None, None)] if size_of(text) <= shared else [(t, None, None) for t in split_text(text, shared)]
    return [{"part_id": f"{block['block_id']}:part-{n:06d}", "block_id": block["block_id"], "kind": block["kind"], "text": t, "size": size_of(t), "n_columns": c, "rows": r} for n, (t, c, r) in enumerate(made, 1)]


def halve_part(part: dict) -> list[dict]:
    """A part in two: a table by rows, each half with the header, or one row by columns; a text in its middle. Ids are left to the caller."""
    rows = part["rows"]
    if rows is None:
        middle = len(part["text"]) // 2
        if not middle:
            raise Unsplittable("a character exceeds the budget")
        return [part | {"text": t, "size": size_of(t)} for t in (part["text"][:middle], part["text"][middle:])]
    width = max(map(len, rows))
    if len(rows) > 2:
        middle = 1 + (len(rows) - 1) // 2
        halves = [(rows[:middle], part["n_columns"]), ([rows[0], *rows[middle:]], part["n_columns"])]
    elif width > 1:
        padded, middle = [list(r) + [""] * (width - len(r)) for r in rows], width // 2
        halves = [([r[:middle] for r in padded], middle), ([r[middle:] for r in padded], width - middle)]
    else:
        raise Unsplittable("a cell exceeds the budget")
    return [part | {"text": (t := _rendered(r)), "size": size_of(t), "n_columns": c, "rows": r} for r, c in halves]


def fitted(parts: list[dict], most: int) -> list[dict]:
    """The parts of one block, halved until each fits ``most``, and numbered again."""
    out, left = [], parts[::-1]
    while left:
        part = left.pop()
        if part["size"] <= most:
            out.append(part)
        else:
            left += halve_part(part)[::-1]
    return [p | {"part_id": f"{p['block_id']}:part-{n:06d}"} for n, p in enumerate(out, 1)]


class _Packer:
    """One document's chunks, made as its blocks come by."""

    def __init__(self, most: int, overlap: int):
        self.limit, self.overlap = most, overlap
        self.beside: int | None = None
        self.new: list[dict] = []
        self.tail: list[dict] = []
        self.size = 0
        self.made = 0
        self.key = None

    @property
    def most(self) -> int:
        """Bytes of text that the chunk now filled may hold."""
        return self.limit if self.beside is None else self.limit - self.beside - len(self._id(self.made + 1))

    @staticmethod
    def _id(number: int) -> str:
        return f"chunk-{number:06d}"

    def parts(self, block: dict) -> list[dict]:
        if self.beside is None:
            return parts_of(block, self.limit, self.overlap)
        most = self.most
        if most < 1:
            raise Unsplittable("the prompt exceeds the budget")
        self.overlap = min(self.overlap, most - 1)
        made = parts_of(block, most, self.overlap)
        # No chunk that these parts come to has a longer name.
        return fitted(made, self.limit - self.beside - len(self._id(self.made + 1 + sum(max(p["size"], 1) for p in made))))

    def _tail(self) -> list[dict]:
        """Texts from the end of the last chunk, tables skipped, as long as the overlap lasts."""
        kept, used = [], 0
        for part in reversed(self.new):
            if part["kind"] == "table":
                continue
            cost = part["size"] + (SEPARATOR if kept else 0)
            if used + cost > self.overlap:
                break
            kept.append(part)
            used += cost
        return kept[::-1]

    def add(self, part: dict) -> list[tuple]:
        out = []
        if self.new and self.size + SEPARATOR + part["size"] > self.most:
            out.append(self.emit())
            self.tail = self._tail()
            while self.tail and sum(p["size"] + SEPARATOR for p in self.tail) + part["size"] > self.most:
                self.tail.pop(0)
            self.new = []
            self.size = sum(p["size"] for p in self.tail) + SEPARATOR * max(len(self.tail) - 1, 0)
        self.size += part["size"] + (SEPARATOR if self.new or self.tail else 0)
        self.new.append(part)
        return out

    def emit(self, error: str | None = None) -> tuple:
        self.made += 1
        parts = self.tail + self.new
        ids = lambda ps: list(dict.fromkeys(p["block_id"] for p in ps))
        text = "\n\n".join(p["text"] for p in parts)
        return (self.key, self.made - 1, self._id(self.made), text, size_of(text), ids(parts), ids(self.new), ids(self.tail), [p["part_id"] for p in parts], error)


def chunk_blocks(blocks: DataFrame, most: int = 32_000, overlap: int = 1_000, beside: str | None = None) -> DataFrame:
    """Chunks of at most ``most`` bytes from (doc_id, ord, block_id, kind, text, table_rows), in document order.

    ``beside`` names a column with the bytes that a request of the document has besides a chunk's name and text; then
    name, text and these together take at most ``most``.
    A block that can't be split gives a row with ``error`` and no text, and its document goes on.
    """

    def start():
        return _Packer(most, overlap)

    def step(packer, row):
        packer.key = row["doc_id"]
        packer.beside = row[beside] if beside else None
        try:
            parts = packer.parts(row)
        except Unsplittable as error:
            return [(row["doc_id"], None, None, None, None, [row["block_id"]], [], [], [], str(error))]
        return [c for part in parts for c in packer.add(part)]

    def finish(packer, key):
        return [packer.emit()] if packer.new else []

    return ordered_fold(blocks.select("doc_id", "ord", "block_id", "kind", "text", "table_rows", *([beside] if beside else [])), ["doc_id"], ["ord", "block_id"], start, step, finish, CHUNK)


def pack_sizes(items: DataFrame, key: str, order: str, size: str, budget: int, separator: int = SEPARATOR) -> DataFrame:
    """``key, chunk_ord, n_items, total``: items packed greedily in order; one above the budget stands alone."""
    schema = T.StructType([items.schema[key], T.StructField("chunk_ord", T.IntegerType()), T.StructField("n_items", T.LongType()), T.StructField("total", T.LongType())])

    def step(state, row):
        out = []
        grown = state["total"] + separator + row[size]
        if state["n"] and grown > budget:
            out.append((state["key"], state["ord"], state["n"], state["total"]))
            state.update(ord=state["ord"] + 1, n=0)
        state.update(key=row[key], total=grown if state["n"] else row[size], n=state["n"] + 1)
        return out

    def finish(state, own):
        return [(state["key"], state["ord"], state["n"], state["total"])]

    return ordered_fold(items.select(key, order, F.col(size).cast("long").alias(size)), [key], [order], lambda: {"key": None, "ord": 0, "n": 0, "total": 0}, step, finish, schema)


def repeated_rows(rows: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """``key, row_text, n, first``: normalized rows that a document has more than once, with their first position.

    ``first`` is a struct of the ``order`` columns; the aggregate combines on the map side.
    """
    plain = rows.withColumn("row_text", X.squeeze_ascii(F.col(text))).filter("row_text != ''")
    return plain.groupBy(key, "row_text").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first")).filter("n > 1")


def repeated_summary(repeated: DataFrame, key: str, most: int = 256) -> DataFrame:
    """One row a document: rows, occurrences, and the rows' JSON, or a digest of them where it is longer than ``most``.

    Rows are put together only where they may fit ``most``; the digest is of the rows as a set, summed up, so no document's
    rows are collected for it.
    """
    part = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", "n", "row_text"), 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    sums = repeated.groupBy(key).agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_total"), F.sum(F.length("row_text")).alias("size"), *(F.sum(part(k)).alias(f"d{k}") for k in range(3)))
    told = sums.withColumn("digest", F.sha2(F.concat_ws(":", "n_rows", *(F.col(f"d{k}").cast("string") for k in range(3))), 256))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("first", "row_text", "n"))), lambda r: F.struct(r["row_text"].alias("row"), r["n"].alias("count")))
    small = repeated.join(sums.filter(F.col("size") <= most).select(key), key, "left_semi").groupBy(key).agg(F.to_json(rows).alias("json"))
    fits = F.coalesce(F.length("json") <= most, F.lit(False))
    return told.join(small, key, "left").select(key, "n_rows", "n_total", F.when(fits, F.col("json")).alias("inventory"), F.when(~fits, F.col("digest")).alias("digest"))


def split_table_summary(parts: DataFrame) -> DataFrame:
    """``chunk_key, block_id, n_parts, n_headers`` of blocks in two or more parts."""
    return parts.groupBy("chunk_key", "block_id").agg(F.count("*").alias("n_parts"), F.countDistinct("header").alias("n_headers")).filter("n_parts >= 2")


def neighbours(chunks: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds the value of the chunk before and of the chunk after."""
    w = Window.partitionBy(key).orderBy(order)
    return chunks.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))
