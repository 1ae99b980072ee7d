"""Cutting oversized chunks, and oversized parts of chunks, at natural boundaries.

An item is a text with the spans of its parts. Prefix sums give the size (bytes, characters, words or tokens) of any
range from two look-ups; the boundaries (ends of parts, paragraphs and table rows, of lines and sentences, of cells,
clauses and words) stand in sorted arrays. From a piece's start the furthest offset under the limit is found by binary
search in the prefix sums and the last boundary before it by binary search in the arrays, best kind first; with no
boundary in reach the cut is hard, between characters (an extended character such as a letter with its accents is kept
whole where it fits). The next piece starts at a boundary at most ``overlap_size`` back, always after the last start, so
every piece brings something new. A piece that starts inside a table, after its header, gets the header on top and the
header counts into its size; a header above HEADER_SHARE of the limit is not repeated, as rows would no longer fit.

Cases: null and empty texts are never oversized; a null profile is the default chunking profile; a profile unknown to
``limits`` or without max_size has no limit; an overlap that is null counts as 0, one of half the limit or more as half;
ragged, repeated and empty rows are cut like others; stale or null token_count is not read; a chunk whose text isn't
that of its parts is cut as one plain text with all its block ids; repeated rows give repeated pieces; extra columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tokenizer import VOCABULARY, encoder_of, ship_vocabulary
from tessella.runtime import read_table, spread

MAX_PROFILES = 1000
HEADER_SHARE = 0.75
#: A boundary is taken only if the piece is at least this full; the last entry is for any boundary left.
LEAST_FILL = 0.5
JOINT = "\n\n"
PIECES = (
    "chunk_key long, part_id string, piece_no int, piece_count int, kind string, text string, size long, max_size long, size_unit string, "
    "start_offset long, end_offset long, has_header boolean, block_ids array<string>, new_block_ids array<string>, overlap_block_ids array<string>"
)

_PARAGRAPH = re.compile(r"(?:\r?\n[^\S\n]*){2,}")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"[.!?…。]+[\"'»”)\]]*\s+|[;:]\s+")
_CELL = re.compile(r" \| |[,/·]\s+|\t")
_WORD = re.compile(r"\s+")
_GRAPHEME = regex.compile(r"\X")


def prefix_sizes(text: str, unit: str, count=None) -> np.ndarray:
    """size(text[:i]) for every i; a range's size is a difference (of tokens, nearly so)."""
    n = len(text)
    if unit == "characters":
        return np.arange(n + 1)
    if unit == "bytes":
        if text.isascii():
            return np.arange(n + 1)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=out[1:])
        return out
    out = np.zeros(n + 1, np.int64)
    if unit == "words":
        for m in re.finditer(r"\S+", text):
            out[m.start() + 1] = 1
    else:
        for m in re.finditer(r"\s*\S+|\s+$", text):
            out[m.end()] = count(m.group())
    return np.cumsum(out)


def size_of(text: str, unit: str, count=None) -> int:
    return count(text) if unit == "tokens" else int(prefix_sizes(text, unit)[-1])


def boundaries(text: str, spans: list[tuple]) -> list[list[int]]:
    """Sorted offsets at which a piece may end, best kind first."""
    ends = sorted({b for a, b, *_ in spans} | {a for a, *_ in spans if a})
    tables = [(a, b) for a, b, kind, *_ in spans if kind == "table"]
    rows = [m.end() for a, b in tables for m in _LINE.finditer(text, a, b)]
    inside = lambda i: any(a < i < b for a, b in tables)
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text) if not inside(m.end())]
    lines = [m.end() for m in _LINE.finditer(text)]
    sentences = [m.end() for m in _SENTENCE.finditer(text) if not inside(m.end())]
    cells = [m.end() for m in _CELL.finditer(text)]
    words = [m.end() for m in _WORD.finditer(text)]
    first = sorted({*ends, *paragraphs, *rows})
    return [ends, first, sorted({*first, *sentences}), sorted({*first, *sentences, *lines}), sorted({*lines, *cells}), words]


def _last(offsets: list[int], above: int, upto: int) -> int | None:
    i = bisect_right(offsets, upto) - 1
    return offsets[i] if i >= 0 and offsets[i] > above else None


def _end(text: str, sums: np.ndarray, kinds: list[list[int]], unit: str, start: int, reach: int, room: int) -> int:
    """Where a piece ends: the best boundary in reach that leaves it full enough, any boundary, else a hard cut."""
    if unit == "words":
        reach = _last(kinds[-1], start, reach) or reach
    enough = int(np.searchsorted(sums, sums[start] + int(room * LEAST_FILL), "left"))
    for offsets in kinds:
        end = _last(offsets, max(start, enough - 1), reach)
        if end is not None:
            return end
    end = _last(kinds[-1], start, reach)
    if end is not None:
        return end
    end = max(reach, start + 1)
    if end < len(text):
        whole = [start + m.end() for m in _GRAPHEME.finditer(text[start : end + 1]) if start + m.end() <= end]
        end = whole[-1] if whole else end
    return end


def cut(text: str, spans: list[tuple], unit: str, most: int, overlap: int, count=None) -> list[tuple[int, int, str]]:
    """(start, end, header) of the pieces; spans are (start, end, kind, block_id, header) in order."""
    sums = prefix_sizes(text, unit, count)
    kinds = boundaries(text, spans)
    measure = lambda t: size_of(t, unit, count)
    starts = [a for a, *_ in spans]
    headers = [measure(h + "\n") if h else 0 for *_, h in spans]
    overlap = min(max(overlap, 0), most // 2)
    out: list[tuple[int, int, str]] = []
    n, start = len(text), 0
    while start < n:
        k = max(bisect_right(starts, start) - 1, 0)
        span = spans[k]
        header, room = "", most
        if span[4] and span[0] + len(span[4]) < start < span[1] and headers[k] <= HEADER_SHARE * most:
            header, room = span[4], most - headers[k]
        reach = int(np.searchsorted(sums, sums[start] + room, "right")) - 1
        if reach >= n and (unit != "tokens" or measure(f"{header}\n{text[start:]}" if header else text[start:]) <= most):
            out.append((start, n, header))
            break
        reach = min(reach, n - (unit == "tokens"))
        end = _end(text, sums, kinds, unit, start, reach, room)
        while unit == "tokens" and end > start + 1 and measure(f"{header}\n{text[start:end]}" if header else text[start:end]) > most:
            # Tokens of a piece aren't quite those of its words: a smaller piece is tried.
            end = _end(text, sums, kinds, unit, start, end - 1, room)
        out.append((start, end, header))
        if end >= n:
            break
        # Step back: the first boundary that leaves at most the overlap, a coarse one before a fine one.
        back = int(np.searchsorted(sums, sums[end] - overlap, "left")) if overlap else end
        back = max(back, start + 1)
        follow = end
        if back < end:
            for offsets in (kinds[2], kinds[3], kinds[5]):
                i = bisect_left(offsets, back)
                if i < len(offsets) and offsets[i] < end:
                    follow = offsets[i]
                    break
        if follow < end:
            # The overlap must leave room for something new.
            j = max(bisect_right(starts, follow) - 1, 0)
            head = headers[j] if spans[j][4] and spans[j][0] + len(spans[j][4]) < follow < spans[j][1] and headers[j] <= HEADER_SHARE * most else 0
            further = int(np.searchsorted(sums, sums[follow] + most - head, "right")) - 1
            if further <= end or _last(kinds[-1], end, further) is None and further < n:
                follow = end
        start = follow
    return out


def pieces_of(text: str, spans: list[tuple], unit: str, most: int, overlap: int, count=None) -> list[dict]:
    """The pieces as rows: text with header, size and the block ids that are in it, new in it and repeated in it."""
    rows, done = [], 0
    for start, end, header in cut(text, spans, unit, most, overlap, count):
        body = text[start:end].strip("\n") if unit != "tokens" else text[start:end]
        full = f"{header}\n{body}" if header else body
        within = lambda a, b: list(dict.fromkeys(i for x, y, _, ids, _ in spans for i in ids if x < b and a < y))  # noqa: B023, E731
        rows.append(
            {
                "text": full,
                "size": size_of(full, unit, count),
                "start_offset": start,
                "end_offset": end,
                "has_header": bool(header),
                "block_ids": within(start, end),
                "new_block_ids": within(max(start, done), end),
                "overlap_block_ids": within(start, done) if start < done else [],
            }
        )
        done = end
    return rows


def header_of(kind: str | None, text: str) -> str:
    return text.split("\n", 1)[0] if kind == "table" and "\n" in text else ""


def collect_limits(limits: DataFrame) -> list[dict]:
    """The chunking profiles: a fixed table, its size checked."""
    rows = limits.filter("used_for = 'chunking' and max_size >= 1").select("profile_name", "size_unit", "max_size", "overlap_size", "is_default").limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} chunking profiles")
    return sorted((r.asDict() for r in rows), key=lambda r: (r["profile_name"] or "", r["max_size"]))


def size_in(text: Column, unit: Column, tokens) -> Column:
    """Size of a text in its unit, without leaving the JVM (but for tokens, where a profile asks for them)."""
    size = F.when(unit == "bytes", F.octet_length(text)).when(unit == "characters", F.char_length(text)).when(unit == "words", F.regexp_count(text, F.lit(r"(?U)\S+")))
    return (size.when(unit == "tokens", tokens(text)) if tokens else size).cast("long")


def split_oversized(chunks: DataFrame, limits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Pieces of every oversized chunk (part_id '') and of every oversized part, each item cut by itself.

    One pass without a shuffle: sizes are taken in the JVM and only oversized items reach Python.
    """
    spark = chunks.sparkSession
    profiles = collect_limits(limits)
    vocabulary = ship_vocabulary(spark, path) if any(p["size_unit"] == "tokens" for p in profiles) else None
    tokens = None
    if vocabulary is not None:

        @F.pandas_udf("long")
        def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            count = encoder_of(vocabulary.value).count
            for batch in batches:
                yield batch.map(count)

    default = next((p["profile_name"] for p in profiles if p["is_default"]), None)
    unit, most, lap = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(0)
    name = F.coalesce(F.col("profile_name"), F.lit(default))
    for p in profiles:
        here = name == p["profile_name"]
        unit, most = F.when(here, F.lit(p["size_unit"])).otherwise(unit), F.when(here, F.lit(int(p["max_size"]))).otherwise(most)
        lap = F.when(here, F.lit(int(p["overlap_size"] or 0))).otherwise(lap)
    part = "struct<id:string,kind:string,block_id:string,text:string>"
    slim = spread(chunks.select("chunk_key", "profile_name", "text", "parts", "block_ids")).select(
        F.col("chunk_key").cast("long").alias("chunk_key"),
        "text",
        F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["kind"].alias("kind"), p["block_id"].alias("block_id"), p["text"].alias("text"))).cast(f"array<{part}>").alias("parts"),
        "block_ids",
        unit.alias("unit"),
        most.alias("most"),
        lap.alias("lap"),
    )
    sized = slim.withColumn("whole", F.coalesce(size_in(F.col("text"), F.col("unit"), tokens) > F.col("most"), F.lit(False)))
    if tokens:
        # A Python function can't run inside a lambda, so parts are measured in a second look by the splitter.
        sized = sized.withColumn("over", F.when(F.col("unit") == "tokens", F.col("parts")).otherwise(F.filter("parts", lambda p: size_in(p["text"], F.col("unit"), None) > F.col("most"))))
    else:
        sized = sized.withColumn("over", F.filter("parts", lambda p: size_in(p["text"], F.col("unit"), None) > F.col("most")))
    work = sized.filter("whole or size(over) > 0").select(
        "chunk_key", "unit", "most", "lap", "over", F.when(F.col("whole"), F.col("text")).alias("text"), F.when(F.col("whole"), F.col("parts")).alias("parts"), "block_ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder_of(vocabulary.value).count if vocabulary is not None else None
        names = [f.split(" ")[0] for f in PIECES.split(", ")]
        strings = pa.list_(pa.string())
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), strings, strings, strings]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                unit, most, lap = row["unit"], row["most"], row["lap"]
                items = []
                if row["text"] is not None:
                    parts = [p for p in row["parts"] or [] if p is not None and p["text"] is not None]
                    if parts and JOINT.join(p["text"] for p in parts) == row["text"]:
                        spans, at = [], 0
                        for p in parts:
                            spans.append((at, at + len(p["text"]), p["kind"], [p["block_id"]] if p["block_id"] else [], header_of(p["kind"], p["text"])))
                            at += len(p["text"]) + len(JOINT)
                    else:
                        spans = [(0, len(row["text"]), "text", [b for b in row["block_ids"] or [] if b], "")]
                    items.append(("", "chunk", row["text"], spans))
                for p in row["over"] or []:
                    if p is None or p["text"] is None or unit == "tokens" and count(p["text"]) <= most:
                        continue
                    items.append((p["id"] or "", p["kind"], p["text"], [(0, len(p["text"]), p["kind"], [p["block_id"]] if p["block_id"] else [], header_of(p["kind"], p["text"]))]))
                for part_id, kind, text, spans in items:
                    made = pieces_of(text, spans, unit, most, lap, count)
                    for no, piece in enumerate(made):
                        known = {"chunk_key": row["chunk_key"], "part_id": part_id, "piece_no": no, "piece_count": len(made), "kind": kind, "max_size": most, "size_unit": unit} | piece
                        for column, field in zip(columns, names):
                            column.append(known[field])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return work.mapInArrow(run, PIECES)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "source_chunks"), read_table(spark, sf_dir, "size_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).filter("piece_no = 0").select("chunk_key", "part_id").distinct()


_SIZE = "case l.size_unit when 'bytes' then strlen({0}) when 'characters' then length({0}) when 'words' then len(regexp_extract_all({0}, '[^\\s\\x0b\\x85\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+')) end > l.max_size"
SQL = {
    "p3_found": f"""
with l as (select * from size_limits where used_for = 'chunking' and max_size >= 1),
c as (select c.chunk_key, c.text, c.parts, coalesce(c.profile_name, (select min(profile_name) from l where is_default)) as profile_name from source_chunks c),
p as (select chunk_key, profile_name, unnest(parts) as p from c)
select distinct chunk_key, '' as part_id from c join l using (profile_name) where {_SIZE.format('c.text')}
union
select distinct chunk_key, p.id as part_id from p join l using (profile_name) where {_SIZE.format('p.p.text')}
"""
}
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
