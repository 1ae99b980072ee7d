"""Documents of pages: a pluggable converter of pages to layout items, items to blocks, and the text layer of PDF files.

A converter is a function (content, page number from 1, options) -> layout items; it may raise, and then its page is a failed
unit of the document's coverage while the others stand. A layout item is a dict: kind (text, list, heading, table,
furniture), text, level (of a heading), marker (of a list), cells (of a table: row, column, text, is_header, from 0, a
merged cell once).
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from tessella.sources.parsers import SourceFault, table_block, text_block

MOST_PAGES = 2_000
OCR = ("always", "auto", "never")


@dataclass(frozen=True)
class PageOptions:
    """What a converter is asked for; a page limit and a deadline bound a document."""

    ocr: str = "auto"
    keep_furniture: bool = False
    nested_headings: bool = True
    first_pages: int | None = None
    most_pages: int = MOST_PAGES
    deadline: float = 1_800.0
    partial_on_deadline: bool = False

    def __post_init__(self):
        if self.ocr not in OCR:
            raise ValueError(f"ocr is one of {', '.join(OCR)}")
        if min(self.most_pages, 1 if self.first_pages is None else self.first_pages) < 1 or self.deadline <= 0:
            raise ValueError("counts and the deadline are positive")


def push_heading(path: list[tuple[int, str]], level: int, text: str) -> list[tuple[int, str]]:
    """The path of headings after a new one, which closes those of its level and below."""
    return [h for h in path if h[0] < level] + [(level, text)]


def grid_rows(cells: list[dict]) -> list[list[str]]:
    """A table's rows; of several header rows one is made, its names joined by full stops."""
    if not cells:
        return []
    height, width = 1 + max(c["row"] for c in cells), 1 + max(c["column"] for c in cells)
    rows = [[""] * width for _ in range(height)]
    heads = {c["row"] for c in cells if c.get("is_header")}
    for c in cells:
        rows[c["row"]][c["column"]] = " ".join((c["text"] or "").split())
    top = 0
    while top in heads:
        top += 1
    if top < 2:
        return rows
    return [[".".join(dict.fromkeys(r[k] for r in rows[:top] if r[k])) for k in range(width)], *rows[top:]]


def layout_blocks(pages: list[tuple[int, list[dict]]], options: PageOptions = PageOptions()) -> list[dict]:
    """Blocks in reading order with their pages; empty ones are left out, as is furniture unless it is asked for."""
    out, path = [], []
    for number, items in pages:
        for item in items:
            text = " ".join((item.get("text") or "").split())
            if item["kind"] == "furniture" and not options.keep_furniture:
                continue
            if item["kind"] == "heading" and text:
                path = push_heading(path if options.nested_headings else [], item.get("level") or 1, text)
            section = [t for _, t in path]
            if item["kind"] == "table":
                rows = grid_rows(item["cells"])
                block = table_block(rows, section) if any(any(r) for r in rows) else None
            else:
                marker = item.get("marker") if item["kind"] == "list" else None
                block = text_block(f"{marker} {text}" if marker else text, section) if text else None
            if block:
                out.append(block | {"page": number})
    return out


def convert_pages(content: bytes, n_pages: int, convert: Callable[[bytes, int, PageOptions], list[dict]], options: PageOptions = PageOptions(), clock: Callable[[], float] = time.monotonic) -> tuple[list[dict], dict]:
    """``(blocks, coverage)``: what the converter made of each page, and which pages it failed on.

    Past the deadline the rest fails if a part is wanted, else the document does; a document of too many pages does too.
    """
    if n_pages > options.most_pages:
        raise SourceFault("SOURCE_LIMIT_EXCEEDED", "pages")
    wanted = min(n_pages, options.first_pages or n_pages)
    began, done, failed = clock(), [], []
    for number in range(1, wanted + 1):
        if clock() - began > options.deadline:
            if not options.partial_on_deadline:
                raise SourceFault("SOURCE_LIMIT_EXCEEDED", "deadline")
            failed += range(number, wanted + 1)
            break
        try:
            done.append((number, convert(content, number, options)))
        except Exception:
            failed.append(number)
    return layout_blocks(done, options), {"unit_kind": "page", "total_units": wanted, "converted_units": [n for n, _ in done], "failed_units": failed}


# --- the text layer of PDF files ------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class TextLayer:
    """The pages of a PDF file and the text that is stored in them; fonts without a plain encoding can't be read."""

    def __init__(self, content: bytes):
        if b"/Encrypt" in content:
            raise SourceFault("SOURCE_ENCRYPTED")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            self._unpack(body)
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
        self.pages = [p for root in roots[:1] for p in self._kids(root, 0)]

    def _unpack(self, body: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", body)
        data = self.stream(body)
        if first:
            numbers = list(map(int, data[: int(first[1])].split()))
            starts = [int(first[1]) + n for n in numbers[1::2]]
            for number, start, end in zip(numbers[::2], starts, [*starts[1:], len(data)]):
                self.objects.setdefault(number, data[start:end])

    @staticmethod
    def stream(body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body else found[1]

    def _kids(self, node: bytes, depth: int) -> list[bytes]:
        kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
        if not kids or depth > 50:
            return [] if kids else [node]
        return [p for n in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]) for p in self._kids(self.objects.get(int(n), b""), depth + 1)]

    def lines(self, number: int) -> list[str]:
        """The lines of a page, in the order in which they are stored."""
        page = self.pages[number - 1]
        if re.search(rb"/Identity-[HV]", b" ".join(self.objects.values())):
            raise ValueError("fonts of glyph numbers")
        named = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        data = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", named[1])) if named else b""
        lines, shown, numbers = [], "", []
        for token in _SHOWN.findall(data):
            if token[:1] == b"(":
                raw = _ESCAPE.sub(lambda m: _PLAIN.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1][-1:] == b"\n" else m[1]), token[1:-1])
                shown += raw[2:].decode("utf-16-be") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
            elif token[:1] == b"<":
                raw = bytes.fromhex("".join(token[1:-1].decode().split()))
                shown += raw.decode("cp1252", "replace")
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET"):
                if token not in (b"Td", b"TD") or len(numbers) < 2 or float(numbers[-1]) != 0:
                    lines.append(shown)
                    shown = ""
                elif shown:
                    shown += " "
                numbers = []
            elif token[:1] in b"-+.0123456789":
                numbers.append(token)
                if len(numbers) == 1 and token[:1] == b"-" and float(token) < -200 and shown:
                    shown += " "
            else:
                numbers = []
        lines.append(shown)
        return [text for line in lines if (text := line.strip())]


def text_page(content: bytes, number: int, options: PageOptions) -> list[dict]:
    """The default converter: each line of the text layer is a text item."""
    return [{"kind": "text", "text": line} for line in TextLayer(content).lines(number)]


def parse_pdf(content: bytes) -> list[dict]:
    """Blocks of a PDF file's text layer; a file without any text needs a converter that reads pictures."""
    layer = TextLayer(content)
    blocks, _ = convert_pages(content, len(layer.pages), lambda c, n, o: [{"kind": "text", "text": line} for line in layer.lines(n)])
    if not blocks:
        raise SourceFault("SOURCE_DEPENDENCY_MISSING", "a page converter")
    return blocks
