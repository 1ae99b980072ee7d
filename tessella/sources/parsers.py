"""Bytes of a document to ordered blocks, one pure function a format, with the standard library only.

A block is a dict: kind (text or table), text, rows (of a table), section (path), sheet, and page where the source has
pages. A parser raises SourceFault with a code; a document never fails a job.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

#: Limits of a source.
MOST_BYTES = 250 * 1024 * 1024
MOST_CELLS = 2_000_000
MOST_ENTRIES = 10_000
MOST_EXPANDED = 1024 * 1024 * 1024
MOST_RATIO = 200
MOST_DEPTH = 20


class SourceFault(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def text_block(text: str, section=()) -> dict:
    return {"kind": "text", "text": text, "rows": None, "section": list(section), "sheet": None}


def table_block(rows: list[list[str]], section=(), sheet: str | None = None) -> dict:
    return {"kind": "table", "text": None, "rows": rows, "section": list(section), "sheet": sheet}


def decode(content: bytes) -> str:
    """Strict UTF-8 without a byte order mark; a NUL byte is no text."""
    if b"\0" in content:
        raise SourceFault("SOURCE_FORMAT_INVALID", "NUL byte")
    try:
        return content.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError as error:
        raise SourceFault("SOURCE_FORMAT_INVALID", "not UTF-8") from error


def _bounded(rows: list[list[str]]) -> list[list[str]]:
    if sum(map(len, rows)) > MOST_CELLS:
        raise SourceFault("SOURCE_LIMIT_EXCEEDED", "cells")
    return rows


def is_heading(paragraph: str) -> bool:
    """One line of at most 120 characters that begins with section or module, or has at most 12 words, all capitals."""
    if "\n" in paragraph or len(paragraph) > 120:
        return False
    return bool(re.match(r"(?i)(section|module)\b", paragraph)) or (len(paragraph.split()) <= 12 and paragraph.isupper())


def parse_text(content: bytes) -> list[dict]:
    out, section = [], []
    for part in re.split(r"\r?\n\s*\r?\n", decode(content)):
        if part := part.strip():
            if is_heading(part):
                section = [part]
            out.append(text_block(part, section))
    return out


def parse_csv(content: bytes) -> list[dict]:
    """One table of all rows as they stand; an empty file has no block."""
    try:
        rows = _bounded(list(csv.reader(io.StringIO(decode(content), newline=""), strict=True)))
    except csv.Error as error:
        raise SourceFault("SOURCE_FORMAT_INVALID", str(error)) from error
    return [table_block(rows)] if rows else []


def markdown_cells(line: str) -> list[str]:
    """Cells of a pipe row; escaped bars and bars inside code spans don't part cells."""
    cells, cell, code, i = [], "", "", 0
    line = line.strip()
    while i < len(line):
        c = line[i]
        if c == "`":
            run = re.match(r"`+", line[i:])[0]
            if not code and run in line[i + len(run) :]:
                code = run
            elif code == run:
                code = ""
            cell, i = cell + run, i + len(run)
            continue
        if c == "\\" and line[i + 1 : i + 2] == "|":
            cell, i = cell + "|", i + 2
            continue
        if c == "|" and not code:
            cells.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    cells.append(cell.strip())
    return cells[1 if line.startswith("|") else 0 : -1 if line.endswith("|") and not cell.strip() else None]


def parse_markdown(content: bytes) -> list[dict]:
    """ATX headings open flat sections, pipe tables lose their rule, the rest is paragraphs."""
    lines = decode(content).splitlines()
    out, section, held, i = [], [], [], 0

    def flush():
        if held and (text := "\n".join(held).strip()):
            out.append(text_block(text, section))
        held.clear()

    rule = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    while i < len(lines):
        line = lines[i]
        heading = re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if heading:
            flush()
            section = [heading[2]]
            out.append(text_block(heading[2], section))
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and rule.match(lines[i + 1]):
            flush()
            rows = [markdown_cells(line)]
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(markdown_cells(lines[i]))
                i += 1
            out.append(table_block(_bounded(rows), section))
            continue
        elif not line.strip():
            flush()
        else:
            held.append(line)
        i += 1
    flush()
    return out


class _Html(HTMLParser):
    """Visible text; tables to the outermost, cells on their end tags."""

    HIDDEN = frozenset(("script", "style", "noscript", "template", "iframe", "object", "embed"))
    BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form header hr li main nav ol p pre section ul body".split())
    HEADING = frozenset(f"h{n}" for n in range(1, 7))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.section: list[str] = []
        self.held: list[str] = []
        self.hidden = self.tables = 0
        self.heading = ""
        self.rows: list[list[str]] = []
        self.row: list[str] = []
        self.cell: list[str] | None = None

    def flush(self, heading: bool = False):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            if heading:
                self.section = [text]
            self.out.append(text_block(text, self.section))

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "table":
            if not self.tables:
                self.flush()
                self.rows = []
            self.tables += 1
        elif self.tables:
            if tag == "tr":
                self.row = []
            elif tag in ("td", "th"):
                self.cell = []
        elif tag in self.HEADING:
            self.flush()
            self.heading = tag
        elif tag in self.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif self.hidden:
            return
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables and self.rows:
                self.out.append(table_block(_bounded(self.rows), self.section))
        elif self.tables:
            if tag in ("td", "th") and self.cell is not None:
                self.row.append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif tag == "tr" and self.row:
                self.rows.append(self.row)
                self.row = []
        elif tag == self.heading:
            self.flush(heading=True)
            self.heading = ""
        elif tag in self.BLOCK:
            self.flush()

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.tables:
            self.held.append(data)
        elif self.cell is not None:
            self.cell.append(data)


def parse_html(content: bytes) -> list[dict]:
    parser = _Html()
    parser.feed(decode(content))
    parser.close()
    parser.flush()
    return parser.out


def open_zip(content: bytes) -> zipfile.ZipFile:
    """An archive whose names, sizes and ratios are within limits."""
    end = content.rfind(b"PK\x05\x06")
    if end < 0 or int.from_bytes(content[end + 10 : end + 12], "little") > MOST_ENTRIES:
        raise SourceFault("SOURCE_FORMAT_INVALID", "archive directory")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        raise SourceFault("SOURCE_FORMAT_INVALID", "archive") from error
    total = 0
    for info in archive.infolist():
        parts = info.filename.replace("\\", "/").split("/")
        if info.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or len(parts) > MOST_DEPTH or len(info.filename) > 512:
            raise SourceFault("SOURCE_UNSAFE", "archive name")
        if info.flag_bits & 1:
            raise SourceFault("SOURCE_ENCRYPTED")
        total += info.file_size
        if total > MOST_EXPANDED or info.file_size > MOST_RATIO * max(info.compress_size, 1) and info.file_size > 1 << 20:
            raise SourceFault("SOURCE_LIMIT_EXCEEDED", "archive size")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        raw = archive.read(name)
    except KeyError as error:
        raise SourceFault("SOURCE_FORMAT_INVALID", f"no {name}") from error
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise SourceFault("SOURCE_UNSAFE", "document type")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as error:
        raise SourceFault("SOURCE_FORMAT_INVALID", name) from error


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def cell_place(reference: str) -> tuple[int, int]:
    """(column, row), from 1, of a reference such as AB12."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6})", reference.upper())
    if not m:
        raise SourceFault("SOURCE_FORMAT_INVALID", "cell reference")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return column, int(m[2])


def _xlsx_cell(cell, shared: list[str], dates: set[int]) -> str:
    if any(_local(c.tag) == "f" for c in cell):
        raise SourceFault("SOURCE_UNSAFE", "formula")
    kind, value = cell.get("t", "n"), next((c for c in cell if _local(c.tag) == "v"), None)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    if value is None or value.text is None:
        return ""
    if kind == "s":
        at = value.text.strip()
        if not at.isdigit() or int(at) >= len(shared):
            raise SourceFault("SOURCE_FORMAT_INVALID", "shared string")
        return shared[int(at)]
    if kind == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        from datetime import datetime, timedelta

        moment = datetime(1899, 12, 30) + timedelta(days=float(value.text))
        return moment.date().isoformat() if moment.time() == moment.min.time() else moment.isoformat(sep=" ", timespec="seconds")
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", value.text):
        return value.text.split(".")[0]
    return value.text


def parse_xlsx(content: bytes) -> list[dict]:
    """A table for each sheet that isn't empty, cells as text, blanks kept inside the used range."""
    archive = open_zip(content)
    names = set(archive.namelist())
    if any(n.lower().endswith("vbaproject.bin") for n in names):
        raise SourceFault("SOURCE_UNSAFE", "macros")
    if any(n.startswith("xl/externalLinks/") for n in names):
        raise SourceFault("SOURCE_UNSAFE", "external links")
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in _xml(archive, "xl/sharedStrings.xml") if _local(item.tag) == "si"]
    dates: set[int] = set()
    if "xl/styles.xml" in names:
        styles = _xml(archive, "xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _local(f.tag) == "numFmt"}
        formats = next((x for x in styles if _local(x.tag) == "cellXfs"), ())
        for n, x in enumerate(formats):
            code = int(x.get("numFmtId", 0))
            if 14 <= code <= 22 or 45 <= code <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "")), re.I):
                dates.add(n)
    targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
    out, cells = [], 0
    for sheet in _xml(archive, "xl/workbook.xml").iter():
        if _local(sheet.tag) != "sheet":
            continue
        target = targets.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None))
        if target is None:
            raise SourceFault("SOURCE_FORMAT_INVALID", "a sheet without a part")
        path = target if target.startswith("xl/") else f"xl/{target}"
        rows: dict[int, dict[int, str]] = {}
        for row in _xml(archive, path).iter():
            if _local(row.tag) != "row":
                continue
            for n, cell in enumerate((c for c in row if _local(c.tag) == "c"), 1):
                column, number = cell_place(cell.get("r")) if cell.get("r") else (n, int(row.get("r", len(rows) + 1)))
                value = _xlsx_cell(cell, shared, dates)
                cells += 1
                if cells > MOST_CELLS:
                    raise SourceFault("SOURCE_LIMIT_EXCEEDED", "cells")
                if value:
                    rows.setdefault(number, {})[column] = value
        if rows:
            width = max(max(r) for r in rows.values())
            if width * max(rows) > MOST_CELLS:
                raise SourceFault("SOURCE_LIMIT_EXCEEDED", "cells")
            table = [[rows.get(r, {}).get(c, "") for c in range(1, width + 1)] for r in range(1, max(rows) + 1)]
            name = sheet.get("name", "")
            out.append(table_block(table, [name], name))
    return out


def _docx_text(node) -> str:
    out = []
    for n in node.iter():
        tag = _local(n.tag)
        out.append((n.text or "") if tag == "t" else "\t" if tag == "tab" else "\n" if tag in ("br", "cr") else "")
    return "".join(out).strip()


def _docx_body(node) -> Iterator:
    """Paragraphs and tables in order, through containers that change nothing."""
    for child in node:
        tag = _local(child.tag)
        if tag in ("p", "tbl"):
            yield tag, child
        elif tag in ("sdt", "sdtContent", "customXml", "ins", "smartTag"):
            yield from _docx_body(child)


def parse_docx(content: bytes) -> list[dict]:
    archive = open_zip(content)
    if any(n.lower().endswith("vbaproject.bin") for n in archive.namelist()):
        raise SourceFault("SOURCE_UNSAFE", "macros")
    body = next((x for x in _xml(archive, "word/document.xml") if _local(x.tag) == "body"), None)
    if body is None:
        raise SourceFault("SOURCE_FORMAT_INVALID", "no body")
    out, section = [], []
    for tag, node in _docx_body(body):
        if tag == "tbl":
            rows = [[_docx_text(c) for c in row if _local(c.tag) == "tc"] for row in node if _local(row.tag) == "tr"]
            if any(any(r) for r in rows):
                out.append(table_block(_bounded(rows), section))
            continue
        text = _docx_text(node)
        if not text:
            continue
        style = next((v for s in node.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
        if re.match(r"(?i)(heading|title)", style):
            section = [text]
        out.append(text_block(text, section))
    return out


def _missing(what: str) -> Callable[[bytes], list[dict]]:
    def parse(content: bytes) -> list[dict]:
        raise SourceFault("SOURCE_DEPENDENCY_MISSING", what)

    return parse


def _pdf(content: bytes) -> list[dict]:
    from tessella.sources.pages import parse_pdf

    return parse_pdf(content)


#: Suffix to parser; a converter for scanned pages or legacy office files can be registered in its place.
REGISTRY: dict[str, Callable[[bytes], list[dict]]] = {
    "txt": parse_text, "csv": parse_csv, "md": parse_markdown, "markdown": parse_markdown, "html": parse_html, "htm": parse_html, "xlsx": parse_xlsx, "docx": parse_docx,
    "pdf": _pdf, "doc": _missing("an office converter"), "xls": _missing("an office converter"),
}


def check_signature(content: bytes, suffix: str) -> None:
    """The first bytes must fit the suffix; a package must be of exactly one kind."""
    if suffix == "pdf" and not content.startswith(b"%PDF-"):
        raise SourceFault("SOURCE_FORMAT_INVALID", "signature")
    if suffix in ("doc", "xls") and not content.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        raise SourceFault("SOURCE_FORMAT_INVALID", "signature")
    if suffix in ("xlsx", "docx"):
        if not content.startswith(b"PK\x03\x04"):
            raise SourceFault("SOURCE_FORMAT_INVALID", "signature")
        names = set(open_zip(content).namelist())
        kinds = {"docx": "word/document.xml" in names, "xlsx": "xl/workbook.xml" in names}
        if sum(kinds.values()) != 1 or not kinds[suffix]:
            raise SourceFault("SOURCE_FORMAT_AMBIGUOUS" if sum(kinds.values()) == 2 else "SOURCE_FORMAT_INVALID", "package")


def parse_document(content: bytes, name: str, registry: dict | None = None) -> list[dict]:
    """Blocks of a file by its suffix, after the checks of size and signature."""
    suffix = name.rpartition(".")[2].lower() if "." in name else ""
    parser = (registry or REGISTRY).get(suffix)
    if parser is None:
        raise SourceFault("SOURCE_FORMAT_UNSUPPORTED", suffix)
    if len(content) > MOST_BYTES:
        raise SourceFault("SOURCE_LIMIT_EXCEEDED", "bytes")
    check_signature(content, suffix)
    return parser(content)
