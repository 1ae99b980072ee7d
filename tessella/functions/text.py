"""Text functions as Spark columns; none leaves the JVM but where it says so."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks that ``trim_blank`` and ``squeeze`` know, in classes that every SQL engine reads alike.
ASCII_BLANK = r"[ \t\n\r\f\x0b]"


def squeeze(text: Column) -> Column:
    """Runs of any Unicode white space made one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeeze_ascii(text: Column) -> Column:
    """Runs of ASCII white space made one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{ASCII_BLANK}+", " "))


def trim_blank(text: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.regexp_replace(text, f"^{ASCII_BLANK}+|{ASCII_BLANK}+$", "")


def similarity_text(text: Column) -> Column:
    """Lower-case a-z and 0-9, every other run a blank: what token sets are made of."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def signature(raw_name: Column, question: Column, label: Column, data_type: Column) -> Column:
    """What makes two records the same variable: name, compared text and type."""
    return F.struct(F.lower(raw_name).alias("name"), similarity_text(first_filled(question, label)).alias("text"), data_type.alias("type"))


def escape_cell(cell: Column) -> Column:
    """A table cell with backslash, carriage return, line feed and bar escaped, in this order."""
    out = F.coalesce(cell, F.lit(""))
    for plain, escaped in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("|", "\\|")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def render_row(row: Column) -> Column:
    return F.array_join(F.transform(row, escape_cell), " | ")


def render_table(rows: Column) -> Column:
    """Rows on lines, cells joined by a bar."""
    return F.array_join(F.transform(rows, render_row), "\n")


def trim_trailing_cells(row: Column) -> Column:
    """A row up to its last cell that isn't blank."""
    filled = F.transform(row, lambda c, i: F.when(F.length(squeeze(F.coalesce(c, F.lit("")))) > 0, i + 1).otherwise(0))
    return F.slice(row, 1, F.coalesce(F.array_max(filled), F.lit(0)))


def byte_estimate(text: Column) -> Column:
    """The conservative token estimate: bytes of UTF-8."""
    return F.coalesce(F.octet_length(text), F.lit(0))


def is_heading(paragraph: Column) -> Column:
    """One line of at most 120 characters that begins with section or module, or has at most 12 words, all capitals."""
    words = F.size(F.split(squeeze_ascii(paragraph), " "))
    capitals = (F.upper(paragraph) == paragraph) & (F.lower(paragraph) != paragraph)
    return ~F.contains(paragraph, F.lit("\n")) & (F.length(paragraph) <= 120) & (paragraph.rlike(r"(?i)^(section|module)\b") | (capitals & (words <= 12)))


def cell_reference(reference: Column) -> tuple[Column, Column]:
    """(column, row) of a spreadsheet reference such as AB12; nulls where it is none."""
    letters = F.regexp_extract(F.upper(reference), r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})$", 1)
    row = F.regexp_extract(F.upper(reference), r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})$", 2)
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    return F.when(letters != "", column), F.when(letters != "", row.try_cast("int"))


def source_format(name: Column, media_type: Column) -> Column:
    """The suffix of a file name, else the last part of its media type."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)), F.lit("")), F.substring_index(media_type, "/", -1))


def tagged_scalar(literal: Column) -> Column:
    """A form literal as (t, s): quoted text, int, float, true() or false(); null for anything else."""
    text = F.trim(literal)
    quoted = text.rlike(r"^'[^']*'$") | text.rlike(r'^"[^"]*"$')
    return (
        F.when(quoted, F.struct(F.lit("str").alias("t"), F.regexp_replace(text, r"^['\"]|['\"]$", "").alias("s")))
        .when(text.rlike(r"^[-+]?[0-9]+$"), F.struct(F.lit("int").alias("t"), F.regexp_replace(text, r"^\+", "").alias("s")))
        .when(text.rlike(r"^[-+]?([0-9]+\.[0-9]*|\.[0-9]+)$"), F.struct(F.lit("float").alias("t"), text.alias("s")))
        .when(text.rlike(r"^(true|false)\(\)$"), F.struct(F.lit("bool").alias("t"), F.regexp_replace(text, r"\(\)$", "").alias("s")))
    )


def pointer_path(pointer: str) -> str:
    """A JSON pointer as the path that get_json_object reads."""
    if pointer == "":
        return "$"
    parts = (p.replace("~1", "/").replace("~0", "~") for p in pointer.lstrip("/").split("/"))
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def json_pointer(document: Column, pointer: str) -> Column:
    return F.get_json_object(document, pointer_path(pointer))


def excerpt(text: Column, limit: int) -> Column:
    """Printable text of at most ``limit`` characters."""
    return F.substring(squeeze(F.regexp_replace(text, r"\p{Cntrl}", " ")), 1, limit)


def fallback_survey(name: Column, extracted: Column) -> tuple[Column, Column]:
    """(survey id, survey name) where a source names none."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.concat(F.lit("UNK_"), F.year(extracted).cast("string"), F.lit("_SURVEY")), F.initcap(F.trim(F.regexp_replace(stem, "[_-]+", " ")))


def _model_json(texts: pd.Series) -> pd.Series:
    hidden = ("Cc", "Cf", "Co", "Cs", "Zl", "Zp")

    def escape(text):
        if text is None or text.isascii() and text.isprintable():
            return text
        return "".join("".join(f"\\u{u:04x}" for u in _utf16(c)) if unicodedata.category(c) in hidden else c for c in text)

    return texts.map(escape)


def _utf16(char: str) -> list[int]:
    raw = char.encode("utf-16-be", "surrogatepass")
    return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]


def escape_invisible(text: Column) -> Column:
    """JSON text with invisible characters written as escapes (an Arrow function, as the escape depends on the character)."""
    return F.pandas_udf(_model_json, "string")(text)
