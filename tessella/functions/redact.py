"""Secrets taken out of texts and nested data.

A text is read once from left to right by one pattern that the JVM, Python and other SQL engines understand alike: at each
place it tells a header (to its line's end), a quoted assignment, a plain assignment or a query parameter, and masks the
value. User names in URLs go first, known values before that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a secret; words of names whose values are secrets; names of query parameters that are.
MASK = "[REDACTED]"
SENSITIVE = (
    "api key", "access token", "authorization", "bearer token", "client secret", "credential", "passwd", "password", "private key", "question text", "refresh token",
    "secret", "signature", "subscription key", "token",
)
QUERY_KEYS = ("access token", "api key", "auth", "client secret", "code", "credential", "key", "ocp apim subscription key", "password", "secret", "sig", "signature", "subscription key", "token")
#: Names whose values run to the end of their line; a sentence may speak of the others, so a name alone isn't one of these.
HEADERS = ("authorization", "subscription key")


def _names(names, between: str) -> str:
    return "|".join(n.replace(" ", between) for n in names)


_ASSIGNED = _names([n for n in SENSITIVE if n != "question text"], "[_-]?")
_PARAMETER = _names(QUERY_KEYS, r"(?:[-_.+]|%2[de]|%5f|%20)*")
_TO = r"[ \t]*[:=][ \t]*"
URL_USER = r"(?i)(://)[^/@\s]+@"
PATTERN = (
    "(?i)"
    rf"((?:{_names(HEADERS, '[_-]?')}){_TO})[^\r\n]+"
    rf"|((?:{_ASSIGNED})[a-z0-9_-]*\\[\"']{_TO}\\[\"'])[^\r\n]*?(\\[\"'])"
    rf"|((?:{_ASSIGNED})[a-z0-9_-]*[\"']?{_TO}\")[^\"]*(\")"
    rf"|((?:{_ASSIGNED})[a-z0-9_-]*[\"']?{_TO}')[^']*(')"
    rf"|((?:{_ASSIGNED})[a-z0-9_-]*{_TO})[^\s,;&#}}]+"
    rf"|([?&](?:{_PARAMETER}|[^=&\s]*%[4-7][0-9a-f][^=&\s]*)=)[^&#\s]+"
)
_BEFORE, _AFTER = (1, 2, 4, 6, 8, 9), (3, 5, 7)
_URL, _SCAN = re.compile(URL_USER), re.compile(PATTERN)
_KEY = re.compile(f"(?i)(?:{_names(SENSITIVE, '[_-]?')})")
_QUERY = frozenset(n.replace(" ", "") for n in QUERY_KEYS)


def replacement(mark: str) -> str:
    """What the pattern's matches become; ``mark`` is a dollar sign or a backslash, as the engine has it."""
    return "".join(f"{mark}{n}" for n in _BEFORE) + MASK + "".join(f"{mark}{n}" for n in _AFTER)


def is_sensitive_key(key: str) -> bool:
    return bool(_KEY.search(key))


def is_sensitive_query_key(key: str) -> bool:
    return re.sub(r"[-_.\s]+", "", unquote_plus(key)).casefold() in _QUERY


def _known(values) -> list[str]:
    return sorted(filter(None, values), key=len, reverse=True)


def redact_text(text: str | None, values: tuple[str, ...] = ()) -> str | None:
    """``text`` without headers, URL user names, assigned secrets, query secrets and the given values (longest first)."""
    if text is None:
        return None
    for value in _known(values):
        text = text.replace(value, MASK)
    return _SCAN.sub(replacement("\\"), _URL.sub(rf"\1{MASK}@", text))


def redact_data(value, values: tuple[str, ...] = ()):
    """Nested data with the values of sensitive keys masked and texts redacted."""
    match value:
        case str():
            return redact_text(value, values)
        case BaseException():
            return redact_error(value, values)
        case dict():
            return {k: MASK if isinstance(k, str) and is_sensitive_key(k) else redact_data(v, values) for k, v in value.items()}
        case list() | tuple() | set():
            return type(value)(redact_data(v, values) for v in value)
    return value


def _causes(error: BaseException) -> Iterator[BaseException]:
    told = []
    while error is not None and not any(error is e for e in told):
        told.append(error)
        yield error
        error = error.__cause__ or error.__context__


def redact_error(error: BaseException, values: tuple[str, ...] = ()) -> str:
    """An error and what caused it, outermost first, each by its class and its redacted text; a circle ends where it closes."""
    return " <- ".join(f"{type(e).__name__}: {redact_text(str(e), values)}" for e in _causes(error))


def strings_of(value) -> list[str]:
    """Every distinct text in nested data, keys left out, in order of appearance."""
    found: dict[str, None] = {}
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, str):
            found[value] = None
        elif isinstance(value, dict):
            left += reversed(value.values())
        elif isinstance(value, (list, tuple)):
            left += reversed(value)
    return list(found)


def redacted(text: Column, values: tuple[str, ...] = ()) -> Column:
    """``redact_text`` of a column, inside the JVM; nulls stay null."""
    for value in _known(values):
        text = F.replace(text, F.lit(value), F.lit(MASK))
    return F.regexp_replace(F.regexp_replace(text, URL_USER, f"$1{MASK}@"), PATTERN, replacement("$"))


def redacted_json(document: Column, values: tuple[str, ...] = ()) -> Column:
    """Arrow function over a JSON column; what is no JSON is redacted as text."""

    def one(text):
        try:
            return json.dumps(redact_data(json.loads(text), values), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return redact_text(text, values)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "string")(document)


def json_strings(document: Column) -> Column:
    """Arrow function: the distinct texts in a JSON column; null and what is no JSON give none."""

    def one(text):
        try:
            return strings_of(json.loads(text))
        except (TypeError, ValueError):
            return []

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "array<string>")(document)
