"""Content-addressed identity: canonical JSON, stable ids, aliases, slugs and section paths."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERED = re.compile(r"^(?:q|question)?0*([0-9]+)$")


def canonical_json(value) -> str:
    """Sorted keys, compact, ASCII: equal data, equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def stable_id(namespace: str, value) -> str:
    return f"{namespace}:{hashlib.sha256(canonical_json(value).encode()).hexdigest()}"


def slug(text: str) -> str:
    """Letters and digits of the compatibility form, case folded; other runs a hyphen."""
    folded = unicodedata.normalize("NFKC", text).strip().casefold()
    return "-".join("".join(c if c.isalnum() else " " for c in folded).split())


def alias(text: str) -> str:
    """A printed id in one form: 1, Q01, question 1 and Column Q1 are all q1; anything else is its slug."""
    folded = unicodedata.normalize("NFKC", text).strip().casefold()
    for prefix in ("column", "col"):
        rest = folded.removeprefix(prefix)
        if rest != folded and rest[:1] in (" ", ".", "_", "-", ":") and rest.strip(" ._-:"):
            folded = rest.strip(" ._-:")
            break
    found = _NUMBERED.match(re.sub(r"[\s._-]+", "", folded))
    return f"q{int(found[1])}" if found else slug(folded)


def section_path(parts) -> str:
    """Slugs of a section path joined by a stroke; ``root`` for none."""
    return "/".join(slug(p) for p in (() if parts is None else parts)) or "root"


def quote_text(text: str, fold: bool = True) -> str:
    """Compatibility form with blanks made single, case folded unless told not to."""
    plain = " ".join(unicodedata.normalize("NFKC", text).split())
    return plain.casefold() if fold else plain


def _column(function, kind: str = "string"):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return lambda column: F.pandas_udf(run, kind)(column)


slug_of = _column(slug)
alias_of = _column(alias)
section_of = _column(section_path)
quote_of = _column(quote_text)
canonical_of = _column(lambda text: canonical_json(json.loads(text)))


def alias_ascii(text: Column) -> Column:
    """``alias`` for ASCII names, inside the JVM."""
    low = F.lower(F.trim(text))
    bare = F.regexp_replace(low, r"^(column|col)[ ._:-]+(?=[^ ._:-])", "")
    close = F.regexp_replace(bare, r"[ \t._-]+", "")
    number = F.regexp_extract(close, r"^(?:q|question)?0*([0-9]+)$", 1)
    plain = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(number != "", F.concat(F.lit("q"), number)).otherwise(plain)


def slug_ascii(text: Column) -> Column:
    """``slug`` for ASCII names, inside the JVM."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def json_string(text: Column) -> Column:
    """An ASCII text as a JSON string."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def canonical_object(**fields: Column) -> Column:
    """A canonical JSON object of columns that are JSON texts already, its keys sorted."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def stable_id_of(namespace: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{namespace}:"), F.sha2(canonical, 256))
