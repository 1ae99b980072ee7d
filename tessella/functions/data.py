"""Nested data: merged, compared, flattened, and schemas made strict."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class OpenSchema(ValueError):
    """A schema that leaves open what an answer may hold."""


def without_none(value):
    """Objects without the members that are None, at every depth; lists keep theirs."""
    return {k: without_none(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else value


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: objects on both sides are merged, anything else is replaced; None leaves what is there."""
    over = without_none(over)
    return {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in (base | over).items()}


def same_data(left, right) -> bool:
    """Equal with types, lengths and the order of keys: 1, 1.0 and true differ, as do objects that name members in another order."""
    if type(left) is not type(right):
        return False
    if isinstance(left, dict):
        return list(left) == list(right) and all(same_data(left[k], right[k]) for k in left)
    if isinstance(left, list):
        return len(left) == len(right) and all(map(same_data, left, right))
    return left == right


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(pointer, value) of everything in nested data that isn't an object or a list; empty ones are leaves themselves."""
    if isinstance(value, (dict, list)) and value:
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
            yield from leaves(inner, f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}")
    else:
        yield path, value


#: Words of a schema that only describe, and those under which names are free.
_NOTES = ("title", "description", "default", "examples")
_NAMED = ("properties", "$defs", "definitions")


def strict_schema(schema):
    """A JSON schema in which every object names all its members: all required, none besides; notes dropped.

    An object that leaves its members open, or a part that takes anything, is refused.
    """
    if isinstance(schema, list):
        return [strict_schema(s) for s in schema]
    if not isinstance(schema, dict):
        return schema
    if schema.get("additionalProperties") not in (None, False) or schema.get("patternProperties"):
        raise OpenSchema("members that aren't named")
    if not set(schema) - set(_NOTES):
        raise OpenSchema("a part that takes anything")
    if schema.get("type") == "object" and not schema.get("properties"):
        raise OpenSchema("an object without members")
    out = {}
    for key, value in schema.items():
        if key in _NAMED and isinstance(value, dict):
            out[key] = {name: strict_schema(part) for name, part in value.items()}
        elif key not in _NOTES:
            out[key] = strict_schema(value) if isinstance(value, (dict, list)) and key not in ("required", "enum", "const", "type") else value
    if "properties" in out:
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


def _pairwise(function, kind: str):
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else function(json.loads(a), json.loads(b)) for a, b in zip(left, right)], dtype=object)

    return lambda left, right: F.pandas_udf(run, kind)(left, right)


_same = _pairwise(same_data, "boolean")
_merged = _pairwise(lambda a, b: json.dumps(deep_merge(a, b), ensure_ascii=False, separators=(",", ":")), "string")


def same_json(left: Column, right: Column) -> Column:
    """Arrow function: ``same_data`` of two JSON columns; null if either is."""
    return _same(left, right)


def merged_json(base: Column, over: Column) -> Column:
    """Arrow function: ``deep_merge`` of two JSON columns; null if either is."""
    return _merged(base, over)


def json_leaves(document: Column) -> Column:
    """Arrow function: the leaves of a JSON column as an array of (path, value as JSON)."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"path": p, "value": json.dumps(v, ensure_ascii=False)} for p, v in leaves(json.loads(t))])

    return F.pandas_udf(run, "array<struct<path string, value string>>")(document)
