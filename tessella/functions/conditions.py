"""Logical conditions of questionnaire flow: parsing, shape, normal form, and the values a condition covers.

A condition is JSON: {"op": ..., "item": ..., "value": {"t": type, "s": text}, "values": [...], "children": [...], "raw": ...}.
Values carry their type, so 1, "1" and true differ.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.identity import canonical_json

#: Operators by what they need, and limits of a condition.
WITHOUT_VALUE = ("always", "answered", "not_answered")
WITH_VALUE = ("equals", "not_equals", "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal", "selected", "not_selected")
WITH_VALUES = ("in_set", "not_in_set", "between")
WITH_CHILDREN = ("all", "any", "not")
COMPARISONS = {"=": "equals", "!=": "not_equals", ">=": "greater_than_or_equal", "<=": "less_than_or_equal", ">": "greater_than", "<": "less_than"}
MOST_DEPTH, MOST_NODES = 6, 100

_ITEM = r"\$\{\s*([A-Za-z_][\w.-]*)\s*\}"
_COMPARE = re.compile(rf"^{_ITEM}\s*(!=|>=|<=|=|>|<)\s*(.+)$", re.S)
_SELECTED = re.compile(rf"^selected\s*\(\s*{_ITEM}\s*,\s*(.+?)\s*\)$", re.S)
_NOT = re.compile(r"^not\s*\((.*)\)$", re.S)


def literal(text: str) -> dict | None:
    """A typed value: quoted text, whole number, decimal, true() or false(); None for anything else."""
    text = text.strip()
    if len(text) >= 2 and text[0] in "'\"" and text[-1] == text[0] and text[0] not in text[1:-1]:
        return {"t": "str", "s": text[1:-1]}
    if re.fullmatch(r"[-+]?\d+", text):
        return {"t": "int", "s": str(int(text))}
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)", text):
        return {"t": "float", "s": repr(float(text))}
    if text in ("true()", "false()"):
        return {"t": "bool", "s": text[:-2]}
    return None


def _marks(text: str) -> Iterator[tuple[int, int]]:
    """(position, depth) of characters outside quotes; a bracket counts from its opening on. Depth -1 marks a fault."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
            continue
        if c in "'\"":
            quote = c
            continue
        depth += (c == "(") - (c == ")")
        yield i, depth
    if quote or depth:
        yield len(text), -1


def _balanced(text: str) -> bool:
    return all(d >= 0 for _, d in _marks(text))


def _split(text: str, word: str) -> list[str]:
    """Parts between ``word`` standing alone outside brackets and quotes."""
    outside = {i for i, d in _marks(text) if d == 0}
    cuts = [m.span(1) for m in re.finditer(rf"\s({word})\s", text) if m.start(1) in outside]
    edges = [0, *(x for cut in cuts for x in cut), len(text)]
    return [text[a:b].strip() for a, b in zip(edges[::2], edges[1::2])]


def _bare(text: str) -> str:
    """Without brackets around the whole."""
    text = text.strip()
    while text.startswith("(") and text.endswith(")") and _balanced(text[1:-1]):
        text = text[1:-1].strip()
    return text


def parse(expression: str, known: frozenset[str] | None = None) -> dict:
    """The condition of an expression; ``opaque`` where any part of it can't be told."""
    found = _parse(_bare(expression), known) if _balanced(expression) else None
    return found or {"op": "opaque", "raw": expression}


def _parse(text: str, known) -> dict | None:
    for word, op in (("or", "any"), ("and", "all")):
        parts = _split(text, word)
        if len(parts) > 1:
            children = [_parse(_bare(p), known) for p in parts]
            return {"op": op, "children": children, "raw": text} if all(children) else None
    if (m := _NOT.match(text)) and _balanced(m[1]):
        child = _parse(_bare(m[1]), known)
        if child and child["op"] == "selected":
            return child | {"op": "not_selected", "raw": text}
        return {"op": "not", "children": [child], "raw": text} if child else None
    if m := _SELECTED.match(text):
        item, op, value = m[1], "selected", literal(m[2])
    elif m := _COMPARE.match(text):
        item, op, value = m[1], COMPARISONS[m[2]], literal(m[3])
        if value == {"t": "str", "s": ""} and op in ("equals", "not_equals"):
            return {"op": "not_answered" if op == "equals" else "answered", "item": item, "raw": text} if known is None or item in known else None
    else:
        return None
    if value is None or known is not None and item not in known:
        return None
    return {"op": op, "item": item, "value": value, "raw": text}


def walk(condition: dict, depth: int = 1) -> Iterator[tuple[dict, int]]:
    yield condition, depth
    for child in condition.get("children") or ():
        yield from walk(child, depth + 1)


def faults(condition: dict) -> list[str]:
    """What is wrong with a condition's shape."""
    out = []
    nodes = list(walk(condition))
    if len(nodes) > MOST_NODES:
        out.append("too_many_nodes")
    if max(d for _, d in nodes) > MOST_DEPTH:
        out.append("too_deep")
    for node, _ in nodes:
        op, children, values = node.get("op"), node.get("children") or [], node.get("values") or []
        right = {
            **{o: node.get("value") is None and not values and not children and (o == "always") == (node.get("item") is None) for o in WITHOUT_VALUE},
            **{o: node.get("value") is not None and node.get("item") is not None and not values and not children for o in WITH_VALUE},
            **{o: node.get("item") is not None and node.get("value") is None and not children and (len(values) == 2 if o == "between" else len(values) >= 1) for o in WITH_VALUES},
            "all": len(children) >= 2,
            "any": len(children) >= 2,
            "not": len(children) == 1,
            "opaque": bool(node.get("raw")) and not children,
        }.get(op)
        if right is None:
            out.append("unknown_operator")
        elif not right:
            out.append(f"shape_{op}")
    return sorted(set(out))


def normal_form(condition: dict | None):
    """Data that is equal for conditions meaning the same: no raw text, children and sets in order; opaque text kept."""
    if condition is None:
        return None
    if condition["op"] == "opaque":
        return {"op": "opaque", "raw": " ".join((condition.get("raw") or "").split())}
    out = {k: condition[k] for k in ("op", "item", "value") if condition.get(k) is not None}
    if condition.get("values"):
        out["values"] = condition["values"] if condition["op"] == "between" else sorted(condition["values"], key=canonical_json)
    if condition.get("children"):
        children = [normal_form(c) for c in condition["children"]]
        out["children"] = sorted(children, key=canonical_json) if condition["op"] in ("all", "any") else children
    return out


def covered(condition: dict | None, domain: frozenset) -> tuple[str, frozenset] | None:
    """(item, typed values) that a condition certainly lets pass, of an item with a known ``domain``; None if unproven."""
    if condition is None:
        return None
    op, item = condition["op"], condition.get("item")
    value = condition.get("value")
    single = frozenset([(value["t"], value["s"])]) if value else frozenset()
    several = frozenset((v["t"], v["s"]) for v in condition.get("values") or ())
    if op == "equals":
        return item, single
    if op == "in_set":
        return item, several
    if op == "not_equals":
        return item, domain - single
    if op == "not_in_set":
        return item, domain - several
    children = [covered(c, domain) for c in condition.get("children") or ()]
    if op in ("any", "all") and all(children) and len({c[0] for c in children}) == 1:
        sets = [c[1] for c in children]
        return children[0][0], frozenset.union(*sets) if op == "any" else frozenset.intersection(*sets)
    if op == "not" and children[0]:
        return children[0][0], domain - children[0][1]
    return None


def parsed(expression: Column, known: Column | None = None) -> Column:
    """Arrow function: expression text (and an array of known names) to condition JSON; null stays null."""

    def alone(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(parse(t), ensure_ascii=False))

    def among(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(parse(t, frozenset(n if n is not None else ())), ensure_ascii=False) for t, n in zip(texts, names)], dtype=object)

    return F.pandas_udf(alone, "string")(expression) if known is None else F.pandas_udf(among, "string")(expression, known)


def condition_key(condition: Column) -> Column:
    """Arrow function: canonical JSON of a condition's normal form; ``null`` for none."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical_json(normal_form(json.loads(t))) if t is not None else "null")

    return F.pandas_udf(run, "string")(condition)


def condition_faults(condition: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else faults(json.loads(t)))

    return F.pandas_udf(run, "array<string>")(condition)


def condition_items(condition: Column) -> Column:
    """Arrow function: the distinct items a condition refers to, in order of appearance."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else list(dict.fromkeys(n["item"] for n, _ in walk(json.loads(t)) if n.get("item"))))

    return F.pandas_udf(run, "array<string>")(condition)
