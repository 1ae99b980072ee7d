"""Queries of this subpackage and the SQL they are compared with; a module that is missing is an error."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lookalikes", "near_duplicates", "splitting", "scan_noise", "survivor", "tokenizer", "packing", "quality")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tessella.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
