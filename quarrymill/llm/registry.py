"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: In this order the queries are registered.
MODULES = ["q_distinct", "q_ledger", "q_packing", "q_percentiles", "q_leaks", "q_personal"]
QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    try:
        _m = importlib.import_module(f"quarrymill.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"quarrymill.llm.{_name}":
            raise
        continue
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
