"""All queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("graph", "records", "program", "more", "rules", "conditions"):
    _module = import_module(f"graphloom.queries.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
