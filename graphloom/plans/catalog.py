"""All registered queries of the graph operators, with their SQL."""

from __future__ import annotations

import importlib

from graphloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "D1_D2_D3_D4_beam_3hop"
for _name in ("access", "traversal", "rules", "analytics", "text", "more"):
    importlib.import_module(f"graphloom.plans.{_name}_queries")

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
