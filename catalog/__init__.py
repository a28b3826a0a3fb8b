"""Every operator bound to the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from catalog.common import ORACLES, QUERIES
from catalog import entities, graph, keywords, questions, search, sources, text, verify  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
