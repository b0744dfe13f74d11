"""All registered queries and their SQL."""

from __future__ import annotations

from quillspark.queries import detection, loops, prose, stylometry, writing
from quillspark.queries.base import ORACLE, QUERIES

MODULES = (prose, detection, stylometry, writing, loops)

__all__ = ["MODULES", "ORACLE", "QUERIES"]
