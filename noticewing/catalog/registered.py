"""All registered queries."""

from noticewing.catalog import core, geodesy, landing, learning  # noqa: F401  (they register on import)
from noticewing.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
