"""Registered queries over the driver tables, each with its SQL counterpart."""

from areaindex.registry import indicators, outputs, relational, spatial  # noqa: F401
from areaindex.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
