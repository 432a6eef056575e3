"""The registered queries and, where SQL can say the same, their reference SQL."""

from . import aggregates, files, learned, ordering, projections, streams, types  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
