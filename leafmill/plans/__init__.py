"""The operators applied to the given tables, each with its SQL restatement."""

from . import browse, quality, retrieval, writes
from .base import ORACLES, QUERIES

assert browse and quality and retrieval and writes  # the imports fill the registry

__all__ = ["ORACLES", "QUERIES"]
