"""Importing the modules registers their queries."""

from suite import files, places, profiles, records, runs, sources  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
