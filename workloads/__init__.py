"""The registered queries, each with the SQL that checks it."""

from workloads import catalog, corpus, edits, files, grid, integrity, lineage, scalars, sqltext, streams  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
