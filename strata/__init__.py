"""strata: layered SQL work on Spark (imports, bronze/silver/gold, edits, checks, lineage, search)."""

from strata.session import Workbench, open_workbench

__all__ = ["Workbench", "open_workbench"]
