"""Connected components of a stored edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import counted, cut


def components(edges: DataFrame) -> DataFrame:
    """`node, comp` for every node of `edges` (a < b) that is not the smallest of its component.

    Each round hangs every node below its smallest smaller neighbour, shortens the paths to the roots by
    doubling and contracts the edges; a star takes one round. Every step is stored, so a lost executor costs one step.
    """
    mapping: DataFrame | None = None
    given = edges
    while True:
        parent, found = counted(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")), "parents")
        if not found:
            break
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            longer, moved = counted(
                parent.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("moved")),
                "parents", F.col("moved"),
            )
            parent = longer.select("node", "comp")
            if not moved:
                break
        if mapping is None:
            mapping = parent
        else:
            mapping = cut(_relabel(mapping, parent, "comp").unionByName(parent), "components")
        ends = _relabel(_relabel(edges, parent, "a"), parent, "b").where("a <> b")
        edges, left = counted(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if not left:
            break
    if mapping is None:
        return given.select(F.col("b").alias("node"), F.col("a").alias("comp")).limit(0)
    return mapping


def _relabel(df: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    new = parent.select(F.col("node").alias(column), F.col("comp").alias("__new"))
    return df.join(new, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
