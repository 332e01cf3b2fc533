"""Relationships between tables: declared, inferred and custom ones.

Catalog columns are ``table_schema``, ``table_name``, ``column_name``. Edges are ``source`` and
``target`` (``schema.table``) with ``source_column`` and ``target_column``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.spread import HOT_ROWS, spread_join

EDGE = ["source", "source_column", "target", "target_column"]


def _table_id(schema: str, table: str) -> Column:
    return F.concat_ws(".", schema, table)


def declared_relationships(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Foreign keys whose both columns exist, as edges.

    `foreign_keys`: table_schema, table_name, column_name, foreign_schema, foreign_table,
    foreign_column.
    """
    edges = foreign_keys.select(
        _table_id("table_schema", "table_name").alias("source"),
        F.col("column_name").alias("source_column"),
        _table_id("foreign_schema", "foreign_table").alias("target"),
        F.col("foreign_column").alias("target_column"),
    )
    return existing_edges(columns, edges).distinct()


def existing_edges(columns: DataFrame, edges: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Edges whose both ends are columns of the catalog."""
    known = columns.select(_table_id("table_schema", "table_name").alias("t"), F.col("column_name").alias("c")).distinct()
    ends = lambda side: known.select(F.col("t").alias(side), F.col("c").alias(f"{side}_column"))
    # Many edges may share a target, such as the key of one central table.
    kept = spread_join(edges, ends("target"), ["target", "target_column"], "left_semi", min_rows)
    return kept.join(ends("source"), ["source", "source_column"], "left_semi").select(*edges.columns)


def inferred_relationships(
    columns: DataFrame, foreign_keys: DataFrame | None = None, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Edges guessed from names: ``x_id`` refers to table x, xs or xes with an ``id`` or ``x_id``.

    Tables with declared foreign keys are left to those. The first fitting key column, by
    position, is the target. Names count without regard to case; a column is listed once.
    """
    c, t = F.col("c"), F.col("t")
    cols = columns.select(
        _table_id("table_schema", "table_name").alias("table_id"),
        F.lower("table_name").alias("t"), "column_name", F.lower("column_name").alias("c"), "ordinal",
    )
    cut_end = lambda s, n: F.substring(s, F.lit(1), F.length(s) - n)
    sources = cols.where(c.endswith("_id"))
    if foreign_keys is not None:
        declared = foreign_keys.select(_table_id("table_schema", "table_name").alias("table_id")).distinct()
        sources = sources.join(declared, "table_id", "left_anti")
    wanted = sources.select(
        F.col("table_id").alias("source"), F.col("column_name").alias("source_column"), cut_end(c, 3).alias("base")
    )
    # Target side: each base a table name can stand for, with the table's first column called id
    # or <base>_id; one row per (table, base). So only the base has to match.
    stems = F.array(t, F.when(t.endswith("s"), cut_end(t, 1)), F.when(t.endswith("es"), cut_end(t, 2)))
    offers = (
        cols.where((c == "id") | c.endswith("_id"))
        .withColumn("base", F.explode(F.array_compact(stems)))
        .where((c == "id") | (c == F.concat(F.col("base"), F.lit("_id"))))
        .groupBy("table_id", "base")
        .agg(F.min_by("column_name", "ordinal").alias("target_column"))
        .withColumnRenamed("table_id", "target")
    )
    found = spread_join(wanted, offers, ["base"], "inner", min_rows)
    return found.where(F.col("source") != F.col("target")).select(*EDGE)


def key_flags(columns: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """Columns with the flags ``likely_pk`` and ``likely_fk``.

    Where a table declares foreign keys these decide, elsewhere the ``_id`` ending does.
    """
    c, t = F.lower("column_name"), F.lower("table_name")
    pk = (c == "id") | (c == F.concat(t, F.lit("_id"))) | (c == F.concat(t, F.lit("id")))
    guess = c.endswith("_id")
    if foreign_keys is None:
        return columns.withColumn("likely_pk", pk).withColumn("likely_fk", guess)
    key = ["table_schema", "table_name"]
    declared = foreign_keys.select(*key, "column_name").distinct().withColumn("_fk", F.lit(True))
    tables = foreign_keys.select(*key).distinct().withColumn("_has", F.lit(True))
    joined = columns.join(declared, [*key, "column_name"], "left").join(tables, key, "left")
    fk = F.when(F.col("_has"), F.coalesce("_fk", F.lit(False))).otherwise(guess)
    return joined.withColumn("likely_pk", pk).withColumn("likely_fk", fk).select(
        *columns.columns, "likely_pk", "likely_fk"
    )


def relationship_union(columns: DataFrame, detected: DataFrame, custom: DataFrame) -> DataFrame:
    """Detected and custom edges; custom ones with a missing end or already detected are dropped."""
    kept = existing_edges(columns, custom.select(*EDGE)).withColumn("custom", F.lit(True))
    both = detected.select(*EDGE).withColumn("custom", F.lit(False)).unionByName(kept)
    return both.groupBy(*EDGE).agg(F.bool_and("custom").alias("custom"))


def relationship_add(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add custom edges whose four fields are not there yet."""
    fresh = new.select(*EDGE).distinct().join(existing.select(*EDGE).distinct(), EDGE, "left_anti")
    return existing.select(*EDGE).unionByName(fresh)


def relationship_remove(existing: DataFrame, gone: DataFrame) -> DataFrame:
    return existing.select(*EDGE).join(gone.select(*EDGE).distinct(), EDGE, "left_anti")


def _weights(c: Column) -> list[Column]:
    """Four 60-bit numbers from the SHA-256 of a text."""
    digest = F.sha2(c, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]


def graph_signature(nodes: DataFrame, edges: DataFrame, node_id: str = "id") -> DataFrame:
    """Fingerprint of a graph: equal sets of nodes and edges give equal text, in any order.

    Each element adds its hash numbers to four sums, so parts of the graph are summed where they
    lie and nothing is gathered or sorted. Duplicates count once.
    """
    items = (
        nodes.select(F.lit("n").alias("kind"), F.col(node_id).alias("item"))
        .unionByName(edges.select(F.lit("e").alias("kind"), F.concat_ws("|", *EDGE).alias("item")))
        .distinct()
    )
    weights = _weights(F.concat_ws(":", "kind", "item"))
    sums = [F.coalesce(F.sum(w.cast("decimal(38,0)")), F.lit(0)).cast("string") for w in weights]
    return items.agg(
        F.count_if(F.col("kind") == "n").alias("n_nodes"),
        F.count_if(F.col("kind") == "e").alias("n_edges"),
        F.concat_ws("-", *sums).alias("signature"),
    )
