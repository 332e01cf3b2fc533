"""Which columns of a set of tables hold values of which others: all pairs at once, without joining tables in pairs.

Every column is counted by value once. A value's columns form a set, and values with the same set are added up, so what is paired are columns
inside the few sets that occur, never rows. A value that fills a column is one row behind the map-side count, however often it is there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.values import value_text
from strata.session import cut

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _kind(dtype: T.DataType) -> str | None:
    """Types whose values are compared with one another; None for those that are left out."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, _TIMES):
        return "time"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "text" if isinstance(dtype, T.StringType | T.CharType | T.VarcharType) else None


def value_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """kind, value, column (`table.column`) and n of the non-null values of the tables, NaN and infinities left out."""
    parts = []
    for name, df in tables.items():
        chosen = [f for f in df.schema.fields if _kind(f.dataType) and (columns is None or f.name in columns.get(name, []))]
        entries: list[Column] = [
            F.struct(F.lit(_kind(f.dataType)).alias("kind"), value_text(F.col(f"`{f.name}`"), f.dataType).alias("value"), F.lit(f"{name}.{f.name}").alias("column"))
            for f in chosen
        ]
        if entries:
            parts.append(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("value IS NOT NULL AND value NOT IN ('NaN', 'Infinity', '-Infinity')"))
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "value", "column").agg(F.count(F.lit(1)).alias("n"))


def column_sets(counts: DataFrame) -> DataFrame:
    """columns (a sorted set), found (the values with just these columns), and per column its rows with such values and the most rows of one."""
    per_value = counts.groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("column", "n"))).alias("held"))  # a row per column at most
    columns = F.transform("held", lambda h: h["column"])
    long = per_value.select(columns.alias("columns"), F.explode("held").alias("h")).select("columns", "h.column", "h.n")
    sums = long.groupBy("columns", "column").agg(F.count(F.lit(1)).alias("found"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    return sums.groupBy("columns").agg(
        F.max("found").alias("found"), F.sort_array(F.collect_list(F.struct("column", "rows", "most"))).alias("held")
    )


def inclusions(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, least_share: float = 1.0) -> DataFrame:
    """child, parent, relationship, share, n_distinct, n_shared, n_child, n_matched of every pair of columns of one kind.

    `share` is that of the child's distinct values that the parent has; pairs below `least_share`, and pairs without a common value, are left out. `n_child`
    and `n_matched` count the child's rows with a value, and those whose value the parent has. The relationship is that of
    `profile.relationship_profile`: how often a value occurs at most on either side.
    """
    sets = cut(column_sets(value_counts(tables, columns)), "sets")
    single = sets.select("found", F.explode("held").alias("h"))
    totals = single.groupBy(F.col("h.column").alias("column")).agg(
        F.sum("found").alias("n_distinct"), F.sum("h.rows").alias("n_rows"), F.max("h.most").alias("most")
    )
    totals = cut(totals, "totals")
    # Pairs inside a set: columns times columns for each set that occurs.
    pairs = sets.select("found", F.explode("held").alias("child"), F.col("held").alias("others")).select(
        "found", "child", F.explode(F.filter("others", lambda o: o["column"] != F.col("child.column"))).alias("parent")
    )
    shared = pairs.groupBy(F.col("child.column").alias("child"), F.col("parent.column").alias("parent")).agg(
        F.sum("found").alias("n_shared"), F.sum("child.rows").alias("n_matched")
    )
    child = totals.select(F.col("column").alias("child"), "n_distinct", F.col("n_rows").alias("n_child"), F.col("most").alias("most_child"))
    parent = totals.select(F.col("column").alias("parent"), F.col("most").alias("most_parent"))
    many_child, many_parent = F.col("most_child") > 1, F.col("most_parent") > 1
    kind = (
        F.when(many_child & many_parent, "many-to-many")
        .when(many_child, "many-to-one")
        .when(many_parent, "one-to-many")
        .otherwise("one-to-one")
    )
    # At most one row per column on either side.
    joined = shared.join(child, "child").join(parent, "parent").withColumn("share", F.round(F.col("n_shared") / F.col("n_distinct"), 6))
    return joined.where(F.col("n_shared") >= F.lit(least_share) * F.col("n_distinct")).select(
        "child", "parent", kind.alias("relationship"), "share", "n_distinct", "n_shared", "n_child", "n_matched"
    )
