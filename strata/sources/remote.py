"""Reading tables and queries of other databases over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """How to read in parallel: ranges of a numeric, date or timestamp column."""

    column: str
    parts: int
    lower: str | int | None = None
    upper: str | int | None = None


def remote_options(url: str, source: str, split: Split | None = None, **options: str) -> dict[str, str]:
    """Options of the JDBC reader. A `source` with a blank in it is a query, else a table name."""
    text = source.strip().rstrip(";").rstrip()
    table = f"({text}) remote_query" if any(ch.isspace() for ch in text) else text
    settings = {"url": url, "dbtable": table, **options}
    if split is not None:
        if split.lower is None or split.upper is None:
            raise ValueError("a split needs both bounds; read_remote looks them up")
        settings |= {
            "partitionColumn": split.column,
            "numPartitions": str(split.parts),
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
        }
    return settings


def bounds_query(source: str, column: str) -> str:
    text = source.strip().rstrip(";").rstrip()
    table = f"({text}) remote_query" if any(ch.isspace() for ch in text) else text
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"


def read_remote(
    spark: SparkSession, url: str, source: str, split: Split | None = None, **options: str
) -> DataFrame:
    """A remote table or query as DataFrame; with `split` it is read by several tasks.

    Bounds only set the stride of the ranges, rows outside them are read too. Missing bounds
    are asked from the database in one one-row query.
    """
    if split is not None and (split.lower is None or split.upper is None):
        ends = spark.read.format("jdbc").options(
            **remote_options(url, bounds_query(source, split.column), **options)
        ).load().first()
        if ends is None or ends[0] is None:
            split = None
        else:
            split = Split(split.column, split.parts, ends[0], ends[1])
    return spark.read.format("jdbc").options(**remote_options(url, source, split, **options)).load()
