"""Running read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statements Spark runs but does not accept inside a FROM clause.
BARE = re.compile(r"^\s*(SHOW|DESCRIBE|DESC|EXPLAIN)\b", re.IGNORECASE)
# What a text is made of, as far as its end is concerned: literals and quoted names, comments, the rest.
PIECE = re.compile(
    r"""(?P<solid>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[^\s;'"`/-]+)|(?:--[^\n\r]*|/\*(?!\+).*?\*/|[\s;]+)|(?P<sign>.)""",
    re.DOTALL,
)


def strip_statement(sql: str) -> str:
    """The statement without the blanks, semicolons and comments behind it; those in literals stay."""
    end = 0
    for piece in PIECE.finditer(sql):
        if piece["solid"] is not None or piece["sign"] is not None:
            end = piece.end()
    return sql[:end].strip()


def analyze(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a query; nothing is stored.

    The text goes into a FROM clause, where only a query parses. A statement that would change
    something is therefore refused by Spark's own parser before it runs, and a literal or column
    that happens to be called ``update`` does no harm.
    """
    text = strip_statement(sql)
    if BARE.match(text):
        return spark.sql(text)
    return spark.sql(f"SELECT * FROM (\n{text}\n)")


def own_limit(df: DataFrame) -> int | None:
    """The limit that closes a query, read off its plan; limits of its subqueries do not count."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "GlobalLimit":
        return None
    value = node.limitExpr().toString()
    return int(value) if value.isdigit() else None
