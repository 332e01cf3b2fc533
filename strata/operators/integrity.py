"""Rows and keys that break a rule, and the effect of key changes on child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.spread import HOT_ROWS, spread_join
from strata.session import StrataError

ACTIONS = ("NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT")


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _columns(df: DataFrame, names: list[str], what: str) -> list[str]:
    known = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() not in known:
            raise StrataError(f"{what} column '{n}' is not in the table")
    return [known[n.lower()] for n in names]


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in one of the columns."""
    return df.where(_any_null(_columns(df, columns, "NOT NULL")))


def check_primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their row counts and the reason."""
    keys = _columns(df, keys, "primary key")
    reason = F.when(_any_null(keys), "null").otherwise("duplicate")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where((F.col("n_rows") > 1) | _any_null(keys)).withColumn("reason", reason)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once."""
    keys = _columns(df, keys, "unique")
    return (
        df.where(~_any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    )


def check_expression(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is false; null passes."""
    return df.where(~F.expr(expression))


def _pair(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]):
    if not columns or not parent_columns:
        raise StrataError("a foreign key needs columns on both sides")
    if len(columns) != len(parent_columns):
        raise StrataError("foreign key column counts must match")
    columns = _columns(child, columns, "foreign key")
    parent_columns = _columns(parent, parent_columns, "referenced")
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)])
    return columns, keys.distinct()


def check_foreign_key(
    child: DataFrame,
    parent: DataFrame,
    columns: list[str],
    parent_columns: list[str],
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Child rows without a parent; a null in any key column passes."""
    columns, keys = _pair(child, parent, columns, parent_columns)
    return spread_join(child.where(~_any_null(columns)), keys, columns, "left_anti", min_rows)


def fk_on_delete(
    child: DataFrame,
    deleted: DataFrame,
    columns: list[str],
    parent_columns: list[str],
    action: str = "NO ACTION",
    default: dict[str, object] | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """What deleting parent keys does to the child table.

    CASCADE gives the rows that stay, SET NULL and SET DEFAULT give all rows with the new key,
    RESTRICT and NO ACTION give the rows that stand in the way.
    """
    action = action.strip().upper()
    if action not in ACTIONS:
        raise StrataError(f"invalid ON DELETE action '{action}'")
    columns, keys = _pair(child, deleted, columns, parent_columns)
    if action == "CASCADE":
        return spread_join(child, keys, columns, "left_anti", min_rows)
    if action in ("RESTRICT", "NO ACTION"):
        return spread_join(child, keys, columns, "left_semi", min_rows)
    marked = spread_join(child, keys.withColumn("_gone", F.lit(True)), columns, "left", min_rows)

    def value(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        new = None if action == "SET NULL" else (default or {}).get(name)
        return F.when(F.col("_gone"), F.lit(new).cast(child.schema[name].dataType)).otherwise(F.col(name)).alias(name)

    return marked.select(*[value(c) for c in child.columns])


def fk_on_update(
    child: DataFrame,
    changes: DataFrame,
    columns: str | list[str],
    old: str | list[str] = "old_key",
    new: str | list[str] = "new_key",
    action: str = "CASCADE",
    default: dict[str, object] | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """What changing parent keys from `old` to `new` does to the child table.

    CASCADE, SET NULL and SET DEFAULT give all rows with the key they have afterwards, RESTRICT and
    NO ACTION the rows that stand in the way. A change to the same key is none; the same change
    given twice is one, and two different new keys for an old one fail.
    """
    action = action.strip().upper()
    if action not in ACTIONS:
        raise StrataError(f"invalid ON UPDATE action '{action}'")
    columns, old, new = ([x] if isinstance(x, str) else list(x) for x in (columns, old, new))
    columns = _columns(child, columns, "foreign key")
    if not len(columns) == len(old) == len(new):
        raise StrataError("foreign key, old and new key differ in their number of columns")
    target = F.struct(*[F.col(n).alias(f"_new_{i}") for i, n in enumerate(new)])
    moves = changes.select(*[F.col(o).alias(c) for o, c in zip(old, columns)], target.alias("_to")).groupBy(*columns)
    several = F.raise_error(F.lit("an old key changes to two new ones")).cast(changes.select(target.alias("t")).schema["t"].dataType)
    moves = moves.agg(F.min("_to").alias("_lo"), F.max("_to").alias("_hi")).select(
        *columns, F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(several).alias("_to")
    )
    moves = moves.where(~_same_key(columns))
    if action in ("RESTRICT", "NO ACTION"):
        return spread_join(child, moves.select(*columns), columns, "left_semi", min_rows)
    joined = spread_join(child, moves, columns, "left", min_rows)

    def value(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        if action == "CASCADE":
            after = F.col("_to")[f"_new_{columns.index(name)}"]
        else:
            after = F.lit(None if action == "SET NULL" else (default or {}).get(name))
        kept = F.col(name)
        return F.when(F.col("_to").isNotNull(), after.cast(child.schema[name].dataType)).otherwise(kept).alias(name)

    return joined.select(*[value(c) for c in child.columns])


def _same_key(columns: list[str]) -> Column:
    same = F.lit(True)
    for i, name in enumerate(columns):
        same &= F.col(name).eqNullSafe(F.col("_to")[f"_new_{i}"])
    return same


def column_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fill nulls with default expressions; a column that is absent is added."""
    known = {c.lower(): c for c in df.columns}
    for name, expression in defaults.items():
        found = known.get(name.lower())
        value = F.expr(expression)
        df = df.withColumn(found or name, F.coalesce(F.col(found), value) if found else value)
    return df
