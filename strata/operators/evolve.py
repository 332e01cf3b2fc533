"""Schema comparison and evolution.

Column snapshots are DataFrames with ``table_schema``, ``table_name``, ``column_name``,
``data_type``, ``is_nullable`` and optional ``comment``. Table drafts (for change plans) are rows
of ``table_name``, ``kind``, ``name``, ``definition``, ``nullable``, ``default_value``, where kind
is column, primary_key, unique, foreign_key, check or index, and ``definition`` is the type, the
comma-joined columns, or the expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import integrity
from strata.session import StrataError, Workbench, is_empty

COLUMN_KEY = ["table_schema", "table_name", "column_name"]


def normalized_order(columns: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """A snapshot in comparison order: schema, table, column by name; comparable fields only."""
    fields = [c for c in (*COLUMN_KEY, "data_type", "is_nullable", "comment") if c in columns.columns]
    order = [F.collate(F.col(c), collation) for c in COLUMN_KEY]
    return columns.select(*fields).orderBy(*order, *COLUMN_KEY)


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed columns, and added or removed tables (``column_name`` null)."""
    compared = [c for c in ("data_type", "is_nullable", "comment") if c in old.columns and c in new.columns]
    side = lambda df, tag: df.select(*COLUMN_KEY, F.struct(*compared).alias(tag))
    pairs = side(old, "_old").join(side(new, "_new"), COLUMN_KEY, "full")
    changed = [F.when(~F.col("_old")[c].eqNullSafe(F.col("_new")[c]), F.lit(c)) for c in compared]
    detail = F.array_join(F.array_compact(F.array(*changed)), ",")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(detail != "", "changed")
    )
    columns = pairs.select(
        *COLUMN_KEY,
        change.alias("change"),
        F.when(change == "changed", detail).alias("detail"),
        *[F.col("_old")[c].alias(f"old_{c}") for c in compared],
        *[F.col("_new")[c].alias(f"new_{c}") for c in compared],
    ).where(F.col("change").isNotNull())
    # Tables from the same pairs: present on a side when any column is.
    tables = pairs.groupBy("table_schema", "table_name").agg(
        F.bool_or(F.col("_old").isNotNull()).alias("_had"), F.bool_or(F.col("_new").isNotNull()).alias("_has")
    )
    table_change = F.when(~F.col("_had"), "table added").when(~F.col("_has"), "table removed")
    tables = tables.select("table_schema", "table_name", table_change.alias("change")).where(
        F.col("change").isNotNull()
    )
    return columns.unionByName(tables, allowMissingColumns=True)


# Fixed order of the kinds of change in a plan.
PLAN_ORDER = (
    "drop column",
    "add column",
    "alter type",
    "set nullability",
    "set default",
    "drop primary_key",
    "add primary_key",
    "drop unique",
    "add unique",
    "drop foreign_key",
    "add foreign_key",
    "drop check",
    "add check",
    "drop index",
    "add index",
)


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _column_set(c: Column) -> Column:
    """Comma-joined columns as an order-free, case-free key."""
    parts = F.transform(F.split(c, ","), lambda s: F.lower(F.trim(s)))
    return F.array_join(F.array_sort(F.filter(parts, lambda s: s != "")), ",")


def alter_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that turn the old drafts into the new ones, for any number of tables.

    Columns match by name without regard to case, keys and unique sets by their columns, foreign
    keys, checks and indexes by name. ``step`` is the place of the change among the kinds.
    """
    by_name = F.lower(F.trim("name"))
    by_set = _column_set(F.col("definition"))
    match = (
        F.when(F.col("kind") == "column", by_name)
        .when(F.col("kind").isin("primary_key", "unique"), by_set)
        .otherwise(F.col("name"))
    )

    def side(df: DataFrame, tag: str) -> DataFrame:
        kept = df.where((_clean("definition") != "") & ((F.col("kind") != "column") | (_clean("name") != "")))
        return kept.select(
            "table_name",
            "kind",
            # Two constraints without a name are different things.
            F.coalesce(match, F.concat(F.lit(f"{tag}:"), F.col("definition"))).alias("_match"),
            F.struct(
                F.trim("name").alias("name"), _clean("definition").alias("definition"),
                F.coalesce("nullable", F.lit(True)).alias("nullable"), _clean("default_value").alias("default_value"),
            ).alias(tag),
        )

    pairs = side(old, "_old").join(side(new, "_new"), ["table_name", "kind", "_match"], "full")
    o, n, kind = F.col("_old"), F.col("_new"), F.col("kind")

    def change(when: Column, action: Column | str, before: Column, after: Column) -> Column:
        action = F.lit(action) if isinstance(action, str) else action
        return F.when(
            when, F.struct(action.alias("action"), before.alias("old_value"), after.alias("new_value"))
        )

    null = F.lit(None).cast("string")
    both = o.isNotNull() & n.isNotNull()
    both_columns = both & (kind == "column")
    # A unique set, foreign key, check or index without a name cannot be dropped by name.
    droppable = n.isNull() & (kind.isin("column", "primary_key") | o["name"].isNotNull())
    steps = F.array_compact(
        F.array(
            change(droppable, F.concat(F.lit("drop "), kind), o["definition"], null),
            change(o.isNull(), F.concat(F.lit("add "), kind), null, n["definition"]),
            change(both_columns & (o["definition"] != n["definition"]), "alter type", o["definition"], n["definition"]),
            change(
                both_columns & (o["nullable"] != n["nullable"]),
                "set nullability", o["nullable"].cast("string"), n["nullable"].cast("string"),
            ),
            change(
                both_columns & (o["default_value"] != n["default_value"]),
                "set default", o["default_value"], n["default_value"],
            ),
        )
    )
    place = F.array_position(F.array(*[F.lit(p) for p in PLAN_ORDER]), F.col("_s.action")).cast("int")
    return pairs.select(
        "table_name", F.coalesce(n["name"], o["name"]).alias("name"), F.explode(steps).alias("_s")
    ).select("table_name", place.alias("step"), "_s.action", "name", "_s.old_value", "_s.new_value")


def require_changes(plan: DataFrame) -> DataFrame:
    if is_empty(plan):
        raise StrataError("no changes detected")
    return plan


@dataclass(frozen=True)
class Evolved:
    rows: DataFrame
    failures: DataFrame


def evolve_table(
    df: DataFrame,
    drop: list[str] | None = None,
    add: dict[str, tuple[str, str | None]] | None = None,
    cast: dict[str, str] | None = None,
) -> Evolved:
    """Data after column changes: drops, additions ``{name: (type, default)}`` and type changes.

    ``failures`` counts, per retyped column, values that do not convert (they become null in
    ``rows``). Nothing is written here, so a caller can look at the failures first.
    """
    known = {c.lower(): c for c in df.columns}
    gone = {d.lower() for d in drop or []}
    retyped = {known[k.lower()]: v for k, v in (cast or {}).items()}
    out = [
        F.col(c).try_cast(retyped[c]).alias(c) if c in retyped else F.col(c)
        for c in df.columns
        if c.lower() not in gone
    ]
    for name, (dtype, default) in (add or {}).items():
        value = F.expr(default) if default else F.lit(None)
        out.append(value.cast(dtype).alias(name))
    lost = lambda c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(retyped[c]).isNull())
    names = list(retyped)
    if not names:
        return Evolved(df.select(*out), df.sparkSession.createDataFrame([], "column_name string, n_failed bigint"))
    counts = df.agg(*[lost(c).alias(c) for c in names])
    return Evolved(df.select(*out), counts.unpivot([], names, "column_name", "n_failed"))


@dataclass(frozen=True)
class Planned:
    """Data after a plan's column changes, and per step of the plan that the data break: step, action, name, n_failed."""

    rows: DataFrame
    failures: DataFrame


def plan_rows(df: DataFrame, plan: DataFrame, defaults: dict[str, str] | None = None, parents: dict[str, DataFrame] | None = None) -> Planned:
    """What the rows of `alter_plan` for one table make of its data, and what stands against them.

    Columns are dropped, added and retyped by the plan, in its order. Checked are: values that do not convert, nulls in columns that
    must have none, and rows against the primary key, unique sets and checks that the plan adds; foreign keys (``definition``
    is the column) against the first column of the table given in `parents` under the constraint's name, others are left to their own check. `defaults` are expressions for
    added columns. A plan has a few rows per column, which the driver reads.
    """
    steps = sorted(plan.collect(), key=lambda r: (r["step"], r["name"] or "", r["new_value"] or ""))
    known = {c.lower(): c for c in df.columns}
    given = {k.lower(): v for k, v in (defaults or {}).items()}

    def named(action: str) -> list:
        return [r for r in steps if r["action"] == action]

    def column(name: str) -> str:
        if name.lower() not in known:
            raise StrataError(f"the plan names a column {name!r} that the table has not")
        return known[name.lower()]

    casts = {column(r["name"]): r["new_value"] for r in named("alter type")}
    added = {r["name"]: (r["new_value"], given.get(r["name"].lower())) for r in named("add column")}
    for name in added:
        if name.lower() in known:
            raise StrataError(f"the plan adds a column {name!r} that the table has already")
    evolved = evolve_table(df, [column(r["name"]) for r in named("drop column")], added, casts)
    rows = evolved.rows
    checks: list[DataFrame] = []

    def failed(row, found: DataFrame) -> None:
        counted = found.agg(F.count(F.lit(1)).alias("n_failed"))
        checks.append(counted.select(F.lit(row["step"]).alias("step"), F.lit(row["action"]).alias("action"), F.lit(row["name"]).cast("string").alias("name"), "n_failed"))

    lists = lambda row: [c.strip() for c in row["new_value"].split(",") if c.strip()]
    for row in named("alter type"):
        before = column(row["name"])
        failed(row, df.where(F.col(f"`{before}`").isNotNull() & F.col(f"`{before}`").try_cast(row["new_value"]).isNull()))
    for row in named("set nullability"):
        if row["new_value"] == "false":
            failed(row, integrity.check_not_null(rows, [row["name"]]))
    for row in named("add primary_key"):
        failed(row, integrity.check_primary_key(rows, lists(row)))
    for row in named("add unique"):
        failed(row, integrity.check_unique(rows, lists(row)))
    for row in named("add check"):
        failed(row, integrity.check_expression(rows, row["new_value"]))
    for row in named("add foreign_key"):
        parent = (parents or {}).get(row["name"])
        if parent is not None:
            failed(row, integrity.check_foreign_key(rows, parent, lists(row), parent.columns[: len(lists(row))]))
    failures = df.sparkSession.createDataFrame([], "step int, action string, name string, n_failed bigint")
    for check in checks:
        failures = failures.unionByName(check)
    return Planned(rows, failures.where("n_failed > 0"))


def apply_plan(wb: Workbench, fqn: str, plan: DataFrame, defaults: dict[str, str] | None = None, parents: dict[str, DataFrame] | None = None) -> int:
    """Change a table by its plan, all of it or nothing; the number of rows.

    The new rows are stored and checked before the name is switched; with a failure the table stays as it was.
    """
    require_changes(plan)
    done = plan_rows(wb.table(fqn), plan, defaults, parents)
    bad = done.failures.orderBy("step", "name").collect()
    if bad:
        text = "; ".join(f"{r['action']} {r['name'] or ''}".strip() + f": {r['n_failed']} rows" for r in bad)
        raise StrataError(f"the data break the plan ({text})")
    return wb.replace_table(fqn, done.rows)
