"""The result grid: caps, filters, sorts, pages and chart series."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.values import chart_number
from strata.operators.spread import number_rows
from strata.session import cut

PAGE_ROWS = 100
#: Pages that end by this row come from a top-k, which takes that many rows of each task at most.
SHALLOW_ROWS = 10_000


@dataclass(frozen=True)
class Capped:
    rows: DataFrame
    clamped: bool
    effective_limit: int


def row_cap(df: DataFrame, cap: int = 10_000, user_limit: int | None = None) -> Capped:
    """The smaller of the user's limit and the cap; a cap of 0 means none."""
    if cap == 0:
        return Capped(df, False, 0)
    limit = cap if user_limit is None else min(cap, user_limit)
    return Capped(df.limit(limit), user_limit is not None and user_limit > cap, limit)


def _condition(c: Column, op: str, value) -> Column:
    tests = {
        "contains": lambda: F.lower(c.cast("string")).contains(str(value).lower()),
        "not_contains": lambda: ~F.lower(c.cast("string")).contains(str(value).lower()),
        "starts_with": lambda: F.lower(c.cast("string")).startswith(str(value).lower()),
        "ends_with": lambda: F.lower(c.cast("string")).endswith(str(value).lower()),
        "=": lambda: c == value,
        "!=": lambda: c != value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        "between": lambda: c.between(value[0], value[1]),
        "blank": lambda: c.isNull() | (c.cast("string") == ""),
        "not_blank": lambda: c.isNotNull() & (c.cast("string") != ""),
    }
    return tests[op]()


def grid_filter(df: DataFrame, filters: dict[str, tuple]) -> DataFrame:
    """Filter by column: ``{column: (operator, value)}``; all of them must hold."""
    for name, spec in filters.items():
        op, value = spec if len(spec) == 2 else (spec[0], None)
        df = df.where(_condition(F.col(f"`{name}`"), op, value))
    return df


def grid_order(keys: list[tuple[str, str]]) -> list[Column]:
    """Sort columns with nulls last in both directions."""
    return [
        F.col(f"`{name}`").desc_nulls_last() if way == "desc" else F.col(f"`{name}`").asc_nulls_last()
        for name, way in keys
    ]


def grid_sort(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sort by columns. End the list with a unique column: it makes the order total and lets
    the range partitioning split a value that many rows share."""
    return df.orderBy(*grid_order(keys))


def grid_page(df: DataFrame, keys: list[tuple[str, str]], page: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page of a sorted grid, counted from 1.

    Of deep pages only the sort columns are numbered; the page's sort values then fetch its rows. Who turns many pages
    should store a `page_index`. The list of sort columns must end in a unique one, as for `grid_sort`.
    """
    first = (page - 1) * size
    order, names = grid_order(keys), [name for name, _ in keys]
    if first + size <= SHALLOW_ROWS:
        return df.orderBy(*order).offset(first).limit(size)
    numbered = number_rows(df.select(*[F.col(f"`{n}`") for n in names]), order, "_row")
    wanted = numbered.where(F.col("_row").between(first + 1, first + size)).drop("_row")
    wanted = wanted.select(*[F.col(f"`{n}`").alias(f"_at{i}") for i, n in enumerate(names)])
    same = [F.col(f"`{n}`").eqNullSafe(F.col(f"_at{i}")) for i, n in enumerate(names)]
    return df.join(wanted, reduce(lambda a, b: a & b, same), "left_semi").orderBy(*order).limit(size)


def page_index(df: DataFrame, keys: list[tuple[str, str]], partitions: int | None = None) -> DataFrame:
    """The grid's rows as a stored table in order, with their numbers (``row_no``, from 1): sorted once, for any number of pages.

    The numbers rise in each part, so Parquet's statistics tell which part, and which of its pages, hold a range of them.
    """
    return cut(number_rows(df, grid_order(keys), "row_no", partitions).sortWithinPartitions("row_no"), "pages")


def indexed_page(index: DataFrame, page: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page, counted from 1, of a stored `page_index`."""
    first = (page - 1) * size
    return index.where(F.col("row_no").between(first + 1, first + size)).orderBy("row_no").drop("row_no")


def chart_columns(df: DataFrame, label: str | None, series: list[str] | None) -> tuple[str, list[str]]:
    names = df.columns
    chosen = label if label in names else names[0]
    if not series:
        series = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return chosen, series


def chart_series(df: DataFrame, label: str | None = None, series: list[str] | None = None) -> DataFrame:
    """Label column and number columns of a chart.

    An unknown label falls back to the first column, no series means all numeric columns, and
    what is no number counts as 0.
    """
    chosen, series = chart_columns(df, label, series)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        F.col(f"`{chosen}`").alias("label"),
        *[chart_number(F.col(f"`{s}`"), types[s]).alias(s) for s in series],
    )


def chart_long(df: DataFrame, label: str | None = None, series: list[str] | None = None) -> DataFrame:
    """The chart in long form: label, series, value."""
    wide = chart_series(df, label, series)
    return wide.unpivot("label", wide.columns[1:], "series", "value")


def number_batches(df: DataFrame, order: list[Column], batch: int = PAGE_ROWS, name: str = "batch_no") -> DataFrame:
    """Number consecutive batches of `batch` rows from 0."""
    rows = number_rows(df, order, "_row")
    return rows.withColumn(name, F.floor((F.col("_row") - 1) / batch)).drop("_row")
