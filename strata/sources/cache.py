"""Keeping query results, loaded rows and whole tables in the ``data_cache`` layer."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans.analyze import analyze, own_limit
from strata.session import RESERVED_SCHEMAS, SYSTEM_LAYER, StrataError, Workbench, is_empty

#: Bytes of the source that a file of a table with keys gets on average.
FILE_BYTES = 128 << 20
#: Keys that one look-up sends with its plan, and files that it names at most; beyond either it is a join, or a filter, over the whole table.
MOST_KEYS = 1000
MOST_NAMED = 10_000


@dataclass(frozen=True)
class Cached:
    target: str
    view: str
    rows: int
    capped: bool = False


def slug(text: str) -> str:
    """Same rule as the slug expression for columns, for one name."""
    s = re.sub(r"\s+", "_", text.lower())
    s = re.sub(r"[^A-Za-z0-9_\-]+", "_", s)
    return re.sub("--+", "_", s).strip("-")


def _store(
    wb: Workbench,
    df: DataFrame,
    source: str,
    name: str,
    overwrite: bool,
    keys: list[str] | None = None,
    max_rows: int = 0,
    file_bytes: int = FILE_BYTES,
) -> Cached:
    full = f"{slug(source)}__{slug(name)}".replace("-", "_")
    target, view = f"data_cache.{full}", f"bronze.raw__{full}"
    if not overwrite and wb.exists(target):
        return Cached(target, view, 0)
    kept = df.limit(max_rows) if max_rows else df
    options = {f"parquet.bloom.filter.enabled#{k}": "true" for k in keys or ()}
    rows = wb.replace_table(target, by_ranges(kept, keys, file_bytes) if keys else kept, keep_empty=False, options=options)
    if rows:
        if keys:
            _list_files(wb, target, keys[0])
        else:
            wb.drop(_files_of(target))
        wb.replace_view(view, f"SELECT * FROM {target}")
    return Cached(target, view, rows, bool(max_rows) and rows == max_rows and not is_empty(df.offset(max_rows)))


def by_ranges(df: DataFrame, keys: list[str], file_bytes: int = FILE_BYTES) -> DataFrame:
    """`df` in ranges of its keys, each sorted; a key with more rows than a range goes over several.

    The number of ranges follows the bytes of the tables that `df` reads; their bounds are sampled by Spark.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    parts = max(1, min(-(-size // file_bytes), 1_000_000))
    plain = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # Rows of one key are told apart by their content, so that bounds can lie inside a hot key.
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    ordered = [F.col(f"`{k}`") for k in keys]
    return df.repartitionByRange(parts, *ordered, spread).sortWithinPartitions(*ordered)


def _files_of(target: str) -> str:
    return f"{SYSTEM_LAYER}.files__{target.split('.')[-1]}"


def _location(wb: Workbench, table: str) -> str:
    found = wb.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").select("data_type").first()
    return found[0].rstrip("/").rsplit("/", 1)[-1]


def _list_files(wb: Workbench, target: str, key: str) -> None:
    """Store the least and greatest first key of each file of a table, by one scan of that column."""
    rows = wb.table(target)
    key_of = F.col(f"`{key}`")
    found = rows.groupBy(rows.metadataColumn("_metadata")["file_name"].alias("file"))
    listed = found.agg(F.min(key_of).alias("lo"), F.max(key_of).alias("hi"), F.count(F.lit(1)).alias("rows"))
    wb.replace_table(_files_of(target), listed.withColumn("key", F.lit(key)).withColumn("version", F.lit(_location(wb, target))))


def lookup(wb: Workbench, target: str, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of a cached table whose `key` is among the values of the one column of `wanted`.

    Up to `MOST_KEYS` values become a filter that reaches the row groups (ranges, Bloom filters); if `key` is the first of the
    table's keys, files whose range holds none of them are not opened. More values are joined. A null is found nowhere.
    """
    rows = wb.table(target)
    name = wanted.columns[0]
    wanted = wanted.select(F.col(f"`{name}`").cast(rows.schema[key].dataType).alias("wanted")).where("wanted IS NOT NULL").distinct()
    values = [r[0] for r in wanted.limit(MOST_KEYS + 1).collect()]
    key_of = rows[f"`{key}`"]
    if not values:
        return rows.limit(0)
    if len(values) > MOST_KEYS:
        return rows.join(wanted, key_of == wanted["wanted"], "left_semi")
    found = rows.where(key_of.isin(values))
    if not wb.exists(_files_of(target)):
        return found
    files = wb.table(_files_of(target)).where((F.col("key") == key) & (F.col("version") == _location(wb, target)))
    if is_empty(files):
        return found
    inside = F.exists(F.array(*[F.lit(v) for v in values]), lambda v: (v >= F.col("lo")) & (v <= F.col("hi")))
    names = [r[0] for r in files.where(inside).select("file").limit(MOST_NAMED + 1).collect()]
    if len(names) > MOST_NAMED:
        return found
    return found.where(rows.metadataColumn("_metadata")["file_name"].isin(names)) if names else rows.limit(0)


def cache_query(
    wb: Workbench,
    query: str | DataFrame,
    source: str,
    name: str,
    max_rows: int = 0,
    overwrite: bool = True,
) -> Cached:
    """Store a result, whole unless a cap is asked for.

    `max_rows` caps queries that do not end in a limit of their own; `Cached.capped` says whether
    rows were left out. An empty result stores nothing.
    """
    df = analyze(wb.spark, query) if isinstance(query, str) else query
    return _store(wb, df, source, name, overwrite, max_rows=max_rows if max_rows and own_limit(df) is None else 0)


def cache_rows(
    wb: Workbench, rows: Iterable, schema: T.StructType | str, source: str, name: str = "loaded_results"
) -> Cached:
    """Store rows the caller has already loaded."""
    return _store(wb, wb.spark.createDataFrame(list(rows), schema), source, name, True)


def cache_table(
    wb: Workbench,
    table: str,
    source: str,
    name: str | None = None,
    keys: list[str] | None = None,
    max_rows: int = 0,
    file_bytes: int = FILE_BYTES,
) -> Cached:
    """Store a table, whole unless a cap is asked for. `keys` lays its files out for `lookup`, with Bloom filters for each key."""
    path = [part.strip("`") for part in table.split(".")]
    if len(path) > 1 and path[-2].lower() in RESERVED_SCHEMAS:
        raise StrataError(f"tables of the reserved schema '{path[-2]}' are not cached")
    return _store(wb, wb.table(table), source, name or path[-1], True, keys, max_rows, file_bytes)
