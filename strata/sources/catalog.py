"""Listings of the layers as DataFrames. Catalog metadata lives on the driver in any case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

from strata.session import LAYERS, Workbench

TABLES_SCHEMA = "table_schema string, table_name string, table_type string"
COLUMNS_SCHEMA = (
    "table_schema string, table_name string, column_name string, data_type string, "
    "is_nullable string, ordinal int"
)
PREVIEW_ROWS = 100


def catalog_tables(wb: Workbench, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Tables and views of each layer; temporary views are left out."""
    rows = []
    for layer in layers:
        if not wb.spark.catalog.databaseExists(layer):
            continue
        for t in wb.spark.catalog.listTables(layer):
            if not t.isTemporary:
                rows.append((layer, t.name, "VIEW" if t.tableType == "VIEW" else "BASE TABLE"))
    return wb.spark.createDataFrame(rows, TABLES_SCHEMA).orderBy("table_schema", "table_name")


def type_name(dtype: DataType) -> str:
    return dtype.simpleString()


def catalog_columns(wb: Workbench, tables: list[str]) -> DataFrame:
    """Columns of the named objects in order; an object that does not exist gives no rows."""
    rows = []
    for fqn in tables:
        if wb.exists(fqn):
            schema, name = fqn.split(".")
            for i, f in enumerate(wb.table(fqn).schema.fields, 1):
                rows.append((schema, name, f.name, type_name(f.dataType), "YES" if f.nullable else "NO", i))
    return wb.spark.createDataFrame(rows, COLUMNS_SCHEMA)


def all_columns(wb: Workbench, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    names = [
        f"{layer}.{t.name}"
        for layer in layers
        if wb.spark.catalog.databaseExists(layer)
        for t in wb.spark.catalog.listTables(layer)
        if not t.isTemporary
    ]
    return catalog_columns(wb, names)


def table_preview(df: DataFrame, order_by: list | None = None, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a table, by `order_by` when given."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)
