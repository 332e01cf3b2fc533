"""Exports: CSV in three styles, INSERT text, JSON rows, and the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.values import csv_minimal, csv_quoted, json_object, json_value, row_text, sql_literal, value_text
from strata.operators.spread import number_rows
from strata.session import RUN_LOG, RUN_LOG_SCHEMA, Workbench

INSERT_BATCH = 100


def export_csv(df: DataFrame, folder: str) -> DataFrame:
    """Write a whole table as CSV files with header and read them back."""
    options = {"header": True, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    df.write.mode("error").options(**options, emptyValue='""').csv(folder)
    # Values may hold line ends, so a file is read back by one task; a file is one write task's part.
    return df.sparkSession.read.options(**options, multiLine=True).schema(df.schema).csv(folder)


def _quote_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def csv_minimal_lines(df: DataFrame) -> DataFrame:
    """One text line per row, quoted only where needed (column ``line``)."""
    line = row_text(df, lambda c, t: csv_minimal(value_text(c, t)), ",")
    return df.select(line.alias("line"))


def csv_quoted_lines(df: DataFrame) -> DataFrame:
    """One text line per row, every field quoted (column ``line``)."""
    line = row_text(df, lambda c, t: csv_quoted(value_text(c, t)), ",")
    return df.select(line.alias("line"))


def csv_header(columns: list[str], quote_all: bool = False) -> str:
    """Header line of the two text styles; the only line when there are no rows."""
    def field(name: str) -> str:
        return _quote_name(name) if quote_all or any(ch in name for ch in '",\n\r') else name

    return ",".join(field(c) for c in columns)


def write_csv_text(df: DataFrame, folder: str, quote_all: bool = False) -> None:
    """Write the text style: the header line in ``part=0``, the rows in files of ``part=1``.

    In order of their names the files make one CSV text, with the header alone if there are no rows.
    """
    lines = csv_quoted_lines(df) if quote_all else csv_minimal_lines(df)
    header = csv_header(df.columns, quote_all)
    df.sparkSession.createDataFrame([(header,)], "line string").coalesce(1).write.text(f"{folder}/part=0")
    lines.write.text(f"{folder}/part=1")


def read_csv_text(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a written text: ``is_header`` and ``line`` (values that hold line ends give several)."""
    found = spark.read.schema("value string, part int").text(folder)
    return found.select((F.col("part") == 0).alias("is_header"), F.col("value").alias("line"))


def insert_dump(df: DataFrame, table: str, order_by: list[Column | str], batch: int = INSERT_BATCH) -> DataFrame:
    """INSERT statements over batches of rows: columns ``batch_no`` and ``statement``.

    `order_by` must be a total order; a batch never holds more than `batch` rows.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    values = F.concat(F.lit("("), row_text(df, sql_literal, ", "), F.lit(")"))
    rows = number_rows(df.withColumn("_values", values), order, "_row")
    path = ".".join(_quote_name(p) for p in table.split("."))
    prefix = f"INSERT INTO {path} ({', '.join(_quote_name(c) for c in df.columns)}) VALUES\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_row", "_values"))), lambda x: x["_values"])
    return (
        rows.select("_row", "_values", F.floor((F.col("_row") - 1) / batch).alias("batch_no"))
        .groupBy("batch_no")
        .agg(F.concat(F.lit(prefix), F.array_join(lines, ",\n"), F.lit(";")).alias("statement"))
    )


def backup_totals(dumped: DataFrame, max_rows: int = 0) -> DataFrame:
    """Per dumped table: rows, and whether the row cap was reached. Input has a ``table_name``."""
    reached = (F.col("n_rows") >= max_rows) if max_rows > 0 else F.lit(False)
    return (
        dumped.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("truncated", reached)
    )


def json_safe_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text (column ``json``)."""
    parts = [(f.name, json_value(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    return df.select(json_object(parts).alias("json"))


def run_log_append(wb: Workbench, entries: list[dict]) -> None:
    """Add one row per materialization to the run log."""
    names = [part.strip().split(" ")[0] for part in RUN_LOG_SCHEMA.split(",")]
    rows = [tuple(e.get(n) for n in names) for e in entries]
    wb.spark.createDataFrame(rows, RUN_LOG_SCHEMA).coalesce(1).write.mode("append").saveAsTable(RUN_LOG)


def run_entry(run_id: str, notebook: str | None, cell_id: str, layer: str | None, output: str | None) -> dict:
    return {
        "run_id": run_id,
        "notebook": notebook,
        "cell_id": cell_id,
        "layer": layer,
        "output_name": output,
        "started_at": datetime.now(),
    }
