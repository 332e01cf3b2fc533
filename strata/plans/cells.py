"""Cells: turning SELECTs into tables and views of the bronze, silver and gold layers."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans.analyze import analyze, strip_statement
from strata.session import PIPELINE_LAYERS, RESERVED_SCHEMAS, RUN_LOG_SCHEMA, StrataError, Workbench, error_text
from strata.sinks.export import run_entry, run_log_append

PREVIEW_ROWS = 200
OUTPUT_NAME = re.compile(r"^[a-z0-9_]+$")


@dataclass(frozen=True)
class Cell:
    cell_id: str
    sql: str
    layer: str = "bronze"
    output: str | None = None
    materialize: str = "table"
    mode: str | None = None
    kind: str = "sql"

    @property
    def effective_mode(self) -> str:
        return self.mode or ("transform" if self.output else "analyze")


@dataclass(frozen=True)
class Materialized:
    fqn: str
    kind: str
    rows: int
    preview: DataFrame


def check_target(layer: str, output: str | None) -> str:
    """Name of the output object, or the reason why it is refused."""
    if layer not in PIPELINE_LAYERS:
        if layer in RESERVED_SCHEMAS:
            raise StrataError(f"schema '{layer}' is reserved; write to bronze, silver or gold")
        raise StrataError(f"layer '{layer}' is not allowed; use bronze, silver or gold")
    if not output:
        raise StrataError("an output name is required")
    if not OUTPUT_NAME.match(output):
        raise StrataError(f"output name '{output}' must be snake_case")
    return f"{layer}.{output}"


def checked_query(wb: Workbench, sql: str) -> DataFrame:
    """The query of a cell; anything but a query is refused before it can run."""
    try:
        return analyze(wb.spark, sql)
    except PySparkException as exc:
        if type(exc).__name__ == "ParseException":
            raise StrataError(f"a cell must be a single query: {error_text(exc)}") from exc
        raise


def transform(
    wb: Workbench, query: str | DataFrame, layer: str, output: str | None, materialize: str = "table"
) -> Materialized:
    """Replace ``layer.output`` by the result of a query and report its rows.

    A table is written once, and its rows are counted during that write. A view needs SQL text
    over stored objects.
    """
    fqn = check_target(layer, output)
    df = checked_query(wb, query) if isinstance(query, str) else query
    if materialize == "view":
        if not isinstance(query, str):
            raise StrataError("a view needs SQL text")
        wb.replace_view(fqn, strip_statement(query))
        rows = wb.table(fqn).count()
    else:
        rows = wb.replace_table(fqn, df)
    if not wb.exists(fqn):
        raise StrataError(f"'{fqn}' was not found after it was written")
    return Materialized(fqn, wb.kind(fqn) or "", rows, preview(wb, fqn))


def preview(wb: Workbench, fqn: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    return wb.table(fqn).limit(rows)


def run_cells(wb: Workbench, cells: list[Cell], notebook: str | None = None) -> DataFrame:
    """Run cells in order; each one reports, and a failing one does not stop the rest.

    The report is the run log of this run, which is also appended to the stored log.
    """
    run_id = str(uuid.uuid4())
    entries = []
    for cell in cells:
        if cell.kind != "sql" or not cell.sql.strip():
            continue
        entry = run_entry(run_id, notebook, cell.cell_id, cell.layer, cell.output)
        started = time.monotonic()
        try:
            if cell.effective_mode == "transform":
                rows = transform(wb, cell.sql, cell.layer, cell.output, cell.materialize).rows
            else:
                rows = checked_query(wb, cell.sql).count()
            entry |= {"status": "success", "rows": rows}
        except Exception as exc:
            entry |= {"status": "error", "error": error_text(exc)}
        entry["elapsed_ms"] = int((time.monotonic() - started) * 1000)
        entries.append(entry)
    run_log_append(wb, entries)
    names = [part.strip().split(" ")[0] for part in RUN_LOG_SCHEMA.split(",")]
    return wb.spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], RUN_LOG_SCHEMA)


def materialize_row_count(wb: Workbench, fqn: str) -> DataFrame:
    return wb.table(fqn).agg(F.count(F.lit(1)).alias("n"))
