"""Running a list of statements in order."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strata.functions.text import RESULT_HEADS
from strata.operators.grid import Capped, row_cap
from strata.plans.analyze import analyze, own_limit, strip_statement
from strata.session import Workbench, error_text

STATUS_SCHEMA = (
    "idx int, sql string, status string, kind string, row_count bigint, capped boolean, elapsed_ms bigint, message string"
)
ROW_CAP = 10_000
TABULAR = re.compile(rf"^({RESULT_HEADS})\b", re.IGNORECASE)


@dataclass(frozen=True)
class ScriptRun:
    status: DataFrame
    last_result: DataFrame | None
    failed_at: int | None


def capped_query(wb: Workbench, sql: str, cap: int = ROW_CAP) -> Capped:
    """A query under the row cap; its own closing LIMIT counts when it is smaller."""
    df = analyze(wb.spark, sql)
    return row_cap(df, cap, own_limit(df))


def _count_capped(wb: Workbench, sql: str, cap: int) -> tuple[int, bool]:
    """Rows of a query under the cap, and whether the cap left some out."""
    df = analyze(wb.spark, sql)
    if cap == 0:
        return df.count(), False
    found = df.limit(cap + 1).count()
    return min(found, cap), found > cap


def run_script(wb: Workbench, statements: list[str], max_rows: int = ROW_CAP) -> ScriptRun:
    """Run statements until one fails; the rest is marked skipped. Indexes start at 1.

    A tabular statement is counted under the cap, so no result travels to the driver; ``capped`` says that it has more rows
    than the cap let through.
    """
    rows: list[tuple] = []
    last: DataFrame | None = None
    failed: int | None = None
    for i, sql in enumerate(statements, 1):
        if failed is not None:
            rows.append((i, sql, "skipped", None, None, None, None, None))
            continue
        started = time.monotonic()
        try:
            if TABULAR.match(sql.strip()):
                last = capped_query(wb, sql, max_rows).rows
                count, capped = _count_capped(wb, sql, max_rows)
                kind = "tabular"
            else:
                wb.spark.sql(strip_statement(sql))
                count, capped, kind = None, None, "non_tabular"
            status, message = "success", None
        except Exception as exc:
            failed, count, capped, kind = i, None, None, None
            status, message = "error", error_text(exc)
        elapsed = int((time.monotonic() - started) * 1000)
        rows.append((i, sql, status, kind, count, capped, elapsed, message))
    return ScriptRun(wb.spark.createDataFrame(rows, STATUS_SCHEMA), last, failed)
