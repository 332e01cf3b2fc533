"""Registration of queries and the inputs they share.

Inputs that the given tables do not have as such (catalog rows, cells, edits, feeds) are derived
from whole given tables by SQL that Spark and the checking database both run, so their size grows
with the data. Such a text names given tables in braces.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata import Workbench, open_workbench
from strata.operators.spread import spread_scan
from strata.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: Where derived inputs are kept, for a bench that times operators and not the making of their inputs.
_kept: dict[tuple[str, str, str], DataFrame] | None = None


def keep_inputs() -> None:
    """From now on store each derived input once per session and hand the stored table on."""
    global _kept
    _kept = {}


def derive(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A derived input as DataFrame."""
    if _kept is None:
        return _derived(spark, sf, text)
    key = (spark.sparkContext.applicationId, sf, text)
    if key not in _kept:
        _kept[key] = cut(_derived(spark, sf, text), "input")
    return _kept[key]


def _derived(spark: SparkSession, sf: str, text: str) -> DataFrame:
    names = {name for _, name, _, _ in string.Formatter().parse(text) if name}
    return spark.sql(text, **{n: read(spark, sf, n) for n in names})


def texts(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A derived input of texts that are costly to work on; the derivation is a plain scan."""
    return spread_scan(derive(spark, sf, text))


def stored(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A derived input as a stored table, for operators that read it more than once."""
    return derive(spark, sf, text) if _kept is not None else cut(_derived(spark, sf, text), "input")


class _Same(dict):
    def __missing__(self, key: str) -> str:
        return key


def plain(text: str) -> str:
    """The same text with table names in place of the braces."""
    return string.Formatter().vformat(text, (), _Same())


def with_inputs(body: str, **inputs: str) -> str:
    """Checking SQL over derived inputs, which come as CTEs."""
    parts = ",\n".join(f"{name} AS ({plain(text)})" for name, text in inputs.items())
    return f"WITH {parts}\n{body}"


def workbench(spark: SparkSession) -> Workbench:
    return open_workbench(spark)


def mounted(spark: SparkSession, sf: str, *tables: str) -> Workbench:
    """A workbench with given tables mounted as ``imports.<table>`` (files stay where they are)."""
    wb = workbench(spark)
    for t in tables:
        wb.mount(f"imports.{t}", f"{sf}/{t}.parquet")
    return wb
