import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402
from workloads import ORACLES, QUERIES  # noqa: E402

# A few queries of each kind; tools/check.py runs all of them.
SAMPLE = [
    "transform_table", "sql_window", "import_csv", "export_csv_minimal", "insert_dump", "apply_edits", "edit_status",
    "check_foreign_key", "schema_diff", "inferred_relationships", "lineage_column_edges", "corpus_search", "query_context",
    "rename_change_feed", "stream_index_upsert", "history_retention", "front_matter",
]


def test_every_query_has_a_check():
    """The training-data queries may be left out; tests/llm lists those of them without SQL."""
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "sum_qty", "revenue", "n"] and df.count() > 0


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_its_check(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    got = rows_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, result.fetchall())
