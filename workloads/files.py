"""Imports, caches, exports and cells over given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans import cells, lifecycle, script
from strata.session import scratch_path
from strata.sinks import export
from strata.sources import cache, catalog, files
from workloads.registry import mounted, query, read, workbench
from workloads.scalars import js_number


@query("import_csv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS bigint) AS p_size, p_retailprice FROM part")
def import_csv(spark, sf):
    folder = f"{scratch_path(spark, 'incoming')}/part.csv"
    read(spark, sf, "part").write.option("header", True).csv(folder)
    done = files.import_file(workbench(spark), folder, name="part from csv")
    return spark.table(done.view)


@query("import_csv_multiline", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def import_csv_multiline(spark, sf):
    """Files of documents, whose texts hold line ends, quotes and separators."""
    folder = f"{scratch_path(spark, 'incoming')}/documents.csv"
    d = read(spark, sf, "documents")
    d.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""').csv(folder)
    done = files.import_file(workbench(spark), folder, name="documents from csv")
    return spark.table(done.view)


@query("import_tsv", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def import_tsv(spark, sf):
    folder = f"{scratch_path(spark, 'incoming')}/events.tsv"
    e = read(spark, sf, "events")
    e.write.options(header=True, sep="\t", escape='"', timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(folder)
    done = files.import_file(workbench(spark), folder, schema=e.schema)
    return spark.table(done.target)


@query("import_parquet", "SELECT * FROM customer")
def import_parquet(spark, sf):
    done = files.import_file(workbench(spark), f"{sf}/customer.parquet", name="customer_copy")
    return spark.table(done.view)


@query(
    "import_many",
    """SELECT 'orders' AS file, 'imports.orders' AS target, 'imported' AS status, count(*) AS rows FROM orders
    UNION ALL SELECT 'lineitem', 'imports.lineitem', 'imported', count(*) FROM lineitem
    UNION ALL SELECT 'nothing', 'imports.nothing', 'failed', NULL""",
)
def import_many(spark, sf):
    wb = workbench(spark)
    report = files.import_files(wb, [f"{sf}/{n}.parquet" for n in ("orders", "nothing", "lineitem")])
    return report.select(
        F.regexp_extract("file", r"([^/]+)\.parquet$", 1).alias("file"), "target", "status", "rows"
    )


@query("cache_query", "SELECT l_orderkey, l_linenumber, l_extendedprice, 'limit 5' AS note FROM lineitem WHERE l_linestatus = 'O'")
def cache_query(spark, sf):
    wb = mounted(spark, sf, "lineitem")
    sql = "SELECT l_orderkey, l_linenumber, l_extendedprice, 'limit 5' AS note FROM imports.lineitem WHERE l_linestatus = 'O'; -- all"
    return spark.table(cache.cache_query(wb, sql, "Main DB", "Open items").view)


@query("cache_query_capped", "SELECT least(count(*), 500) AS n, count(*) > 500 AS capped FROM orders WHERE o_orderstatus = 'O'")
def cache_query_capped(spark, sf):
    wb = mounted(spark, sf, "orders")
    sql = "SELECT * FROM imports.orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT -1 LIMIT 1)"
    done = cache.cache_query(wb, sql, "Main DB", "Some orders", max_rows=500)
    return spark.table(done.view).agg(F.count(F.lit(1)).alias("n"), F.lit(done.capped).alias("capped"))


@query("cache_table", "SELECT * FROM lineitem")
def cache_table(spark, sf):
    wb = workbench(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS remote LOCATION '{wb.root}/remote'")
    wb.mount("remote.lineitem", f"{sf}/lineitem.parquet")
    return spark.table(cache.cache_table(wb, "remote.lineitem", "Main DB", keys=["l_orderkey"]).target)


@query(
    "cache_table_lookup",
    """SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN
    (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10))""",
)
def cache_table_lookup(spark, sf):
    """The items of all orders of the customers with the ten dearest orders."""
    wb = mounted(spark, sf, "orders")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS remote LOCATION '{wb.root}/remote'")
    wb.mount("remote.lineitem", f"{sf}/lineitem.parquet")
    target = cache.cache_table(wb, "remote.lineitem", "Main DB", "items by order", keys=["l_orderkey", "l_partkey"]).target
    orders = wb.table("imports.orders")
    customers = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_custkey")
    return cache.lookup(wb, target, "l_orderkey", orders.join(customers, "o_custkey", "left_semi").select("o_orderkey"))


@query("table_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def table_preview(spark, sf):
    return catalog.table_preview(mounted(spark, sf, "orders").table("imports.orders"), ["o_orderkey"])


@query(
    "catalog_tables",
    """SELECT table_schema, table_name, table_type, n_rows FROM (SELECT 'bronze' AS table_schema, 'listed_orders' AS table_name,
    'VIEW' AS table_type, count(*) AS n_rows FROM orders UNION ALL SELECT 'silver', 'listed_customers', 'BASE TABLE', count(*) FROM customer)""",
)
def catalog_tables(spark, sf):
    wb = mounted(spark, sf, "orders", "customer")
    cells.transform(wb, "SELECT * FROM imports.orders", "bronze", "listed_orders", "view")
    cells.transform(wb, "SELECT * FROM imports.customer", "silver", "listed_customers")
    return object_counts(wb, catalog.catalog_tables(wb).where(F.col("table_name").startswith("listed_")))


def object_counts(wb, listing):
    """A short listing of catalog objects with the rows of each."""
    counts = [
        wb.table(f"{o.table_schema}.{o.table_name}").agg(F.count(F.lit(1)).alias("n_rows")).select(
            *[F.lit(o[c]).alias(c) for c in listing.columns], "n_rows"
        )
        for o in listing.collect()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "catalog_columns",
    """SELECT 'c_custkey' AS column_name, 'bigint' AS data_type, 1 AS ordinal, count(c_custkey) AS n_present FROM customer
    UNION ALL SELECT 'c_name', 'string', 2, count(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', 3, count(c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'double', 4, count(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', 5, count(c_mktsegment) FROM customer""",
)
def catalog_columns(spark, sf):
    wb = mounted(spark, sf, "customer")
    cells.transform(wb, "SELECT * FROM imports.customer", "silver", "described_customers")
    columns = catalog.catalog_columns(wb, ["silver.described_customers", "silver.no_such_table"])
    table = wb.table("silver.described_customers")
    present = table.agg(*[F.count(c).alias(c) for c in table.columns]).unpivot([], table.columns, "column_name", "n_present")
    return columns.join(present, "column_name").select("column_name", "data_type", "ordinal", "n_present")


# -- sinks ---------------------------------------------------------------------------------------


@query("export_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def export_csv(spark, sf):
    return export.export_csv(read(spark, sf, "documents"), scratch_path(spark, "export"))


def _csv_field(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",\\n\\r]') THEN concat('"', replace({c}, '"', '""'), '"') ELSE {c} END"""


@query(
    "export_csv_minimal",
    f"""SELECT concat(event_id, ',', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z,', coalesce(CAST(nullif(user_id, 3) AS varchar), ''), ',',
    {_csv_field('event_type')}, ',', {js_number('value')}, ',', {_csv_field('props')}) AS line, false AS is_header FROM events
    UNION ALL SELECT 'event_id,ts,user_id,event_type,value,props', true""",
)
def export_csv_minimal(spark, sf):
    e = read(spark, sf, "events").withColumn("user_id", F.nullif("user_id", F.lit(3)))
    folder = scratch_path(spark, "csv")
    export.write_csv_text(e, folder)
    return export.read_csv_text(spark, folder)


@query(
    "export_csv_quoted",
    f"""SELECT concat('"', event_id, '","', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z","', coalesce(CAST(nullif(user_id, 3) AS varchar), ''), '","',
    event_type, '","', {js_number('value')}, '","', replace(props, '"', '""'), '"') AS line, false AS is_header FROM events
    UNION ALL SELECT '"event_id","ts","user_id","event_type","value","props"', true""",
)
def export_csv_quoted(spark, sf):
    e = read(spark, sf, "events").withColumn("user_id", F.nullif("user_id", F.lit(3)))
    folder = scratch_path(spark, "csv")
    export.write_csv_text(e, folder, quote_all=True)
    return export.read_csv_text(spark, folder)


@query(
    "insert_dump",
    f"""SELECT CAST((rn - 1) // 100 AS bigint) AS batch_no, concat('INSERT INTO "main"."customer" ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") VALUES', chr(10),
    string_agg(concat('(', c_custkey, ', ''', c_name, ''', ', c_nationkey, ', ', {js_number('c_acctbal')}, ', ''', c_mktsegment, ''')'),
    concat(',', chr(10)) ORDER BY rn), ';') AS statement
    FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) GROUP BY (rn - 1) // 100""",
)
def insert_dump(spark, sf):
    return export.insert_dump(read(spark, sf, "customer"), "main.customer", [F.col("c_acctbal").desc(), "c_custkey"])


@query(
    "json_safe_rows",
    f"""SELECT concat('{{"doc_id":', doc_id, ',"big":"', 9007199254740993 + doc_id, '","text":', to_json(text), ',"lang":', CASE WHEN lang = 'en' THEN 'null' ELSE to_json(lang) END,
    ',"ratio":', CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE {js_number('(n_chars / 4)')} END, ',"pair":[', doc_id, ',', n_chars, ']}}') AS json FROM documents""",
)
def json_safe_rows(spark, sf):
    d = read(spark, sf, "documents").select(
        "doc_id",
        (F.lit(9007199254740993) + F.col("doc_id")).alias("big"),
        "text",
        F.nullif("lang", F.lit("en")).alias("lang"),
        F.when(F.col("doc_id") % 2 == 0, float("inf")).otherwise(F.col("n_chars") / 4).alias("ratio"),
        F.array("doc_id", "n_chars").alias("pair"),
    )
    return export.json_safe_rows(d)


@query(
    "backup_totals",
    """SELECT 'orders' AS table_name, count(*) AS n_rows, count(*) >= 10000 AS truncated FROM orders
    UNION ALL SELECT 'customer', count(*), count(*) >= 10000 FROM customer
    UNION ALL SELECT 'lineitem', count(*), count(*) >= 10000 FROM lineitem""",
)
def backup_totals(spark, sf):
    parts = [read(spark, sf, t).select(F.lit(t).alias("table_name")) for t in ("orders", "customer", "lineitem")]
    return export.backup_totals(parts[0].unionByName(parts[1]).unionByName(parts[2]), 10000)


# -- cells ---------------------------------------------------------------------------------------

CLEAN = """SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS decimal(12, 2)) AS quantity,
  CAST(l_extendedprice AS decimal(12, 2)) * (1 - CAST(l_discount AS decimal(4, 2))) AS net
  FROM {source} WHERE l_shipdate <= timestamp '2001-01-01 00:00:00'"""
REVENUE = """SELECT l_returnflag, l_linestatus, CAST(sum(quantity) AS double) AS sum_qty, CAST(sum(net) AS double) AS revenue,
  count(*) AS n FROM {source} GROUP BY l_returnflag, l_linestatus"""


def medallion(spark, sf):
    """Import lineitem, clean it to silver, aggregate it to gold."""
    wb = workbench(spark)
    files.import_file(wb, f"{sf}/lineitem.parquet", name="lineitem_raw")
    cells.transform(wb, CLEAN.format(source="bronze.raw__file__lineitem_raw"), "silver", "lineitem_clean")
    return cells.transform(wb, REVENUE.format(source="silver.lineitem_clean"), "gold", "revenue_by_flag")


@query("transform_table", REVENUE.format(source=f"({CLEAN.format(source='lineitem')})"))
def transform_table(spark, sf):
    return medallion(spark, sf).preview


@query("transform_preview", REVENUE.format(source=f"({CLEAN.format(source='lineitem')})") + " LIMIT 200")
def transform_preview(spark, sf):
    done = medallion(spark, sf)
    return cells.preview(workbench(spark), done.fqn)


@query("materialize_row_count", f"SELECT count(*) AS n, count(*) AS written FROM ({CLEAN.format(source='lineitem')})")
def materialize_row_count(spark, sf):
    wb = mounted(spark, sf, "lineitem")
    done = cells.transform(wb, CLEAN.format(source="imports.lineitem"), "silver", "counted")
    return cells.materialize_row_count(wb, done.fqn).withColumn("written", F.lit(done.rows).cast("bigint"))


@query("transform_view", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def transform_view(spark, sf):
    wb = mounted(spark, sf, "orders")
    sql = "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM imports.orders GROUP BY o_custkey"
    return wb.table(cells.transform(wb, sql, "silver", "order_totals", "view").fqn)


@query("transform_self", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000")
def transform_self(spark, sf):
    """A cell that replaces the table it reads."""
    wb = mounted(spark, sf, "orders")
    cells.transform(wb, "SELECT * FROM imports.orders WHERE o_orderstatus <> 'F'", "silver", "self_read")
    cells.transform(wb, "SELECT o_orderkey, o_custkey FROM silver.self_read WHERE o_totalprice > 100000", "silver", "self_read")
    return wb.table("silver.self_read")


def _cells():
    return [
        cells.Cell("c1", "SELECT * FROM imports.customer WHERE c_acctbal > 0", "bronze", "good_customers"),
        cells.Cell("c2", "SELECT c_nationkey, count(*) AS n FROM bronze.good_customers GROUP BY c_nationkey;", "silver", "per_nation"),
        cells.Cell("c3", "DELETE FROM bronze.good_customers", "silver", "nothing"),
        cells.Cell("c4", "SELECT 1 AS x", "imports", "reserved"),
        cells.Cell("c5", "SELECT 'update' AS word, n FROM silver.per_nation", "gold", "shown", "view"),
        cells.Cell("c6", "SELECT * FROM imports.orders"),
        cells.Cell("c7", "some notes", kind="markdown"),
    ]


# Named `pipeline_run` in the plan of the work.
@query(
    "run_cells",
    """WITH good AS (SELECT * FROM customer WHERE c_acctbal > 0)
    SELECT 'c1' AS cell_id, 'good_customers' AS output_name, 'success' AS status, count(*) AS rows FROM good
    UNION ALL SELECT 'c2', 'per_nation', 'success', count(DISTINCT c_nationkey) FROM good
    UNION ALL SELECT 'c3', 'nothing', 'error', NULL UNION ALL SELECT 'c4', 'reserved', 'error', NULL
    UNION ALL SELECT 'c5', 'shown', 'success', count(DISTINCT c_nationkey) FROM good
    UNION ALL SELECT 'c6', NULL, 'success', count(*) FROM orders""",
)
def run_cells(spark, sf):
    wb = mounted(spark, sf, "customer", "orders")
    return cells.run_cells(wb, _cells(), "notebooks/check").select("cell_id", "output_name", "status", "rows")


@query(
    "run_log_append",
    """WITH good AS (SELECT * FROM customer WHERE c_acctbal > 0)
    SELECT 'c1' AS cell_id, 'success' AS status, count(*) AS rows FROM good
    UNION ALL SELECT 'c2', 'success', count(DISTINCT c_nationkey) FROM good""",
)
def run_log_append(spark, sf):
    wb = mounted(spark, sf, "customer")
    report = cells.run_cells(wb, _cells()[:2], "notebooks/logged")
    run_id = report.select("run_id").first()[0]
    return wb.table("ops.run_log").where(F.col("run_id") == run_id).select("cell_id", "status", "rows")


@query(
    "script_run",
    """SELECT 1 AS idx, 'success' AS status, 'tabular' AS kind, least(count(*), 10000) AS row_count, count(*) > 10000 AS capped FROM orders
    UNION ALL SELECT 2, 'success', 'non_tabular', NULL, NULL UNION ALL SELECT 3, 'success', 'tabular', 50, false
    UNION ALL SELECT 4, 'error', NULL, NULL, NULL UNION ALL SELECT 5, 'skipped', NULL, NULL, NULL""",
)
def script_run(spark, sf):
    wb = mounted(spark, sf, "orders")
    wb.drop("bronze.script_orders")
    statements = [
        "SELECT * FROM imports.orders",
        "CREATE VIEW bronze.script_orders AS SELECT * FROM imports.orders WHERE o_orderstatus = 'F';",
        "SELECT * FROM bronze.script_orders ORDER BY o_orderkey LIMIT 50",
        "SELECT no_such_column FROM imports.orders",
        "SELECT 1",
    ]
    return script.run_script(wb, statements).status.select("idx", "status", "kind", "row_count", "capped")


@query(
    "drop_object",
    """SELECT 'silver' AS table_schema, 'kept_orders' AS table_name, count(*) AS n_rows FROM orders""",
)
def drop_object(spark, sf):
    wb = mounted(spark, sf, "orders")
    files.import_file(wb, f"{sf}/orders.parquet", name="dropped_orders")
    cells.transform(wb, "SELECT * FROM imports.dropped_orders", "silver", "kept_orders")
    lifecycle.drop_object(wb, "imports.dropped_orders")
    left = catalog.catalog_tables(wb).where(F.col("table_name").rlike("(dropped|kept)_orders"))
    return object_counts(wb, left).select("table_schema", "table_name", "n_rows")
