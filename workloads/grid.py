"""The result grid, charts, ranks and history over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import grid, history, metadata, profile
from strata.operators.spread import number_rows, number_sorted
from workloads.registry import derive, query, read, with_inputs
from workloads.scalars import NOW, now


@query(
    "row_cap",
    """SELECT o_orderkey, o_totalprice, true AS clamped, 10000 AS effective_limit FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10000""",
)
def row_cap(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")
    capped = grid.row_cap(df, user_limit=12000)
    return capped.rows.select("*", F.lit(capped.clamped).alias("clamped"), F.lit(capped.effective_limit).alias("effective_limit"))


@query(
    "grid_filter",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE contains(lower(o_orderpriority), 'igh') AND o_totalprice >= 250000 AND o_orderstatus <> 'F'""",
)
def grid_filter(spark, sf):
    df = read(spark, sf, "orders")
    spec = {"o_orderpriority": ("contains", "IGH"), "o_totalprice": (">=", 250000), "o_orderstatus": ("!=", "F")}
    return grid.grid_filter(df, spec).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "grid_sort",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS position
    FROM orders""",
)
def grid_sort(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return number_sorted(grid.grid_sort(df, [("o_orderstatus", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")]), "position")


@query(
    "grid_page",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100 OFFSET 600""",
)
def grid_page(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    keys = [("l_extendedprice", "desc")] + [(c, "asc") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return grid.grid_page(df, keys, 7)


@query(
    "grid_page_indexed",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey
    LIMIT 200 OFFSET (SELECT count(*) // 200 * 100 FROM lineitem)""",
)
def grid_page_indexed(spark, sf):
    """Two pages from the middle of a stored index."""
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    keys = [("l_extendedprice", "desc")] + [(c, "asc") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    index = grid.page_index(df, keys)
    page = index.count() // 200 + 1
    return grid.indexed_page(index, page).unionByName(grid.indexed_page(index, page + 1))


@query(
    "chart_series",
    """SELECT o_orderpriority AS label, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE CAST(o_custkey AS double) END AS shown
    FROM orders""",
)
def chart_series(spark, sf):
    shown = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), "o_custkey", F.lit("e0 ")))
    df = read(spark, sf, "orders").select("o_orderpriority", "o_totalprice", shown.alias("shown"))
    return grid.chart_series(df, label="no_such", series=["o_totalprice", "shown"])


@query(
    "chart_long",
    """SELECT p_brand AS label, 'p_partkey' AS series, CAST(p_partkey AS double) AS value FROM part
    UNION ALL SELECT p_brand, 'p_size', CAST(p_size AS double) FROM part
    UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part""",
)
def chart_long(spark, sf):
    return grid.chart_long(read(spark, sf, "part"), label="p_brand")


@query(
    "dump_batches",
    """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 100 AS bigint) AS batch_no FROM orders""",
)
def dump_batches(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return grid.number_batches(df, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "batch_no")


@query(
    "row_numbers",
    """SELECT event_id, row_number() OVER (ORDER BY event_type DESC, value, event_id) AS row_no FROM events""",
)
def row_numbers(spark, sf):
    df = read(spark, sf, "events").select("event_id", "event_type", "value")
    order = [F.col("event_type").desc(), F.col("value"), F.col("event_id")]
    return number_rows(df, order).select("event_id", "row_no")


@query(
    "history_retention",
    f"""SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn
    FROM events) WHERE rn <= 20 OR ts > {NOW} - INTERVAL 7 DAY""",
)
def history_retention(spark, sf):
    df = read(spark, sf, "events").select("event_id", "user_id", "ts")
    return history.retain(df, "ts", "event_id", now(), by=["user_id"])


@query(
    "bucket_counts",
    """SELECT CASE WHEN ts >= timestamp '2024-01-20' THEN 'Today' WHEN ts >= timestamp '2024-01-19' THEN 'Yesterday'
    WHEN ts >= timestamp '2024-01-13' THEN 'Last 7 Days' WHEN ts >= timestamp '2023-12-21' THEN 'Last 30 Days'
    ELSE 'Older' END AS bucket, count(*) AS n FROM events GROUP BY bucket""",
)
def bucket_counts(spark, sf):
    return history.bucket_counts(read(spark, sf, "events"), "ts", now())


SNAPSHOTS = """
SELECT concat('conn', user_id) AS connection_id, event_id AS load_order, CAST(floor(value / 10) AS bigint) AS n_schemas FROM {events}
"""


@query(
    "latest_snapshot",
    with_inputs(
        """SELECT connection_id, load_order, n_schemas FROM (SELECT *, row_number() OVER
        (PARTITION BY connection_id ORDER BY n_schemas DESC, load_order) AS rn FROM snaps) WHERE rn = 1""",
        snaps=SNAPSHOTS,
    ),
)
def latest_snapshot(spark, sf):
    return metadata.latest_snapshot(derive(spark, sf, SNAPSHOTS))


@query(
    "dedupe_latest",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def dedupe_latest(spark, sf):
    df = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return metadata.dedupe_latest(df, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


MIXED = """
SELECT event_id,
  CASE WHEN event_id % 50 < 3 THEN NULL WHEN event_id < 5 THEN 'true' ELSE concat(event_id, '') END AS a,
  CASE WHEN event_id < 7 THEN NULL ELSE concat(value, '') END AS b,
  CASE WHEN event_id = 0 THEN NULL ELSE event_type END AS c,
  CASE WHEN event_id < 3 THEN NULL WHEN event_id % 2 = 1 THEN 'False' ELSE 'x' END AS d,
  CASE WHEN event_id < 2 THEN NULL ELSE concat('2024-01-0', event_id % 9 + 1, 'T10:00:00.000Z') END AS e,
  CASE WHEN event_id < 0 THEN 'never' END AS f FROM {events}
"""


@query(
    "first_nonnull_type",
    with_inputs(
        """SELECT column_name, coalesce(CASE WHEN lower(x) IN ('true', 'false') THEN 'boolean'
        WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(x, '^[+-]?[0-9]+\\.[0-9]*$') THEN 'decimal'
        WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}') THEN 'timestamp' WHEN x IS NOT NULL THEN 'varchar' END, 'unknown') AS type
        FROM (SELECT 'a' AS column_name, arg_min(a, event_id) FILTER (a IS NOT NULL) AS x FROM mixed
        UNION ALL SELECT 'b', arg_min(b, event_id) FILTER (b IS NOT NULL) FROM mixed
        UNION ALL SELECT 'c', arg_min(c, event_id) FILTER (c IS NOT NULL) FROM mixed
        UNION ALL SELECT 'd', arg_min(d, event_id) FILTER (d IS NOT NULL) FROM mixed
        UNION ALL SELECT 'e', arg_min(e, event_id) FILTER (e IS NOT NULL) FROM mixed
        UNION ALL SELECT 'f', arg_min(f, event_id) FILTER (f IS NOT NULL) FROM mixed)""".replace("\\\\", "\\"),
        mixed=MIXED,
    ),
)
def first_nonnull_type(spark, sf):
    return profile.first_nonnull_type(derive(spark, sf, MIXED), ["a", "b", "c", "d", "e", "f"], "event_id")


# Statement results: one script per user, one statement per event.
STATEMENTS = """
SELECT user_id AS script_id, event_id AS idx,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status,
  CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS bigint) END AS elapsed_ms,
  CASE WHEN event_type = 'click' THEN CAST(event_id % 10 AS bigint) END AS affected_rows,
  event_type = 'purchase' AS is_tabular FROM {events}
"""


@query(
    "script_summary",
    with_inputs(
        """SELECT script_id, count(*) AS total, count(*) FILTER (status <> 'skipped') AS executed,
        count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'error') AS failed,
        count(*) FILTER (status = 'skipped') AS skipped, min(idx) FILTER (status = 'error') AS failed_at,
        CAST(coalesce(sum(elapsed_ms), 0) AS bigint) AS elapsed_ms FROM st GROUP BY script_id""",
        st=STATEMENTS,
    ),
)
def script_summary(spark, sf):
    return history.script_summary(derive(spark, sf, STATEMENTS), ["script_id"])


@query(
    "affected_rows_total",
    with_inputs(
        """SELECT script_id, CAST(coalesce(sum(affected_rows), 0) AS bigint) AS affected_rows,
        count(*) FILTER (is_tabular) AS n_tabular, CASE WHEN count(*) FILTER (is_tabular) > 1 THEN
        concat(count(*) FILTER (is_tabular), ' statements gave rows; the first of them is shown.') END AS warning
        FROM st GROUP BY script_id""",
        st=STATEMENTS,
    ),
)
def affected_rows_total(spark, sf):
    return history.affected_rows_total(derive(spark, sf, STATEMENTS), ["script_id"])
