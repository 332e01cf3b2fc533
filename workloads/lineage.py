"""Lineage of cells derived from given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import lineage
from strata.plans import cells as run
from strata.plans import lifecycle
from strata.session import cut
from workloads.registry import derive, mounted, query, stored, texts, with_inputs
from workloads.scalars import NOW, SQL_TEXTS, now

# One cell per order, in six shapes; a few are notes or aim at a layer that is not allowed.
CELLS = """
SELECT concat('p', o_custkey) AS pipeline_id, concat('c', o_orderkey) AS cell_id, o_orderkey AS ordinal,
  CASE WHEN o_orderkey % 11 = 0 THEN 'markdown' ELSE 'sql' END AS cell_type,
  CASE WHEN o_orderkey % 13 = 0 THEN 'imports' WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'silver' ELSE 'gold' END AS layer,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('out', o_orderkey) END AS output_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'view' ELSE 'table' END AS materialize,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('SELECT o.id, SUM(o.amount) AS total', chr(10), 'FROM bronze.a', o_custkey % 50, ' o JOIN silver.b', o_custkey % 50, ' AS c ON o.id = c.id -- FROM imports.no')
    WHEN 1 THEN concat('select id, upper(name) nm, amount * 2 AS twice from imports.src', o_custkey % 50, ' where name <> ''FROM gold.no''')
    WHEN 2 THEN concat('SELECT * FROM bronze.a', o_custkey % 50, ', silver.b', o_custkey % 50, ' x WHERE x.k = 1')
    WHEN 3 THEN concat('WITH t AS (SELECT id FROM data_cache.d', o_custkey % 50, ') SELECT coalesce(c.name, ''a, b'') nm, c.id, count(*), 5 AS five FROM bronze.a', o_custkey % 50, ' c /* JOIN gold.no */ FULL JOIN t USING (id)')
    WHEN 4 THEN concat('SELECT public.users.id FROM public.users u WHERE u.id IN (', o_custkey, ')')
    ELSE concat('SELECT CASE WHEN a', o_custkey % 50, '.flag THEN b.total ELSE silver.b9.net END AS total, b.id FROM bronze.a', o_custkey % 50, ' JOIN gold.g', o_custkey % 50, ' b ON 1 = 1') END AS sql
FROM {orders}
"""
LAYER = "coalesce(layer, 'bronze')"
GOOD = f"""SELECT *, {LAYER} AS lay, concat({LAYER}, '.', output_name) AS fqn, ordinal % 6 AS shape, CAST(substr(pipeline_id, 2) AS integer) % 50 AS m
  FROM cells WHERE cell_type = 'sql' AND output_name IS NOT NULL AND {LAYER} <> 'imports'"""
# What each shape reads.
READS = """SELECT pipeline_id, cell_id, fqn, concat(p, m) AS source FROM good JOIN (VALUES
  (0, 'bronze.a'), (0, 'silver.b'), (1, 'imports.src'), (2, 'bronze.a'), (2, 'silver.b'), (3, 'data_cache.d'), (3, 'bronze.a'),
  (5, 'bronze.a'), (5, 'gold.g')) v(s, p) ON s = shape"""
# Columns of the outputs; some are missing from the catalog.
OUT_COLUMNS = "\nUNION ALL ".join(
    f"""SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'bronze' WHEN o_orderkey % 2 = 0 THEN 'silver' ELSE 'gold' END AS table_schema,
  concat('out', o_orderkey) AS table_name, '{name}' AS column_name, 'bigint' AS data_type FROM {{orders}} WHERE o_orderkey % {gap} <> 2"""
    for name, gap in (("id", 1), ("total", 4), ("nm", 1), ("five", 3), ("other", 5))
)


@query(
    "lineage_table_edges",
    with_inputs(
        f""", good AS ({GOOD}) SELECT pipeline_id, cell_id, source, fqn AS target, 'sql_ref' AS reason FROM ({READS})""", cells=CELLS
    ).replace(")\n, good", "),\ngood"),
)
def lineage_table_edges(spark, sf):
    return lineage.lineage_table_edges(texts(spark, sf, CELLS))


# Expected items by shape: table prefix, column, output column, expression, confidence.
REFS = """SELECT pipeline_id, cell_id, CASE WHEN p LIKE '%.b9' THEN p ELSE concat(p, m) END AS source, c AS source_column, fqn AS target, o AS target_column,
  replace(e, '#', CAST(m AS varchar)) AS transform, f AS confidence, 'select_expr' AS reason
FROM good JOIN (VALUES
  (0, 'bronze.a', 'id', 'id', 'o.id', 0.9::double), (0, 'bronze.a', 'amount', 'total', 'SUM(o.amount)', 0.8),
  (1, 'imports.src', 'id', 'id', 'id', 0.6), (1, 'imports.src', 'name', 'nm', 'upper(name)', 0.8),
  (3, 'bronze.a', 'name', 'nm', 'coalesce(c.name, ''a, b'')', 0.8), (3, 'bronze.a', 'id', 'id', 'c.id', 0.9),
  (5, 'bronze.a', 'flag', 'total', 'CASE WHEN a#.flag THEN b.total ELSE silver.b9.net END', 0.5),
  (5, 'gold.g', 'total', 'total', 'CASE WHEN a#.flag THEN b.total ELSE silver.b9.net END', 0.5),
  (5, 'silver.b9', 'net', 'total', 'CASE WHEN a#.flag THEN b.total ELSE silver.b9.net END', 0.5), (5, 'gold.g', 'id', 'id', 'b.id', 0.9)
  ) v(s, p, c, o, e, f) ON s = shape
WHERE (lay, output_name, o) IN (SELECT table_schema, table_name, column_name FROM cols)"""
EDGES = f"""{REFS} UNION ALL SELECT pipeline_id, cell_id, concat(p, m), '*', fqn, '*', '*', 0.4::double, 'wildcard'
  FROM good JOIN (VALUES (2, 'bronze.a'), (2, 'silver.b')) v(s, p) ON s = shape"""


def cell_check(body: str) -> str:
    return with_inputs(
        f", good AS ({GOOD}), edges AS ({EDGES}), reads AS ({READS}) {body}", cells=CELLS, cols=OUT_COLUMNS
    ).replace(")\n, good", "),\ngood")


@query("lineage_column_edges", cell_check("SELECT * FROM edges"))
def lineage_column_edges(spark, sf):
    return lineage.lineage_column_edges(texts(spark, sf, CELLS), derive(spark, sf, OUT_COLUMNS))


TABLE_NODES = """SELECT pipeline_id, fqn, CASE WHEN materialize = 'view' THEN 'view' ELSE 'table' END AS node_type, cell_id FROM good
  UNION ALL SELECT DISTINCT pipeline_id, source, 'source', NULL FROM reads"""


@query("lineage_nodes", cell_check(TABLE_NODES))
def lineage_nodes(spark, sf):
    return lineage.lineage_table_nodes(texts(spark, sf, CELLS))


COLUMN_NODES = """SELECT pipeline_id, fqn AS table_fqn, column_name, data_type FROM good JOIN cols ON table_schema = lay AND table_name = output_name
  UNION ALL SELECT DISTINCT pipeline_id, source, source_column, 'unknown' FROM edges WHERE reason = 'select_expr'"""


@query("lineage_column_nodes", cell_check(COLUMN_NODES))
def lineage_column_nodes(spark, sf):
    return lineage.lineage_column_nodes(texts(spark, sf, CELLS), derive(spark, sf, OUT_COLUMNS))


@query(
    "lineage_valid_edges",
    cell_check(
        f""", nodes AS ({TABLE_NODES}), cn AS ({COLUMN_NODES}) SELECT *, CASE WHEN length(full_text) > 20 THEN concat(substr(full_text, 1, 19), '...') ELSE full_text END AS label
        FROM (SELECT *, CASE WHEN transform <> '*' AND transform <> source_column THEN transform END AS full_text FROM edges
          WHERE (pipeline_id, source) IN (SELECT pipeline_id, fqn FROM nodes) AND (source_column = '*' OR (pipeline_id, source, source_column) IN (SELECT pipeline_id, table_fqn, column_name FROM cn)))
        """.replace("SELECT *, CASE WHEN length", "SELECT pipeline_id, cell_id, source, source_column, target, target_column, transform, confidence, reason, CASE WHEN length")
    ),
)
def lineage_valid_edges(spark, sf):
    found, columns = texts(spark, sf, CELLS), derive(spark, sf, OUT_COLUMNS)
    edges = cut(lineage.lineage_column_edges(found, columns), "edges")
    nodes = cut(lineage.lineage_table_nodes(found), "nodes")
    ends = cut(lineage.lineage_column_nodes(found, columns, edges), "ends")
    return lineage.lineage_valid_edges(edges, nodes, ends)


@query(
    "table_refs",
    with_inputs(
        """SELECT qid, concat(p, m) AS table_ref FROM (SELECT qid, qid % 10 AS shape, o_custkey % 40 AS m FROM texts JOIN orders ON o_orderkey = qid)
        JOIN (VALUES (0, 'bronze.ent'), (1, 'imports.src'), (3, 'silver.ent'), (4, 'gold.ent'), (4, 'silver.ent'), (6, 'gold.ent'), (7, 'data_cache.d')) v(s, p) ON s = shape""",
        texts=SQL_TEXTS,
    ),
)
def table_refs(spark, sf):
    return lineage.table_refs(texts(spark, sf, SQL_TEXTS), "qid")


@query(
    "select_items",
    cell_check(
        """SELECT cell_id, p AS position, replace(e, '#', CAST(CAST(substr(pipeline_id, 2) AS integer) % 50 AS varchar)) AS expression, a AS alias, f AS confidence, a = '*' AS is_wildcard
        FROM cells JOIN (VALUES (0, 0, 'o.id', 'id', 0.9::double), (0, 1, 'SUM(o.amount)', 'total', 0.8), (1, 0, 'id', 'id', 0.6), (1, 1, 'upper(name)', 'nm', 0.8),
        (1, 2, 'amount * 2', 'twice', 0.5), (2, 0, '*', '*', 0.4), (3, 0, 'coalesce(c.name, ''a, b'')', 'nm', 0.8), (3, 1, 'c.id', 'id', 0.9),
        (3, 2, 'count(*)', '__unnamed_2', 0.8), (3, 3, '5', 'five', 0.6), (4, 0, 'public.users.id', 'id', 0.5),
        (5, 0, 'CASE WHEN a#.flag THEN b.total ELSE silver.b9.net END', 'total', 0.5), (5, 1, 'b.id', 'id', 0.9)) v(s, p, e, a, f) ON s = ordinal % 6"""
    ),
)
def select_items(spark, sf):
    return lineage.select_items(texts(spark, sf, CELLS), "cell_id")


# Table nodes of many pipelines, and the tables that exist.
NODES = """
SELECT concat('p', o_custkey) AS pipeline_id, concat(lay, '.t', o_custkey % 300) AS fqn, lay AS schema_name, concat('t', o_custkey % 300) AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'missing' WHEN 2 THEN 'deleted' END AS status,
  CASE WHEN o_orderkey % 4 = 2 THEN o_orderdate END AS deleted_at, CASE WHEN o_orderkey % 4 = 2 THEN 'user' END AS deleted_by,
  CASE WHEN o_orderkey % 5 > 0 THEN concat('c', o_orderkey) END AS cell_id
FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 'imports' WHEN 1 THEN 'gold' WHEN 2 THEN 'gold' WHEN 3 THEN 'silver' WHEN 4 THEN 'silver' ELSE 'bronze' END AS lay FROM {orders}) o
"""
EXISTING = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS table_schema, concat('t', c_custkey) AS table_name FROM {customer}
"""


def _marked(hit: str, by: str) -> str:
    return f"""SELECT pipeline_id, fqn, schema_name, name, CASE WHEN {hit} THEN 'deleted' ELSE status END AS status,
    CASE WHEN {hit} THEN {NOW} ELSE deleted_at END AS deleted_at, CASE WHEN {hit} THEN '{by}' ELSE deleted_by END AS deleted_by, cell_id FROM nodes"""


@query("mark_deleted", with_inputs(_marked("fqn = 'silver.t17'", "user"), nodes=NODES))
def mark_deleted(spark, sf):
    return lineage.mark_deleted(derive(spark, sf, NODES), "user", now(), fqn="silver.t17")


@query("mark_layer_deleted", with_inputs(_marked("schema_name = 'gold'", "system"), nodes=NODES))
def mark_layer_deleted(spark, sf):
    return lineage.mark_deleted(derive(spark, sf, NODES), "system", now(), layer="gold")


@query(
    "reconcile_lineage",
    with_inputs(
        """SELECT pipeline_id, fqn, schema_name, name, CASE WHEN found THEN 'present' WHEN managed AND status IS DISTINCT FROM 'deleted' THEN 'missing' ELSE status END AS status,
        CASE WHEN NOT found THEN deleted_at END AS deleted_at, CASE WHEN NOT found THEN deleted_by END AS deleted_by, cell_id
        FROM (SELECT *, schema_name <> 'imports' AS managed, schema_name <> 'imports' AND fqn IN (SELECT concat(table_schema, '.', table_name) FROM there) AS found FROM nodes)""",
        nodes=NODES,
        there=EXISTING,
    ),
)
def reconcile_lineage(spark, sf):
    return lineage.reconcile_lineage(stored(spark, sf, NODES), derive(spark, sf, EXISTING))


# Column edges between numbered tables: lines of an order point from parts to orders, so there
# are diamonds and cycles.
GRAPH = """
SELECT concat('silver.t', l_partkey) AS source, concat('c', l_linenumber % 2) AS source_column, concat('silver.t', l_orderkey) AS target,
  concat('c', l_suppkey % 2) AS target_column FROM {lineitem}
"""
START = "SELECT max(target) AS t, min(target_column) AS c FROM {graph} g WHERE target = (SELECT max(target) FROM {graph} h)"
REACHED = f"""reached(t, c) AS (({START.format(graph='graph')}) UNION SELECT g.source, g.source_column FROM graph g JOIN reached ON g.target = t AND g.target_column = c)"""


def _trace_check(body: str) -> str:
    return with_inputs(body, graph=GRAPH).replace("WITH graph", "WITH RECURSIVE graph").replace(")\n, reached", "),\nreached")


@query("upstream_trace", _trace_check(f", {REACHED} SELECT t AS table_fqn, c AS column_name FROM reached"))
def upstream_trace(spark, sf):
    graph = derive(spark, sf, GRAPH)
    columns, _ = lineage.upstream_trace(graph, *spark.sql(START, graph=graph).first())
    return columns.select("table_fqn", "column_name")


@query(
    "upstream_trace_edges",
    _trace_check(f", {REACHED} SELECT DISTINCT g.* FROM graph g JOIN reached ON g.target = t AND g.target_column = c"),
)
def upstream_trace_edges(spark, sf):
    graph = derive(spark, sf, GRAPH)
    return lineage.upstream_trace(graph, *spark.sql(START, graph=graph).first())[1]


# All columns of the twenty last tables at once.
STARTS = """SELECT DISTINCT target AS table_fqn, target_column AS column_name FROM {graph} g WHERE CAST(substr(target, 9) AS bigint) >
  (SELECT max(CAST(substr(target, 9) AS bigint)) - 20 FROM {graph} h)"""


@query(
    "upstream_traces",
    with_inputs(
        f"""SELECT * FROM (WITH RECURSIVE reached(start_table, start_column, t, c, distance) USING KEY (start_table, start_column, t, c) AS (
          SELECT table_fqn, column_name, table_fqn, column_name, 0 FROM ({STARTS.format(graph='graph')})
          UNION SELECT r.start_table, r.start_column, g.source, g.source_column, min(r.distance) + 1 FROM graph g JOIN reached r ON g.target = r.t AND g.target_column = r.c
            LEFT JOIN recurring.reached x ON x.start_table = r.start_table AND x.start_column = r.start_column AND x.t = g.source AND x.c = g.source_column
          WHERE x.t IS NULL GROUP BY ALL)
        SELECT start_table, start_column, t AS table_fqn, c AS column_name, distance FROM reached)""",
        graph=GRAPH,
    ),
)
def upstream_traces(spark, sf):
    graph = derive(spark, sf, GRAPH)
    return lineage.upstream_traces(graph, spark.sql(STARTS, graph=graph))


# -- lifecycle -----------------------------------------------------------------------------------


# Named `reset_pipeline` in the plan of the work.
@query(
    "reset_outputs",
    """SELECT 'gold.reset_a' AS fqn, 'deleted' AS status, 'system' AS deleted_by, 0 AS n_rows FROM (SELECT count(*) FROM customer)
    UNION ALL SELECT 'silver.reset_b', 'deleted', 'system', 0 UNION ALL SELECT 'silver.reset_c', 'present', NULL, (SELECT count(*) FROM orders)""",
)
def reset_outputs(spark, sf):
    wb = mounted(spark, sf, "customer", "orders")
    for layer, name, source in (("gold", "reset_a", "customer"), ("silver", "reset_b", "orders"), ("silver", "reset_c", "orders")):
        run.transform(wb, f"SELECT * FROM imports.{source}", layer, name)
    nodes = spark.createDataFrame(
        [
            ("p1", "gold.reset_a", "gold", "present", None, None, "c1"),
            ("p1", "silver.reset_b", "silver", "present", None, None, "c2"),
            ("p1", "silver.reset_c", "silver", "present", None, None, None),
        ],
        "pipeline_id string, fqn string, schema_name string, status string, deleted_at timestamp, deleted_by string, cell_id string",
    )
    _, marked = lifecycle.reset_outputs(wb, nodes, "p1")
    # Rows of each output that is still there.
    left = {t: wb.table(t) for t in ("gold.reset_a", "silver.reset_b", "silver.reset_c") if wb.exists(t)}
    counts = [df.select(F.lit(t).alias("fqn")) for t, df in left.items()]
    kept = reduce(DataFrame.unionByName, counts).groupBy("fqn").agg(F.count(F.lit(1)).alias("_n"))
    rows = marked.join(kept, "fqn", "left")
    return rows.select("fqn", "status", "deleted_by", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_rows"))
