"""Catalog rows, relationships and registries derived from given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import metadata, relations
from workloads.registry import derive, query, read, stored, with_inputs
from workloads.scalars import NOW, now

# Every order is a table or view; its columns come from its lines and point to other tables by
# name. Table names come as x, xs and xes.
OBJECTS = """
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS table_schema,
  concat('Ent', o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 's' WHEN 1 THEN 'es' ELSE '' END) AS table_name,
  CASE WHEN o_orderstatus = 'F' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM {orders}
"""
LINES = "SELECT l_orderkey, l_partkey, min(l_linenumber) AS ln, min(l_suppkey) AS supp FROM {lineitem} GROUP BY l_orderkey, l_partkey"
COLUMNS = f"""
SELECT table_schema, table_name, CASE WHEN k % 7 = 0 THEN 'ID' ELSE 'id' END AS column_name, 'bigint' AS data_type, 'NO' AS is_nullable, 1 AS ordinal
  FROM ({OBJECTS}) o WHERE k % 4 <> 0
UNION ALL
SELECT table_schema, table_name, concat('ent', l_partkey, '_id'), CASE WHEN l_partkey % 2 = 0 THEN 'integer' ELSE 'character varying' END, 'YES', ln + 1
  FROM ({OBJECTS}) o JOIN ({LINES}) l ON l_orderkey = k
"""
TYPES = f"SELECT table_schema, table_name, table_type FROM ({OBJECTS}) o WHERE k % 6 <> 5"
FOREIGN = f"""
SELECT c.table_schema, c.table_name, concat('ent', l.l_partkey, '_id') AS column_name, p.table_schema AS foreign_schema,
  p.table_name AS foreign_table, 'id' AS foreign_column
FROM ({OBJECTS}) c JOIN ({LINES}) l ON l.l_orderkey = c.k JOIN ({OBJECTS}) p ON p.k = l.l_partkey WHERE c.k % 10 = 3
"""
SHORT_TYPE = "CASE data_type WHEN 'bigint' THEN 'int8' WHEN 'integer' THEN 'int' WHEN 'character varying' THEN 'varchar' END"


@query(
    "column_kind_join",
    with_inputs(
        f"""SELECT c.table_schema, c.table_name, column_name, is_nullable, ordinal, {SHORT_TYPE} AS data_type,
        coalesce(table_type, 'BASE TABLE') AS table_type FROM cols c LEFT JOIN types t
        ON t.table_schema = c.table_schema AND t.table_name = c.table_name""",
        cols=COLUMNS,
        types=TYPES,
    ),
)
def column_kind_join(spark, sf):
    return metadata.column_kind_join(derive(spark, sf, COLUMNS), derive(spark, sf, TYPES))


@query(
    "tables_and_views",
    with_inputs(
        """SELECT DISTINCT c.table_schema, c.table_name, coalesce(table_type, 'BASE TABLE') = 'VIEW' AS is_view FROM cols c LEFT JOIN types t
        ON t.table_schema = c.table_schema AND t.table_name = c.table_name""",
        cols=COLUMNS,
        types=TYPES,
    ),
)
def tables_and_views(spark, sf):
    return metadata.tables_and_views(column_kind_join(spark, sf))


@query(
    "schema_object_counts",
    with_inputs("SELECT table_schema, count(DISTINCT table_name) AS n_objects FROM cols GROUP BY table_schema", cols=COLUMNS),
)
def schema_object_counts(spark, sf):
    return metadata.schema_object_counts(tables_and_views(spark, sf))


CONSTRAINTS = """
SELECT 'db' AS constraint_schema, 'silver' AS table_schema, concat('t', o_orderkey) AS table_name, concat('pk_', o_orderkey) AS constraint_name,
  'PRIMARY KEY' AS constraint_type FROM {orders}
UNION ALL SELECT 'db', 'silver', concat('t', l_orderkey), concat('fk_', l_orderkey, '_', l_partkey), 'FOREIGN KEY' FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'db', 'silver', concat('t', o_orderkey), concat('ck_', o_orderkey), 'CHECK' FROM {orders} WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'db', 'pg_catalog', concat('s', o_orderkey), concat('pk_s', o_orderkey), 'PRIMARY KEY' FROM {orders} WHERE o_orderkey % 50 = 0
"""
KEY_USAGE = """
SELECT 'db' AS constraint_schema, 'silver' AS table_schema, concat('t', o_orderkey) AS table_name, concat('pk_', o_orderkey) AS constraint_name,
  'id' AS column_name, 1 AS ordinal_position FROM {orders}
UNION ALL SELECT 'db', 'silver', concat('t', o_orderkey), concat('pk_', o_orderkey), 'tenant', 2 FROM {orders} WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'db', 'silver', concat('t', l_orderkey), concat('fk_', l_orderkey, '_', l_partkey), concat('t', l_partkey, '_id'), 1
  FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'db', 'silver', concat('t', l_orderkey), concat('fk_', l_orderkey, '_', l_partkey), 'tenant', 2
  FROM {lineitem} WHERE l_partkey % 2 = 0 GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'db', 'pg_catalog', concat('s', o_orderkey), concat('pk_s', o_orderkey), 'oid', 1 FROM {orders} WHERE o_orderkey % 50 = 0
"""
REFERENTIAL = """
SELECT 'db' AS constraint_schema, concat('fk_', l_orderkey, '_', l_partkey) AS constraint_name, 'db' AS unique_constraint_schema,
  concat('pk_', l_partkey) AS unique_constraint_name FROM {lineitem} GROUP BY l_orderkey, l_partkey
"""


@query(
    "constraint_join",
    """SELECT 'silver' AS table_schema, concat('t', o_orderkey) AS table_name, 'id' AS column_name, concat('pk_', o_orderkey) AS constraint_name,
      'PRIMARY KEY' AS constraint_type, NULL AS foreign_schema, NULL AS foreign_table, NULL AS foreign_column FROM orders
    UNION ALL SELECT 'silver', concat('t', o_orderkey), 'tenant', concat('pk_', o_orderkey), 'PRIMARY KEY', NULL, NULL, NULL FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT DISTINCT 'silver', concat('t', l_orderkey), concat('t', l_partkey, '_id'), concat('fk_', l_orderkey, '_', l_partkey), 'FOREIGN KEY',
      'silver', concat('t', l_partkey), 'id' FROM lineitem
    UNION ALL SELECT DISTINCT 'silver', concat('t', l_orderkey), 'tenant', concat('fk_', l_orderkey, '_', l_partkey), 'FOREIGN KEY',
      'silver', concat('t', l_partkey), 'tenant' FROM lineitem WHERE l_partkey % 2 = 0""",
)
def constraint_join(spark, sf):
    return metadata.constraint_join(*[derive(spark, sf, t) for t in (CONSTRAINTS, KEY_USAGE, REFERENTIAL)])


MARKED = """
SELECT 'silver' AS table_schema, concat('t', o_orderkey) AS table_name, 'id' AS column_name, 'PRI' AS column_key FROM {orders}
UNION ALL SELECT 'silver', concat('t', o_orderkey), 'tenant', CASE WHEN o_orderkey % 2 = 0 THEN 'pri' ELSE 'MUL' END FROM {orders}
UNION ALL SELECT 'information_schema', concat('s', o_orderkey), 'oid', 'PRI' FROM {orders} WHERE o_orderkey % 50 = 0
"""
LISTED = """
SELECT 'silver' AS table_schema, concat('t', l_orderkey) AS table_name, concat('t', l_partkey, '_id') AS column_name, concat('fk_', l_partkey) AS constraint_name,
  CASE WHEN l_partkey % 2 = 0 THEN 'gold' END AS referenced_table_schema, CASE WHEN l_partkey % 5 > 0 THEN concat('t', l_partkey) END AS referenced_table_name,
  'id' AS referenced_column_name FROM {lineitem} GROUP BY l_orderkey, l_partkey
"""


@query(
    "constraint_marks",
    """SELECT 'silver' AS table_schema, concat('t', o_orderkey) AS table_name, 'id' AS column_name, 'PRIMARY' AS constraint_name,
      'PRIMARY KEY' AS constraint_type, NULL AS foreign_schema, NULL AS foreign_table, NULL AS foreign_column FROM orders
    UNION ALL SELECT 'silver', concat('t', o_orderkey), 'tenant', 'PRIMARY', 'PRIMARY KEY', NULL, NULL, NULL FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT DISTINCT 'silver', concat('t', l_orderkey), concat('t', l_partkey, '_id'), concat('fk_', l_partkey), 'FOREIGN KEY',
      CASE WHEN l_partkey % 2 = 0 THEN 'gold' ELSE 'silver' END, concat('t', l_partkey), 'id' FROM lineitem WHERE l_partkey % 5 > 0""",
)
def constraint_marks(spark, sf):
    return metadata.constraint_marks(derive(spark, sf, MARKED), derive(spark, sf, LISTED))


INDEXES = """
SELECT 'silver' AS table_schema, concat('t', l_orderkey) AS table_name, concat('ix', l_suppkey % 3) AS index_name,
  min(l_linenumber) AS seq_in_index, concat('c', l_partkey) AS column_name, l_suppkey % 3 AS non_unique FROM {lineitem}
GROUP BY l_orderkey, l_suppkey % 3, l_partkey
"""


@query(
    "index_columns",
    with_inputs(
        """SELECT table_schema, table_name, index_name, string_agg(column_name, ',' ORDER BY seq_in_index, column_name) AS columns,
        max(non_unique) = 0 AS is_unique FROM ix GROUP BY table_schema, table_name, index_name""",
        ix=INDEXES,
    ),
)
def index_columns(spark, sf):
    return metadata.index_columns(derive(spark, sf, INDEXES))


SCHEMATA = """
SELECT CASE c_nationkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'memory' WHEN 2 THEN 'data_cache' ELSE concat('db', c_nationkey) END AS catalog_name,
  CASE c_custkey % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'information_schema' WHEN 2 THEN 'ops' WHEN 3 THEN 'gold' WHEN 4 THEN 'imports'
  ELSE concat('s', c_custkey % 30) END AS schema_name FROM {customer}
"""


@query(
    "visible_schemas",
    with_inputs(
        """, shown AS (SELECT DISTINCT CASE WHEN catalog_name IN ('own', 'memory') THEN schema_name WHEN schema_name = 'main' THEN catalog_name
          ELSE concat(catalog_name, '.', schema_name) END AS name FROM sch WHERE schema_name NOT IN ('information_schema', 'pg_catalog', 'ops')
          AND catalog_name <> 'data_cache' AND NOT (catalog_name IN ('own', 'memory') AND schema_name = 'main'))
        SELECT name, CASE name WHEN 'imports' THEN 0 WHEN 'data_cache' THEN 1 WHEN 'bronze' THEN 2 WHEN 'silver' THEN 3 WHEN 'gold' THEN 4 ELSE 5 END AS place
        FROM (SELECT name FROM shown UNION SELECT unnest(['imports', 'data_cache', 'bronze', 'silver', 'gold']))""",
        sch=SCHEMATA,
    ).replace(")\n, shown", "),\nshown"),
)
def visible_schemas(spark, sf):
    return metadata.visible_schemas(derive(spark, sf, SCHEMATA), "own")


# -- relationships -------------------------------------------------------------------------------

KNOWN = "(SELECT concat(table_schema, '.', table_name) AS t, column_name AS c FROM cols)"


@query(
    "declared_relationships",
    with_inputs(
        f"""SELECT DISTINCT concat(table_schema, '.', table_name) AS source, column_name AS source_column,
        concat(foreign_schema, '.', foreign_table) AS target, foreign_column AS target_column FROM fks
        WHERE (concat(foreign_schema, '.', foreign_table), foreign_column) IN (SELECT (t, c) FROM {KNOWN})""".replace(
            "(SELECT (t, c) FROM", "(SELECT t, c FROM"
        ),
        cols=COLUMNS,
        fks=FOREIGN,
    ),
)
def declared_relationships(spark, sf):
    return relations.declared_relationships(stored(spark, sf, COLUMNS), stored(spark, sf, FOREIGN))


INFERRED = """SELECT DISTINCT concat(s.table_schema, '.', s.table_name) AS source, s.column_name AS source_column,
  concat(t.table_schema, '.', t.table_name) AS target, arg_min(t.column_name, t.ordinal) AS target_column
FROM cols s JOIN cols t ON lower(t.table_name) IN (replace(lower(s.column_name), '_id', ''), replace(lower(s.column_name), '_id', 's'), replace(lower(s.column_name), '_id', 'es'))
  AND lower(t.column_name) IN ('id', lower(s.column_name)) AND (s.table_schema <> t.table_schema OR s.table_name <> t.table_name)
WHERE ends_with(lower(s.column_name), '_id') AND (s.table_schema, s.table_name) NOT IN (SELECT table_schema, table_name FROM fks)
GROUP BY s.table_schema, s.table_name, s.column_name, t.table_schema, t.table_name"""


@query("inferred_relationships", with_inputs(INFERRED, cols=COLUMNS, fks=FOREIGN))
def inferred_relationships(spark, sf):
    return relations.inferred_relationships(stored(spark, sf, COLUMNS), stored(spark, sf, FOREIGN))


@query(
    "key_flags",
    with_inputs(
        """SELECT c.*, lower(column_name) IN ('id', concat(lower(table_name), '_id'), concat(lower(table_name), 'id')) AS likely_pk,
        CASE WHEN (table_schema, table_name) IN (SELECT table_schema, table_name FROM fks) THEN (table_schema, table_name, column_name) IN (SELECT table_schema, table_name, column_name FROM fks)
        ELSE ends_with(lower(column_name), '_id') END AS likely_fk FROM cols c""",
        cols=COLUMNS,
        fks=FOREIGN,
    ),
)
def key_flags(spark, sf):
    return relations.key_flags(derive(spark, sf, COLUMNS), derive(spark, sf, FOREIGN))


# Custom edges: some repeat detected ones, some name a table or column that is not there.
CUSTOM = f"""
SELECT concat(c.table_schema, '.', c.table_name) AS source, CASE WHEN c.k % 5 = 1 THEN 'nowhere' ELSE concat('ent', l.l_partkey, '_id') END AS source_column,
  CASE WHEN c.k % 5 = 2 THEN 'gold.none' ELSE concat(p.table_schema, '.', p.table_name) END AS target, 'id' AS target_column
FROM ({OBJECTS}) c JOIN ({LINES}) l ON l.l_orderkey = c.k JOIN ({OBJECTS}) p ON p.k = l.l_partkey WHERE c.k % 10 < 5
"""
DECLARED = """SELECT DISTINCT concat(table_schema, '.', table_name) AS source, column_name AS source_column,
  concat(foreign_schema, '.', foreign_table) AS target, foreign_column AS target_column FROM fks"""


@query(
    "relationship_union",
    with_inputs(
        f"""SELECT source, source_column, target, target_column, min(c) = 1 AS custom FROM (
          SELECT *, 0 AS c FROM ({DECLARED}) UNION ALL
          SELECT *, 1 FROM custom WHERE (source, source_column) IN (SELECT t, c FROM {KNOWN}) AND (target, target_column) IN (SELECT t, c FROM {KNOWN}))
        GROUP BY source, source_column, target, target_column""",
        cols=COLUMNS,
        fks=FOREIGN,
        custom=CUSTOM,
    ),
)
def relationship_union(spark, sf):
    detected = derive(spark, sf, FOREIGN).select(
        F.concat_ws(".", "table_schema", "table_name").alias("source"), F.col("column_name").alias("source_column"),
        F.concat_ws(".", "foreign_schema", "foreign_table").alias("target"), F.col("foreign_column").alias("target_column"),
    )
    return relations.relationship_union(stored(spark, sf, COLUMNS), detected, stored(spark, sf, CUSTOM))


@query(
    "relationship_upsert",
    with_inputs(
        f"""SELECT * FROM ({DECLARED}) UNION SELECT * FROM custom""", fks=FOREIGN, custom=CUSTOM
    ),
)
def relationship_upsert(spark, sf):
    foreign = derive(spark, sf, FOREIGN)
    declared = foreign.select(
        F.concat_ws(".", "table_schema", "table_name").alias("source"), F.col("column_name").alias("source_column"),
        F.concat_ws(".", "foreign_schema", "foreign_table").alias("target"), F.col("foreign_column").alias("target_column"),
    )
    return relations.relationship_add(declared.distinct(), derive(spark, sf, CUSTOM))


GONE = CUSTOM.replace("c.k % 10 < 5", "c.k % 20 < 10")


@query(
    "relationship_remove",
    with_inputs(f"SELECT * FROM ({DECLARED}) EXCEPT SELECT * FROM gone", fks=FOREIGN, gone=GONE),
)
def relationship_remove(spark, sf):
    foreign = derive(spark, sf, FOREIGN)
    declared = foreign.select(
        F.concat_ws(".", "table_schema", "table_name").alias("source"), F.col("column_name").alias("source_column"),
        F.concat_ws(".", "foreign_schema", "foreign_table").alias("target"), F.col("foreign_column").alias("target_column"),
    )
    return relations.relationship_remove(declared, derive(spark, sf, GONE))


_WEIGHT = "CAST(sum(CAST(('0x' || substr(sha256(kind || ':' || item), {at}, 15)) AS bigint)) AS varchar)"


@query(
    "graph_signature",
    with_inputs(
        f"""SELECT count(*) FILTER (kind = 'n') AS n_nodes, count(*) FILTER (kind = 'e') AS n_edges,
        concat_ws('-', {', '.join(_WEIGHT.format(at=1 + 15 * i) for i in range(4))}) AS signature FROM (
          SELECT DISTINCT 'n' AS kind, concat(table_schema, '.', table_name) AS item FROM objects
          UNION SELECT 'e', concat_ws('|', source, source_column, target, target_column) FROM custom)""",
        objects=OBJECTS,
        custom=CUSTOM,
    ),
)
def graph_signature(spark, sf):
    nodes = derive(spark, sf, OBJECTS).select(F.concat_ws(".", "table_schema", "table_name").alias("id"))
    return relations.graph_signature(nodes, derive(spark, sf, CUSTOM))


# -- registries ----------------------------------------------------------------------------------

REGISTRY = """
SELECT concat('p', c_custkey) AS id, c_name AS name, concat('notebooks/', c_mktsegment) AS path, timestamp '2024-01-01 00:00:00' AS created_at,
  timestamp '2024-01-02 00:00:00' AS updated_at FROM {customer} WHERE c_custkey % 4 <> 0
"""
ENTRIES = """
SELECT concat('p', o_custkey) AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('new ', min(o_orderkey)) END AS name,
  max(o_orderpriority) AS path FROM {orders} WHERE o_custkey % 2 = 0 GROUP BY o_custkey
"""


# Named `pipeline_upsert` in the plan of the work.
@query(
    "registry_upsert",
    with_inputs(
        f"""SELECT coalesce(r.id, e.id) AS id, coalesce(e.name, r.name) AS name, coalesce(e.path, r.path) AS path,
        coalesce(r.created_at, {NOW}) AS created_at, CASE WHEN e.id IS NOT NULL THEN {NOW} ELSE r.updated_at END AS updated_at
        FROM reg r FULL JOIN ent e ON r.id = e.id""",
        reg=REGISTRY,
        ent=ENTRIES,
    ),
)
def registry_upsert(spark, sf):
    registry = derive(spark, sf, REGISTRY)
    for c in ("created_at", "updated_at"):
        registry = registry.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return metadata.registry_upsert(registry, derive(spark, sf, ENTRIES), "id", "created_at", now())


@query(
    "merge_keys_dedupe",
    """SELECT l_orderkey, l_partkey, arg_max(l_suppkey, l_extendedprice * 1000 + l_suppkey) AS l_suppkey FROM lineitem
    GROUP BY l_orderkey, l_partkey""",
)
def merge_keys_dedupe(spark, sf):
    df = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * 1000 + F.col("l_suppkey")).alias("place")
    )
    return metadata.merge_keys_dedupe(df, ["l_orderkey", "l_partkey"], "place").drop("place")
