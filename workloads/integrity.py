"""Rule checks, key effects, profiles and schema changes over given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from strata.operators import evolve, inclusion, integrity, profile, profilestore
from strata.session import scratch_path
from workloads.registry import derive, query, read, stored, with_inputs

# Orders with null customers, doubled keys and orphans.
BROKEN = """
SELECT CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_orderkey % 40 = 3 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 60 = 5 THEN -o_orderkey ELSE o_custkey END AS o_custkey,
  o_orderstatus, o_totalprice FROM {orders}
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, NULL FROM {orders} WHERE o_orderkey % 25 = 0
"""


@query(
    "check_not_null",
    with_inputs("SELECT * FROM broken WHERE o_custkey IS NULL OR o_totalprice IS NULL", broken=BROKEN),
)
def check_not_null(spark, sf):
    return integrity.check_not_null(derive(spark, sf, BROKEN), ["O_CUSTKEY", "o_totalprice"])


@query(
    "check_primary_key",
    with_inputs(
        """SELECT o_orderkey, count(*) AS n_rows, CASE WHEN o_orderkey IS NULL THEN 'null' ELSE 'duplicate' END AS reason
        FROM broken GROUP BY o_orderkey HAVING count(*) > 1 OR o_orderkey IS NULL""",
        broken=BROKEN,
    ),
)
def check_primary_key(spark, sf):
    return integrity.check_primary_key(derive(spark, sf, BROKEN), ["o_orderkey"])


@query(
    "check_unique",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def check_unique(spark, sf):
    return integrity.check_unique(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_expression",
    with_inputs("SELECT * FROM broken WHERE NOT (o_totalprice < 450000 AND length(o_orderstatus) = 1)", broken=BROKEN),
)
def check_expression(spark, sf):
    return integrity.check_expression(derive(spark, sf, BROKEN), "o_totalprice < 450000 AND length(o_orderstatus) = 1")


@query(
    "check_foreign_key",
    with_inputs(
        "SELECT * FROM broken WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)", broken=BROKEN
    ),
)
def check_foreign_key(spark, sf):
    return integrity.check_foreign_key(derive(spark, sf, BROKEN), read(spark, sf, "customer"), ["o_custkey"], ["c_custkey"])


DELETED = "SELECT c_custkey FROM {customer} WHERE c_custkey % 10 = 1"


def _on_delete(key: str, action: str, oracle: str, default=None):
    @query(key, with_inputs(oracle, broken=BROKEN, deleted=DELETED))
    def run(spark, sf):
        child, gone = derive(spark, sf, BROKEN), derive(spark, sf, DELETED)
        return integrity.fk_on_delete(child, gone, ["o_custkey"], ["c_custkey"], action, default)


_HIT = "o_custkey IN (SELECT c_custkey FROM deleted)"
_on_delete("fk_on_delete", "CASCADE", f"SELECT * FROM broken WHERE coalesce({_HIT}, false) = false")
_on_delete("fk_on_delete_restrict", "restrict", f"SELECT * FROM broken WHERE {_HIT}")
_on_delete(
    "fk_on_delete_set_null",
    "SET NULL",
    f"SELECT o_orderkey, CASE WHEN {_HIT} THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM broken",
)
_on_delete(
    "fk_on_delete_set_default",
    "SET DEFAULT",
    f"SELECT o_orderkey, CASE WHEN {_HIT} THEN 0 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM broken",
    {"o_custkey": 0},
)

MOVES = "SELECT c_custkey AS old_key, c_custkey + 100000 AS new_key FROM {customer} WHERE c_custkey % 7 = 1"


@query(
    "fk_on_update",
    with_inputs(
        """SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT old_key FROM moves) THEN o_custkey + 100000 ELSE o_custkey END AS o_custkey,
        o_orderstatus, o_totalprice FROM broken""",
        broken=BROKEN,
        moves=MOVES,
    ),
)
def fk_on_update(spark, sf):
    return integrity.fk_on_update(derive(spark, sf, BROKEN), derive(spark, sf, MOVES), "o_custkey")


_MOVED = "o_custkey IN (SELECT old_key FROM moves)"


def _on_update(name, action, sql, default=None):
    @query(name, with_inputs(sql, broken=BROKEN, moves=MOVES))
    def run(spark, sf):
        return integrity.fk_on_update(derive(spark, sf, BROKEN), derive(spark, sf, MOVES), "o_custkey", action=action, default=default)


_on_update(
    "fk_on_update_set_null",
    "SET NULL",
    f"SELECT o_orderkey, CASE WHEN {_MOVED} THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM broken",
)
_on_update(
    "fk_on_update_set_default",
    "SET DEFAULT",
    f"SELECT o_orderkey, CASE WHEN {_MOVED} THEN 0 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM broken",
    {"o_custkey": 0},
)
_on_update("fk_on_update_restrict", "RESTRICT", f"SELECT * FROM broken WHERE {_MOVED}")


@query(
    "fk_on_update_two_columns",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 1 THEN l_partkey + 5000000 ELSE l_partkey END AS l_partkey,
    CASE WHEN l_partkey % 3 = 1 THEN l_suppkey + 1 ELSE l_suppkey END AS l_suppkey FROM lineitem""",
)
def fk_on_update_two_columns(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines.select("l_partkey", "l_suppkey").distinct()
    moves = pairs.select(
        F.col("l_partkey").alias("p0"), F.col("l_suppkey").alias("s0"),
        F.when(F.col("l_partkey") % 3 == 1, F.col("l_partkey") + 5000000).otherwise(F.col("l_partkey")).alias("p1"),
        F.when(F.col("l_partkey") % 3 == 1, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")).alias("s1"),
    )
    return integrity.fk_on_update(lines, moves, ["l_partkey", "l_suppkey"], ["p0", "s0"], ["p1", "s1"])


@query(
    "column_defaults",
    with_inputs(
        """SELECT o_orderkey, coalesce(o_custkey, 0) AS o_custkey, o_orderstatus, coalesce(o_totalprice, 10.5) AS o_totalprice,
        'web' AS channel FROM broken""",
        broken=BROKEN,
    ),
)
def column_defaults(spark, sf):
    return integrity.column_defaults(
        derive(spark, sf, BROKEN), {"O_CustKey": "0", "o_totalprice": "21 / 2.0D", "channel": "'web'"}
    )


# -- profiles ------------------------------------------------------------------------------------


def _profile_row(c: str, text: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct,
    min({text}) AS min_text, max({text}) AS max_text, coalesce(bool_or(regexp_matches({text}, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$')), false) AS pii,
    count(*) = count({c}) AND count(*) = count(DISTINCT {c}) AS candidate_key FROM people"""


PEOPLE = """
SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('user', c_custkey, '@mail', c_nationkey, '.org') END AS contact,
  c_acctbal > 0 AS in_credit FROM {customer}
"""


PROFILE = "\nUNION ALL ".join(
    _profile_row(c, t)
    for c, t in (
        ("c_custkey", "CAST(c_custkey AS varchar)"),
        ("c_mktsegment", "c_mktsegment"),
        ("contact", "contact"),
        ("in_credit", "CAST(in_credit AS varchar)"),
    )
)


@query("column_profile", with_inputs(PROFILE, people=PEOPLE))
def column_profile(spark, sf):
    return profile.column_profile(derive(spark, sf, PEOPLE))


@query(
    "column_profile_approx",
    with_inputs(f"SELECT column_name, n_rows, n_present, min_text, max_text, pii, true AS near FROM ({PROFILE})", people=PEOPLE),
)
def column_profile_approx(spark, sf):
    """The approximate distinct counts are within a tenth of the exact ones."""
    people = stored(spark, sf, PEOPLE)
    exact = profile.column_profile(people).select("column_name", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) * 10 <= F.col("exact")
    rough = profile.column_profile(people, exact=False).join(exact, "column_name")
    return rough.select("column_name", "n_rows", "n_present", "min_text", "max_text", "pii", near.alias("near"))


# Nine of ten lines belong to one part; a few lines have no part.
SKEWED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 > 0 THEN 1 WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_partkey END AS l_partkey FROM {lineitem}"


@query(
    "skewed_foreign_key",
    with_inputs("SELECT * FROM lines WHERE l_partkey NOT IN (SELECT p_partkey FROM part)", lines=SKEWED),
)
def skewed_foreign_key(spark, sf):
    """Splits the hot part into tasks of a hundredth of a million lines."""
    return integrity.check_foreign_key(stored(spark, sf, SKEWED), read(spark, sf, "part"), ["l_partkey"], ["p_partkey"], min_rows=10_000)


@query(
    "table_grain",
    """WITH c AS (SELECT 0 AS candidate_no, 'l_orderkey' AS key_columns, 1 AS n_columns, count(*) AS n_rows,
      count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 1, 'l_orderkey,l_linenumber', 2, count(*), count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
    UNION ALL SELECT 2, 'l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice', 5, count(*),
      count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FROM lineitem),
    u AS (SELECT *, n_rows = n_distinct AS is_unique FROM c)
    SELECT *, is_unique AND candidate_no = (SELECT candidate_no FROM u WHERE is_unique ORDER BY n_columns, candidate_no LIMIT 1) AS grain FROM u""",
)
def table_grain(spark, sf):
    sets = [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]]
    return profile.table_grain(read(spark, sf, "lineitem"), sets)


@query(
    "relationship_profile",
    with_inputs(
        """SELECT CASE WHEN max_child > 1 AND max_parent > 1 THEN 'many-to-many' WHEN max_child > 1 THEN 'many-to-one'
          WHEN max_parent > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS relationship,
          round(n_matched / n_child, 6) AS confidence, n_child, n_matched FROM (
          SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM broken WHERE o_custkey IS NOT NULL GROUP BY o_custkey)) AS max_child,
          1 AS max_parent, (SELECT count(o_custkey) FROM broken) AS n_child,
          (SELECT count(*) FROM broken WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS n_matched)""",
        broken=BROKEN,
    ),
)
def relationship_profile(spark, sf):
    return profile.relationship_profile(derive(spark, sf, BROKEN), read(spark, sf, "customer"), "o_custkey", "c_custkey")


_PROFILED = "l_orderkey l_partkey l_suppkey l_extendedprice l_discount l_returnflag".split()


@query(
    "column_profile_stored",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present, true AS distinct_close, {'NULL' if c == 'l_returnflag' else 'true'} AS median_close, 2 AS scans FROM lineitem"
        for c in _PROFILED
    ),
)
def column_profile_stored(spark, sf):
    """The profile after a second part has come: only its files are scanned; estimates are held against exact counts."""
    folder, store = (scratch_path(spark, n) for n in ("profiled", "profiles"))
    df = read(spark, sf, "lineitem").select(*_PROFILED)
    scanned = []
    for part in (df.where("l_orderkey % 3 > 0"), df.where("l_orderkey % 3 = 0")):
        part.write.mode("append").parquet(folder)
        scanned.append(profilestore.refresh(spark, folder, store))
    scans = 2 if scanned[0] and scanned[1] and not set(scanned[0]) & set(scanned[1]) else 0
    found = profilestore.profile(spark, folder, store)
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in _PROFILED]).unpivot([], _PROFILED, "column_name", "n_exact")
    numbers = [c for c in _PROFILED if c != "l_returnflag"]
    medians = found.where(F.col("quantiles").isNotNull()).groupBy().pivot("column_name", numbers).agg(F.first(F.col("quantiles")[2]))
    held = df.join(F.broadcast(medians.select(*[F.col(c).alias(f"m_{c}") for c in numbers])))  # one row
    below = held.agg(*[(F.count_if(F.col(c) < F.col(f"m_{c}")) / F.count(c) <= 0.5 + profilestore.RANK_ERROR).alias(c) for c in numbers])
    upto = held.agg(*[(F.count_if(F.col(c) <= F.col(f"m_{c}")) / F.count(c) >= 0.5 - profilestore.RANK_ERROR).alias(c) for c in numbers])
    sides = below.unpivot([], numbers, "column_name", "low").join(upto.unpivot([], numbers, "column_name", "high"), "column_name")
    error = F.abs(F.col("n_distinct") - F.col("n_exact")) <= profilestore.DISTINCT_ERROR * F.col("n_exact") + 1
    return found.join(exact, "column_name").join(sides, "column_name", "left").select(
        "column_name", "n_rows", "n_present", error.alias("distinct_close"), (F.col("low") & F.col("high")).alias("median_close"), F.lit(scans).alias("scans")
    )


# Every column of the star schema against every other, by a join of their counted values.
STAR = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus",
}
_TEXTS = {"name", "mktsegment", "brand", "type", "orderstatus", "orderpriority", "returnflag", "linestatus"}
_COUNTS = "\n UNION ALL ".join(
    f"SELECT '{t}.{c}' AS col, {'NULL' if c[2:] in _TEXTS else f'CAST({c} AS double)'} AS num, {c if c[2:] in _TEXTS else 'NULL'} AS txt, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    for t, columns in STAR.items()
    for c in columns.split()
)


@query(
    "inclusion_dependencies",
    f"""WITH v AS ({_COUNTS}), t AS (SELECT col, count(*) AS n_distinct, sum(n)::BIGINT AS n_rows, max(n) AS most FROM v GROUP BY col),
    s AS (SELECT a.col AS child, b.col AS parent, count(*) AS n_shared, sum(a.n)::BIGINT AS n_matched FROM v a JOIN v b
      ON a.num = b.num AND a.col <> b.col GROUP BY ALL
      UNION ALL SELECT a.col, b.col, count(*), sum(a.n)::BIGINT FROM v a JOIN v b ON a.txt = b.txt AND a.col <> b.col GROUP BY ALL)
    SELECT child, parent, CASE WHEN c.most > 1 AND p.most > 1 THEN 'many-to-many' WHEN c.most > 1 THEN 'many-to-one' WHEN p.most > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS relationship,
      round(n_shared / c.n_distinct, 6) AS share, c.n_distinct, n_shared, c.n_rows AS n_child, n_matched
    FROM s JOIN t c ON c.col = child JOIN t p ON p.col = parent WHERE n_shared >= 0.9 * c.n_distinct""",
)
def inclusion_dependencies(spark, sf):
    """Columns nine tenths of whose values another column has, over the whole star schema."""
    tables = {t: read(spark, sf, t) for t in STAR}
    return inclusion.inclusions(tables, {t: c.split() for t, c in STAR.items()}, 0.9)


_KEYED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
_SETS = [s for n in (1, 2, 3) for s in combinations(_KEYED, n)]


@query(
    "minimal_keys",
    "WITH k AS ("
    + " UNION ALL ".join(f"SELECT {list(s)} AS cols FROM (SELECT count(*) AS n FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem)) WHERE n = (SELECT count(*) FROM lineitem)" for s in _SETS)
    + """) SELECT array_to_string(cols, ',') AS key_columns, len(cols)::INT AS n_columns FROM k
    WHERE NOT EXISTS (SELECT 1 FROM k b WHERE len(b.cols) < len(k.cols) AND list_has_all(k.cols, b.cols))""",
)
def minimal_keys(spark, sf):
    """All key sets of up to three of five columns of the lines."""
    return profile.minimal_keys(read(spark, sf, "lineitem"), 3, _KEYED)


# -- schema changes ------------------------------------------------------------------------------

# Each order is a table whose columns are its lines; the new state drops, adds and changes some.
OLD_COLUMNS = """
SELECT 'silver' AS table_schema, concat('t', l_orderkey) AS table_name, concat('c', l_linenumber) AS column_name,
  CASE WHEN max(l_partkey) % 2 = 0 THEN 'bigint' ELSE 'varchar' END AS data_type, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable,
  CASE WHEN count(*) > 1 THEN 'several' END AS comment
FROM {lineitem} WHERE l_orderkey % 50 <> 1 GROUP BY l_orderkey, l_linenumber
"""
NEW_COLUMNS = """
SELECT 'silver' AS table_schema, concat('t', l_orderkey) AS table_name, concat('c', l_linenumber) AS column_name,
  CASE WHEN max(l_partkey) % 2 = 0 AND l_orderkey % 5 <> 0 THEN 'bigint' ELSE 'varchar' END AS data_type,
  CASE WHEN min(l_suppkey) % 2 = 0 OR l_orderkey % 9 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable,
  CASE WHEN count(*) > 1 AND l_orderkey % 13 <> 0 THEN 'several' END AS comment
FROM {lineitem} WHERE l_orderkey % 50 <> 2 AND (l_orderkey + l_linenumber) % 11 <> 0 GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT 'silver', concat('t', o_orderkey), 'added', 'double', 'YES', NULL FROM {orders} WHERE o_orderkey % 17 = 3
"""


@query(
    "schema_diff",
    with_inputs(
        """SELECT table_schema, table_name, column_name, change, detail, old_data_type, old_is_nullable, old_comment,
          new_data_type, new_is_nullable, new_comment FROM (
          SELECT coalesce(o.table_schema, n.table_schema) AS table_schema, coalesce(o.table_name, n.table_name) AS table_name,
          coalesce(o.column_name, n.column_name) AS column_name,
          CASE WHEN o.table_name IS NULL THEN 'added' WHEN n.table_name IS NULL THEN 'removed' WHEN o.data_type IS DISTINCT FROM n.data_type
            OR o.is_nullable IS DISTINCT FROM n.is_nullable OR o.comment IS DISTINCT FROM n.comment THEN 'changed' END AS change,
          CASE WHEN o.table_name IS NOT NULL AND n.table_name IS NOT NULL THEN concat_ws(',', CASE WHEN o.data_type IS DISTINCT FROM n.data_type THEN 'data_type' END,
            CASE WHEN o.is_nullable IS DISTINCT FROM n.is_nullable THEN 'is_nullable' END, CASE WHEN o.comment IS DISTINCT FROM n.comment THEN 'comment' END) END AS detail,
          o.data_type AS old_data_type, o.is_nullable AS old_is_nullable, o.comment AS old_comment,
          n.data_type AS new_data_type, n.is_nullable AS new_is_nullable, n.comment AS new_comment
          FROM oldc o FULL JOIN newc n ON o.table_schema = n.table_schema AND o.table_name = n.table_name AND o.column_name = n.column_name)
        WHERE change IS NOT NULL
        UNION ALL SELECT 'silver', t, NULL, CASE WHEN t IN (SELECT table_name FROM newc) THEN 'table added' ELSE 'table removed' END,
          NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT DISTINCT table_name AS t FROM oldc UNION SELECT table_name FROM newc)
        WHERE (t IN (SELECT table_name FROM oldc)) <> (t IN (SELECT table_name FROM newc))""",
        oldc=OLD_COLUMNS,
        newc=NEW_COLUMNS,
    ),
)
def schema_diff(spark, sf):
    return evolve.schema_diff(derive(spark, sf, OLD_COLUMNS), derive(spark, sf, NEW_COLUMNS))


@query(
    "normalized_order",
    with_inputs("SELECT * FROM oldc", oldc=OLD_COLUMNS),
)
def normalized_order(spark, sf):
    return evolve.normalized_order(derive(spark, sf, OLD_COLUMNS))


# Table drafts: columns from the lines of an order, keys and checks from the order itself.
OLD_DRAFT = """
SELECT concat('t', l_orderkey) AS table_name, 'column' AS kind, concat('c', l_linenumber) AS name,
  CASE WHEN max(l_partkey) % 2 = 0 THEN 'BIGINT' ELSE 'VARCHAR' END AS definition, max(l_suppkey) % 2 = 0 AS nullable,
  CASE WHEN max(l_suppkey) % 3 = 0 THEN '0' END AS default_value FROM {lineitem} GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT concat('t', o_orderkey), 'primary_key', NULL, 'c1, c2', NULL, NULL FROM {orders}
UNION ALL SELECT concat('t', o_orderkey), 'check', 'positive', 'c1 > 0', NULL, NULL FROM {orders} WHERE o_orderkey % 2 = 0
UNION ALL SELECT concat('t', o_orderkey), 'unique', CASE WHEN o_orderkey % 4 = 0 THEN 'u' END, 'C3,c1', NULL, NULL FROM {orders} WHERE o_orderkey % 2 = 0
"""
NEW_DRAFT = """
SELECT concat('t', l_orderkey) AS table_name, 'column' AS kind, concat(CASE WHEN l_orderkey % 2 = 0 THEN 'C' ELSE 'c' END, l_linenumber) AS name,
  CASE WHEN max(l_partkey) % 2 = 0 OR l_orderkey % 6 = 0 THEN 'BIGINT' ELSE 'VARCHAR' END AS definition, max(l_suppkey) % 2 = 0 OR l_orderkey % 7 = 0 AS nullable,
  CASE WHEN max(l_suppkey) % 3 = 0 AND l_orderkey % 5 <> 0 THEN '0' END AS default_value FROM {lineitem}
  WHERE l_orderkey % 8 <> 0 OR l_linenumber <> 4 GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT concat('t', o_orderkey), 'column', 'extra', 'DATE', true, NULL FROM {orders} WHERE o_orderkey % 9 = 0
UNION ALL SELECT concat('t', o_orderkey), 'primary_key', NULL, CASE WHEN o_orderkey % 3 = 0 THEN 'c1' ELSE 'C2,c1' END, NULL, NULL FROM {orders}
UNION ALL SELECT concat('t', o_orderkey), 'check', CASE WHEN o_orderkey % 4 = 0 THEN 'positive' ELSE 'other' END, 'c1 > 1', NULL, NULL FROM {orders} WHERE o_orderkey % 2 = 0
UNION ALL SELECT concat('t', o_orderkey), 'foreign_key', 'fk', 'c2', NULL, NULL FROM {orders} WHERE o_orderkey % 10 = 0
UNION ALL SELECT concat('t', o_orderkey), 'unique', 'u', 'c1,c3', NULL, NULL FROM {orders} WHERE o_orderkey % 12 = 0
"""


@query(
    "alter_plan",
    with_inputs(
        """, c AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, o.name AS oname, n.name AS nname, o.definition AS od, n.definition AS nd,
          o.nullable AS onul, n.nullable AS nnul, coalesce(o.default_value, '') AS odef, coalesce(n.default_value, '') AS ndef
          FROM (SELECT * FROM oldd WHERE kind = 'column') o FULL JOIN (SELECT * FROM newd WHERE kind = 'column') n
          ON o.table_name = n.table_name AND lower(o.name) = lower(n.name)),
        k AS (SELECT o_orderkey AS k, concat('t', o_orderkey) AS table_name FROM orders)
        SELECT table_name, 1 AS step, 'drop column' AS action, oname AS name, od AS old_value, NULL AS new_value FROM c WHERE nname IS NULL
        UNION ALL SELECT table_name, 2, 'add column', nname, NULL, nd FROM c WHERE oname IS NULL
        UNION ALL SELECT table_name, 3, 'alter type', nname, od, nd FROM c WHERE od <> nd
        UNION ALL SELECT table_name, 4, 'set nullability', nname, CAST(onul AS varchar), CAST(nnul AS varchar) FROM c WHERE onul <> nnul
        UNION ALL SELECT table_name, 5, 'set default', nname, odef, ndef FROM c WHERE oname IS NOT NULL AND nname IS NOT NULL AND odef <> ndef
        UNION ALL SELECT table_name, 6, 'drop primary_key', NULL, 'c1, c2', NULL FROM k WHERE k % 3 = 0
        UNION ALL SELECT table_name, 7, 'add primary_key', NULL, NULL, 'c1' FROM k WHERE k % 3 = 0
        UNION ALL SELECT table_name, 8, 'drop unique', 'u', 'C3,c1', NULL FROM k WHERE k % 4 = 0 AND k % 12 <> 0
        UNION ALL SELECT table_name, 11, 'add foreign_key', 'fk', NULL, 'c2' FROM k WHERE k % 10 = 0
        UNION ALL SELECT table_name, 12, 'drop check', 'positive', 'c1 > 0', NULL FROM k WHERE k % 4 = 2
        UNION ALL SELECT table_name, 13, 'add check', 'other', NULL, 'c1 > 1' FROM k WHERE k % 4 = 2""",
        oldd=OLD_DRAFT,
        newd=NEW_DRAFT,
    ).replace(")\n, c AS", "),\nc AS"),
)
def alter_plan(spark, sf):
    return evolve.alter_plan(derive(spark, sf, OLD_DRAFT), derive(spark, sf, NEW_DRAFT))


def _evolved(spark, sf):
    d = read(spark, sf, "documents").withColumn(
        "mark", F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string"))
    )
    return evolve.evolve_table(
        d, drop=["LANG"], add={"reviewed": ("boolean", "false"), "note": ("string", None)}, cast={"mark": "int", "N_CHARS": "double"}
    )


@query(
    "evolve_table",
    """SELECT doc_id, text, source, CAST(n_chars AS double) AS n_chars, CASE WHEN doc_id % 4 <> 0 THEN CAST(n_chars AS integer) END AS mark,
    false AS reviewed, CAST(NULL AS varchar) AS note FROM documents""",
)
def evolve_table(spark, sf):
    return _evolved(spark, sf).rows


# A plan as rows: what `alter_plan` gives for one table, here over the documents.
PLAN = [
    (0, "drop column", "lang", "string", None), (1, "add column", "reviewed", None, "boolean"), (2, "alter type", "N_CHARS", "bigint", "double"),
    (3, "set nullability", "text", "true", "false"), (6, "add primary_key", None, None, "doc_id"), (8, "add unique", "by_text", None, "text"),
    (12, "add check", "long", None, "n_chars > 500.0"),
]


@query(
    "evolve_by_plan",
    """SELECT 8 AS step, 'add unique' AS action, 'by_text' AS name, count(*) AS n_failed FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 12, 'add check', 'long', count(*) FILTER (n_chars <= 500) FROM documents HAVING count(*) FILTER (n_chars <= 500) > 0
    UNION ALL SELECT 3, 'set nullability', 'text', count(*) FILTER (text IS NULL) FROM documents HAVING count(*) FILTER (text IS NULL) > 0""",
)
def evolve_by_plan(spark, sf):
    """What stands against a plan over the documents."""
    plan = spark.createDataFrame(PLAN, "step int, action string, name string, old_value string, new_value string")
    return evolve.plan_rows(read(spark, sf, "documents"), plan, {"reviewed": "false"}).failures


@query(
    "evolve_failures",
    """SELECT 'mark' AS column_name, count(*) FILTER (doc_id % 4 = 0) AS n_failed FROM documents
    UNION ALL SELECT 'n_chars', CAST(0 AS bigint) FROM (SELECT count(*) FROM documents)""",
)
def evolve_failures(spark, sf):
    return _evolved(spark, sf).failures
