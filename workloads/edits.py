"""Row edits and change feeds derived from given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import edits, treediff
from workloads.registry import derive, query, read, with_inputs

# Edits on orders, in long form. Values are texts; prices are edited in whole numbers.
EDITS = """
SELECT concat('e', o_orderkey) AS edit_id, o_orderkey, 'O_OrderStatus' AS column, o_orderstatus AS old_value, 'X' AS new_value
  FROM {orders} WHERE o_orderkey % 10 = 1
UNION ALL SELECT concat('e', o_orderkey), o_orderkey, 'o_custkey', concat('', o_custkey), concat('', o_custkey + 1)
  FROM {orders} WHERE o_orderkey % 20 = 1
UNION ALL SELECT concat('s', o_orderkey), o_orderkey, 'o_custkey', concat('', o_custkey + 7), '1' FROM {orders} WHERE o_orderkey % 10 = 2
UNION ALL SELECT concat('s', o_orderkey), o_orderkey, 'o_orderstatus', o_orderstatus, 'Y' FROM {orders} WHERE o_orderkey % 10 = 2
UNION ALL SELECT concat('g', o_orderkey), -1 - o_orderkey, 'o_orderstatus', o_orderstatus, 'Z' FROM {orders} WHERE o_orderkey % 10 = 3
UNION ALL SELECT concat('n', o_orderkey), NULL, 'o_orderstatus', o_orderstatus, 'Z' FROM {orders} WHERE o_orderkey % 10 = 4
UNION ALL SELECT concat('x', o_orderkey), o_orderkey, 'o_orderpriority', o_orderpriority, 'none' FROM {orders} WHERE o_orderkey % 10 = 5
UNION ALL SELECT concat('u', o_orderkey), o_orderkey, 'o_orderstatus', o_orderstatus, o_orderstatus FROM {orders} WHERE o_orderkey % 10 = 6
UNION ALL SELECT concat('d', o_orderkey), o_orderkey, 'o_orderstatus', o_orderstatus, 'A' FROM {orders} WHERE o_orderkey % 10 = 7
UNION ALL SELECT concat('D', o_orderkey), o_orderkey, 'o_orderstatus', o_orderstatus, 'B' FROM {orders} WHERE o_orderkey % 10 = 7
UNION ALL SELECT concat('b', o_orderkey), o_orderkey, 'o_custkey', concat('', o_custkey), 'no number' FROM {orders} WHERE o_orderkey % 10 = 8
UNION ALL SELECT concat('k', o_orderkey), o_orderkey, 'o_orderkey', concat('', o_orderkey), '5' FROM {orders} WHERE o_orderkey % 10 = 9
UNION ALL SELECT concat('p', o_orderkey), o_orderkey, 'o_custkey', concat('', o_custkey), NULL FROM {orders} WHERE o_orderkey % 30 = 10
UNION ALL SELECT concat('q', o_orderkey), o_orderkey, 'o_orderstatus', o_orderstatus, NULL FROM {orders} WHERE o_orderkey % 30 = 10
"""
KEYS = ["O_ORDERKEY"]
EDITABLE = ["o_orderstatus", "O_CustKey", "o_orderkey"]

STATUS = """SELECT concat(p, o_orderkey) AS edit_id, status FROM orders JOIN (VALUES
  (10, 1, 'e', 'applied'), (10, 2, 's', 'conflict'), (10, 3, 'g', 'conflict'), (10, 4, 'n', 'error'),
  (10, 7, 'd', 'error'), (10, 7, 'D', 'error'), (10, 8, 'b', 'error'), (30, 10, 'p', 'applied'), (30, 10, 'q', 'applied')
  ) v(m, r, p, status) ON o_orderkey % m = r"""


@query(
    "edit_normalize",
    with_inputs(
        """SELECT edit_id, o_orderkey, "column", old_value, new_value FROM edits
        WHERE lower("column") IN ('o_orderstatus', 'o_custkey') AND old_value IS DISTINCT FROM new_value""",
        edits=EDITS,
    ),
)
def edit_normalize(spark, sf):
    return edits.edit_normalize(derive(spark, sf, EDITS), EDITABLE, KEYS)


@query(
    "apply_edits",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 1 THEN o_custkey + 1 WHEN o_orderkey % 30 = 10 THEN NULL ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 10 = 1 THEN 'X' WHEN o_orderkey % 30 = 10 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority FROM orders""",
)
def apply_edits(spark, sf):
    return edits.apply_edits(read(spark, sf, "orders"), derive(spark, sf, EDITS), KEYS, EDITABLE)


@query("edit_status", STATUS)
def edit_status(spark, sf):
    return edits.edit_status(read(spark, sf, "orders"), derive(spark, sf, EDITS), KEYS, EDITABLE)


@query(
    "edit_summary",
    f"""SELECT *, conflicted = 0 AND failed = 0 AS ok FROM (SELECT count(*) FILTER (status = 'applied') AS applied,
    count(*) FILTER (status = 'conflict') AS conflicted, count(*) FILTER (status = 'error') AS failed FROM ({STATUS}))""",
)
def edit_summary(spark, sf):
    return edits.edit_summary(edit_status(spark, sf))


@query(
    "edit_diff",
    """SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS old_value, 'X' AS new_value FROM orders
      WHERE o_orderkey % 4 = 0 AND o_custkey % 3 <> 0
    UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS varchar), NULL FROM orders WHERE o_orderkey % 5 = 0""",
)
def edit_diff(spark, sf):
    base = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # A cell set back to its old value is no change.
    new = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise("X")
    edited = base.withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, new).otherwise(F.col("o_orderstatus"))
    ).withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")))
    return edits.edit_diff(base, edited, ["o_orderkey"])


@query(
    "state_diff",
    """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 1 THEN NULL ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 89 = 2 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 101 <> 3
      UNION ALL SELECT -o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey % 103 = 4),
    j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'updated' END AS change,
        CAST(o.o_custkey AS varchar) AS c1, CAST(n.o_custkey AS varchar) AS c2, o.o_orderstatus AS s1, n.o_orderstatus AS s2 FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
    SELECT o_orderkey, change, 'o_custkey' AS "column", c1 AS old_value, c2 AS new_value FROM j WHERE change <> 'updated' OR c1 IS DISTINCT FROM c2
    UNION ALL SELECT o_orderkey, change, 'o_orderstatus', s1, s2 FROM j WHERE change <> 'updated' OR s1 IS DISTINCT FROM s2""",
)
def state_diff(spark, sf):
    base = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    kept = base.where(k % 101 != 3).select(
        k, F.when(k % 97 != 1, F.col("o_custkey")).alias("o_custkey"), F.when(k % 89 == 2, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    )
    added = base.where(k % 103 == 4).select((-k).alias("o_orderkey"), "o_custkey", F.lit(None).cast("string").alias("o_orderstatus"))
    return treediff.state_diff(base, kept.unionByName(added), ["o_orderkey"])


# A change feed over 40 keys per part of the day; late events are part of it (seq is the truth).
FEED = """
SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op,
  concat('f', user_id, '/', event_id % 40) AS key, CAST(NULL AS {text_type}) AS new_key, props AS title, value AS score
FROM {{events}}
"""
INDEX = """
SELECT concat('f', c_custkey, '/', c_nationkey) AS key, c_name AS title, c_acctbal AS score FROM {customer}
"""
FIELDS = ["title", "score"]


def feed_text(text_type: str) -> str:
    return FEED.format(text_type=text_type)


@query(
    "apply_change_feed",
    with_inputs(
        """SELECT key, title, score, seq FROM (
          SELECT key, op, title, score, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC NULLS LAST) AS rn FROM (
            SELECT key, 'upsert' AS op, title, score, CAST(NULL AS bigint) AS seq FROM idx
            UNION ALL SELECT key, op, title, score, seq FROM feed)) WHERE rn = 1 AND op <> 'delete'""",
        idx=INDEX,
        feed=feed_text("varchar"),
    ),
)
def apply_change_feed(spark, sf):
    base = derive(spark, sf, INDEX).withColumn("seq", F.lit(None).cast("bigint"))
    return edits.apply_change_feed(base, derive(spark, sf, feed_text("string")), FIELDS)


# Entries are created, renamed twice in a row, and partly changed again under the old name. The
# index holds the first new names already: renames replace what is there, or move it on.
HELD = "SELECT concat('b', o_orderkey) AS key, 'held' AS title, CAST(0 AS double) AS score FROM {orders}"
RENAMES = """
SELECT o_orderkey * 10 AS seq, 'upsert' AS op, concat('a', o_orderkey) AS key, CAST(NULL AS {text_type}) AS new_key, o_orderpriority AS title, o_totalprice AS score FROM {{orders}}
UNION ALL SELECT o_orderkey * 10 + 1, 'rename', concat('a', o_orderkey), concat('b', o_orderkey), 'none', 0.0 FROM {{orders}} WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey * 10 + 2, 'rename', concat('b', o_orderkey), concat('c', o_orderkey), 'new', 1.0 FROM {{orders}} WHERE o_orderkey % 4 < 2
UNION ALL SELECT o_orderkey * 10 + 3, 'upsert', concat('a', o_orderkey), NULL, 'again', 2.0 FROM {{orders}} WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey * 10 + 4, 'delete', concat('c', o_orderkey), NULL, NULL, NULL FROM {{orders}} WHERE o_orderkey % 8 = 4
"""


@query(
    "rename_change_feed",
    """SELECT concat('a', o_orderkey) AS key, CASE WHEN o_orderkey % 6 = 0 THEN 'again' ELSE o_orderpriority END AS title,
      CASE WHEN o_orderkey % 6 = 0 THEN 2.0 ELSE o_totalprice END AS score, o_orderkey * 10 + CASE WHEN o_orderkey % 6 = 0 THEN 3 ELSE 0 END AS seq
      FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 6 = 0
    UNION ALL SELECT concat('b', o_orderkey), 'held', 0.0, NULL FROM orders WHERE o_orderkey % 4 = 3
    UNION ALL SELECT concat('b', o_orderkey), o_orderpriority, o_totalprice, o_orderkey * 10 + 1 FROM orders WHERE o_orderkey % 4 = 2
    UNION ALL SELECT concat('c', o_orderkey), CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'held' END,
      CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE 0.0 END, o_orderkey * 10 + 2 FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey % 8 <> 4""",
)
def rename_change_feed(spark, sf):
    base = derive(spark, sf, HELD).withColumn("seq", F.lit(None).cast("bigint"))
    return edits.apply_change_feed(base, derive(spark, sf, RENAMES.format(text_type="string")), FIELDS)
