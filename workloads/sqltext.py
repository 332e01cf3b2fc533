"""SQL constructs that are run as they come, through `analyze`."""

from __future__ import annotations

from strata.plans.analyze import analyze
from workloads.registry import mounted, query

GIVEN = "region nation customer supplier part orders lineitem events documents labels conversations".split()


def construct(key: str, text: str, oracle: str | None = None) -> None:
    """Register one text. ``@table`` is a mounted table for Spark and a plain one for the check."""

    def run(spark, sf):
        used = [t for t in GIVEN if f"@{t}" in text]
        wb = mounted(spark, sf, *used)
        return analyze(wb.spark, text.replace("@", "imports."))

    query(key, (oracle or text).replace("@", ""))(run)


construct(
    "analyze_cell",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n
    FROM @lineitem WHERE l_shipdate <= timestamp '2000-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus;""",
)
construct(
    "sql_inner_join",
    """SELECT o_orderpriority, count(*) AS n,
    CAST(sum(CAST(l_extendedprice AS decimal(12, 2)) * (1 - CAST(l_discount AS decimal(4, 2)))) AS double) AS revenue
    FROM @lineitem INNER JOIN @orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""",
)
construct(
    "sql_left_join",
    """SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
    FROM @customer LEFT JOIN @orders ON c_custkey = o_custkey AND o_orderstatus = 'P'
    GROUP BY c_custkey""",
)
construct(
    "sql_right_join",
    """SELECT p_partkey, p_brand, coalesce(n, 0) AS n_lines
    FROM (SELECT l_partkey, count(*) AS n FROM @lineitem WHERE l_quantity > 45 GROUP BY l_partkey) l
    RIGHT OUTER JOIN @part ON l_partkey = p_partkey""",
)
construct(
    "sql_full_join",
    """SELECT coalesce(a.k, b.k) AS nationkey, a.n AS n_customers, b.n AS n_suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM @customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) a
    FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM @supplier WHERE s_acctbal < 2000 GROUP BY s_nationkey) b
    ON a.k = b.k""",
)
construct("sql_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM @orders")
construct(
    "sql_union",
    """SELECT c_nationkey AS nationkey FROM @customer WHERE c_acctbal > 5000
    UNION SELECT s_nationkey FROM @supplier""",
)
construct(
    "sql_union_all",
    """SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey FROM @customer
    UNION ALL SELECT s_nationkey FROM @supplier) u GROUP BY nationkey""",
)
construct(
    "sql_group_having",
    """SELECT l_suppkey, count(*) AS n, round(sum(l_quantity) / count(*), 9) AS avg_quantity FROM @lineitem
    GROUP BY l_suppkey HAVING count(*) > 590""",
)
construct(
    "sql_aggregates",
    """SELECT l_shipdate, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_linenumber), 9) AS mean,
    min(l_discount) AS lowest, max(l_tax) AS highest FROM @lineitem GROUP BY l_shipdate""",
)
construct(
    "sql_order_limit_offset",
    """SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
construct(
    "sql_case_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
    ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM @orders""",
)
construct(
    "sql_cast",
    """SELECT event_id, CAST(floor(value) AS bigint) AS whole, CAST(event_id AS double) AS as_double,
    CAST(CAST(value AS decimal(12, 2)) AS double) AS money, CAST(ts AS date) = CAST('2024-01-15' AS date) AS is_ides
    FROM @events""",
)
construct(
    "sql_logic_null",
    """SELECT event_id, user_id IS NULL AS no_user, NOT (value > 50) AS low, (event_type = 'click') = TRUE AS is_click
    FROM @events WHERE (value > 90 OR event_type = 'error') AND user_id IS NOT NULL""",
)
construct(
    "sql_in_between",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM @lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 12""",
)
construct(
    "sql_like_ilike",
    """SELECT p_partkey, p_name, p_name LIKE '%ring' AS is_ring, p_name ILIKE 'RED%' AS is_red FROM @part""",
)
# Spark has no SIMILAR TO: the same test as an anchored pattern.
construct(
    "sql_similar_to",
    """SELECT p_partkey, p_name, p_name RLIKE '^(?:(red|blue|small) .*)$' AS fits FROM @part""",
    """SELECT p_partkey, p_name, p_name SIMILAR TO '(red|blue|small) .*' AS fits FROM part""",
)
construct(
    "sql_string_funcs",
    """SELECT c_custkey, TRIM(concat('  ', c_name, ' ')) AS name, UPPER(c_mktsegment) AS up, LOWER(c_mktsegment) AS low,
    SUBSTRING(c_name, 10, 5) AS part, CONCAT(c_mktsegment, '/', c_nationkey) AS joined FROM @customer""",
)
construct(
    "sql_null_funcs",
    """SELECT event_id, COALESCE(NULLIF(event_type, 'view'), 'none') AS kind, NULLIF(user_id, 8) AS user_id FROM @events""",
)
construct(
    "sql_initcap",
    "SELECT p_partkey, INITCAP(p_name) AS title FROM @part",
    """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '),
    lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ') AS title FROM part""",
)
construct(
    "sql_regexp_replace",
    "SELECT doc_id, REGEXP_REPLACE(text, '[aeiou]+', '*') AS masked FROM @documents",
    "SELECT doc_id, REGEXP_REPLACE(text, '[aeiou]+', '*', 'g') AS masked FROM documents",
)
construct(
    "sql_cte",
    """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM @orders GROUP BY o_custkey),
    big AS (SELECT * FROM spend WHERE total > 1000000)
    SELECT c_nationkey, count(*) AS n, round(sum(total), 2) AS total FROM big JOIN @customer ON c_custkey = o_custkey
    GROUP BY c_nationkey""",
)
construct(
    "sql_values",
    """SELECT o_orderkey, label FROM @orders JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'partial')) AS v(code, label)
    ON o_orderstatus = code""",
)
construct("sql_table_stmt", "TABLE @part")
construct(
    "sql_window",
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS nth,
    round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS step
    FROM @orders""",
)
construct(
    "sql_time_boundary",
    """SELECT event_type, date_trunc('day', ts) AS day_start, count(*) AS n,
    sum(CASE WHEN ts >= date_trunc('month', ts) + INTERVAL '14' DAY THEN 1 ELSE 0 END) AS second_half
    FROM @events GROUP BY event_type, date_trunc('day', ts)""",
    """SELECT event_type, CAST(date_trunc('day', ts) AS timestamp) AS day_start, count(*) AS n,
    CAST(sum(CASE WHEN ts >= date_trunc('month', ts) + INTERVAL '14' DAY THEN 1 ELSE 0 END) AS bigint) AS second_half
    FROM events GROUP BY event_type, CAST(date_trunc('day', ts) AS timestamp)""",
)
