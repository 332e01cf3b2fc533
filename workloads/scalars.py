"""Rules over columns of texts and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import text as tx
from strata.functions import values as v
from workloads.registry import query, read, texts, with_inputs

# SQL texts of many shapes, one per order.
SQL_TEXTS = """
SELECT o_orderkey AS qid,
  concat('queries/', lower(substr(o_orderpriority, 3)), '/q', o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN '.postgres' ELSE '.sql' END) AS path,
  CASE o_orderkey % 10
    WHEN 0 THEN concat('-- Orders of ', o_custkey % 40, chr(10), 'SELECT  *  FROM bronze.ent', o_custkey % 40, ' ;;; ')
    WHEN 1 THEN concat('/* block ', o_custkey, chr(10), ' more */ select id, NAME from imports.src', o_custkey % 40, chr(9), 'LIMIT 10 OFFSET 5;')
    WHEN 2 THEN concat('WITH t AS (SELECT 1 AS x)', chr(13), chr(10), 'SELECT x FROM t -- tail ', o_custkey, chr(10), 'LIMIT ', o_custkey)
    WHEN 3 THEN concat('  ', chr(10), '--', chr(10), 'UPDATE silver.ent', o_custkey % 40, ' SET a = ''x--y'' WHERE id = ', o_custkey % 40)
    WHEN 4 THEN concat('create table gold.ent', o_custkey % 40, ' AS SELECT a.b FROM db.silver . ent', o_custkey % 40, ' a JOIN "q" ON 1=1')
    WHEN 5 THEN concat('drop', chr(10), 'view bronze.ent', o_custkey % 40, '; -- ', o_orderstatus)
    WHEN 6 THEN concat(chr(10), chr(10), '--   Totals by ', o_orderstatus, '  ', chr(10), 'select sum(x) FROM gold.ent', o_custkey % 40, ' Where Y="A B" ;')
    WHEN 7 THEN concat('EXPLAIN SELECT * FROM (SELECT * FROM data_cache.d', o_custkey % 40, ') s LIMIT 7 ; ')
    WHEN 8 THEN concat('VALUES (', o_custkey % 40, ')')
    ELSE concat('selection of ', o_orderstatus, ' altered') END AS sql
FROM {orders}
"""

SPACE = r"[ \t\n\f\r\x{0b}]"


def on_texts(key: str, column, oracle: str) -> None:
    """A rule over the derived SQL texts: qid and value."""

    @query(key, with_inputs(f"SELECT qid, {oracle} AS value FROM texts", texts=SQL_TEXTS))
    def run(spark, sf):
        return texts(spark, sf, SQL_TEXTS).select("qid", column(F.col("sql")).alias("value"))


CANONICAL = rf"""lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(sql, '/\*.*?\*/', ' ', 'gs'),
  '--[^\n\r]*', ' ', 'g'), '{SPACE}+', ' ', 'g')), ';+ *$', ''))"""

on_texts("canonical_sql", tx.canonical_sql, CANONICAL)
on_texts("sql_hash", tx.sql_hash, f"sha256({CANONICAL})")
on_texts(
    "query_title",
    tx.query_title,
    rf"nullif(trim(regexp_extract(sql, '^{SPACE}*--([^\n]*)', 1), chr(9) || chr(13) || ' '), '')",
)
on_texts(
    "is_result_statement",
    tx.is_result_statement,
    rf"regexp_matches(sql, '(?i)^{SPACE}*(SELECT|WITH|VALUES|TABLE|SHOW|DESCRIBE|EXPLAIN)\b')",
)
on_texts(
    "is_ddl_statement", tx.is_ddl_statement, rf"regexp_matches(sql, '(?i)\b(CREATE|DROP|ALTER|TRUNCATE){SPACE}+')"
)
on_texts(
    "existing_limit",
    tx.existing_limit,
    rf"""try_cast(regexp_extract(sql, '(?i)LIMIT{SPACE}+(\d+)({SPACE}+OFFSET{SPACE}+\d+)?{SPACE}*;?{SPACE}*$', 1) AS bigint)""",
)
on_texts(
    "history_schema",
    lambda c: tx.history_schema(c, "main"),
    rf"""coalesce(nullif(regexp_extract(sql, '(?i)(?:FROM|JOIN){SPACE}+([a-zA-Z_][a-zA-Z0-9_]*)\.', 1), ''), 'main')""",
)
on_texts(
    "truncate_label",
    tx.truncate_label,
    rf"""(SELECT CASE WHEN length(f) > 50 THEN concat(substr(f, 1, 50), '...') ELSE f END
     FROM (SELECT trim(regexp_replace(sql, '{SPACE}+', ' ', 'g')) AS f))""",
)

FENCED = r"""
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN concat('---', chr(10), 'title: "Note ', doc_id, '"', chr(10), 'tags: [', lang, ', ''', source, ''', ]', chr(10),
              'connection: main db', chr(10), '---', chr(10), '# ', text)
  WHEN 1 THEN concat('---', chr(10), 'tags:', chr(10), '  - ', lang, chr(10), '  - "', source, '"', chr(10), 'dialect:  spark',
              chr(10), '  - late', chr(10), 'title:   ', source, ' of *', lang, '*', chr(10), '---', chr(10), chr(10), '## ', text)
  WHEN 2 THEN concat('---', chr(10), 'title: never closed', chr(10), text)
  WHEN 3 THEN concat('---', chr(10), 'connection_id: c', doc_id, chr(10), 'tags: []', chr(10), '---', chr(13), chr(10), '---', chr(13), chr(10),
              text, chr(13), chr(10))
  ELSE concat(chr(10), '# **', lang, '** notes', chr(10), chr(10), chr(10), chr(10), text) END AS note
FROM {documents}
"""

HEAD = """CASE WHEN starts_with(note, '---') AND stop > 0 THEN substr(note, 5, stop - 5) ELSE '' END"""
STOP = """(CASE WHEN instr(substr(note, 4), chr(10) || '---') > 0 THEN instr(substr(note, 4), chr(10) || '---') + 3 ELSE 0 END)"""
BODY = """CASE WHEN starts_with(note, '---') AND stop > 0 THEN substr(note, stop + 4) ELSE note END"""
EDGES = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query(
    "front_matter",
    with_inputs(
        rf"""SELECT doc_id,
        nullif(trim(regexp_extract(head, '(?m)^title:\s*([^\n]+)$', 1), ' "' || chr(13)), '') AS title,
        CASE doc_id % 5 WHEN 0 THEN concat(lang, '|', source) WHEN 1 THEN concat(lang, '|', source) END AS tags,
        nullif(regexp_extract(head, '(?m)^connection_id:\s*([^\n]+)$', 1), '') AS connection_id,
        nullif(regexp_extract(head, '(?m)^connection:\s*([^\n]+)$', 1), '') AS connection_name,
        nullif(regexp_extract(head, '(?m)^dialect:\s*([^\n]+)$', 1), '') AS dialect
        FROM (SELECT *, {HEAD} AS head FROM (SELECT n.*, lang, source, {STOP} AS stop
              FROM notes n JOIN documents d USING (doc_id)))""",
        notes=FENCED,
    ),
)
def front_matter(spark, sf):
    notes = texts(spark, sf, FENCED).select("doc_id", tx.front_matter("note").alias("m"))
    return notes.select(
        "doc_id", "m.title", F.array_join("m.tags", "|").alias("tags"), "m.connection_id", "m.connection_name", "m.dialect"
    )


@query(
    "body_normalize",
    with_inputs(
        rf"""SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace({BODY}, '(?m)^#+\s+', '', 'g'),
        '[*_~`]', '', 'g'), chr(13) || chr(10), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {EDGES}) AS body
        FROM (SELECT *, {STOP} AS stop FROM notes)""",
        notes=FENCED,
    ),
)
def body_normalize(spark, sf):
    notes = texts(spark, sf, FENCED)
    return notes.select("doc_id", tx.body_normalize(tx.note_body("note")).alias("body"))


@query(
    "body_summary",
    with_inputs(
        rf"""SELECT doc_id, CASE WHEN length(line) > 200 THEN concat(substr(line, 1, 200), '...') ELSE line END AS summary
        FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({BODY}, '\r?\n'),
          lambda s: trim(regexp_replace(regexp_replace(s, '^#+\s+', ''), '[*_~`]', '', 'g'), {EDGES})),
          lambda s: s <> '' AND NOT starts_with(s, '---'))[1] AS line
        FROM (SELECT *, {STOP} AS stop FROM notes))""",
        notes=FENCED,
    ),
)
def body_summary(spark, sf):
    return texts(spark, sf, FENCED).select("doc_id", tx.body_summary(tx.note_body("note")).alias("summary"))


@query(
    "search_text",
    """SELECT doc_id, lower(concat_ws(' ', nullif(source, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''),
    nullif(text, ''))) AS search_text FROM documents""",
)
def search_text(spark, sf):
    d = read(spark, sf, "documents")
    lang = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return d.select("doc_id", tx.search_text("source", lang, "text").alias("search_text"))


@query(
    "snippet",
    rf"""SELECT doc_id, CASE WHEN hit > 0 THEN regexp_replace(concat(CASE WHEN a > 1 THEN '...' ELSE '' END,
      trim(substr(text, a, b - a + 1), {EDGES}), CASE WHEN b < length(text) THEN '...' ELSE '' END), '{SPACE}+', ' ', 'g') END AS snippet
    FROM (SELECT doc_id, text, hit, greatest(1, hit - 80) AS a, least(length(text), hit + 2 + 79) AS b
      FROM (SELECT doc_id, text, instr(lower(text), 'in') AS hit FROM documents))""",
)
def snippet(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.snippet("text", F.lit("In")).alias("snippet"))


@query(
    "search_tokens",
    r"""SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(line, '"([^"]+)"|([^\s]+)'),
      lambda t: trim(lower(CASE WHEN regexp_matches(t, '^"[^"]+"$') THEN substr(t, 2, length(t) - 2) ELSE t END))),
      lambda t: t <> ''), '|') AS tokens
    FROM (SELECT doc_id AS item_id, concat('"', source, ' ', lang, '" ', text) AS line FROM documents)""",
)
def search_tokens(spark, sf):
    line = F.concat(F.lit('"'), "source", F.lit(" "), "lang", F.lit('" '), "text")
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), line.alias("line"))
    return d.select("item_id", F.array_join(tx.search_tokens("line"), "|").alias("tokens"))


@query(
    "sanitize_identifier",
    """SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM pages""",
)
def sanitize_identifier(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.sanitize_identifier("url").alias("name"))


@query(
    "slugify",
    rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '{SPACE}+', '_', 'g'),
    '[^A-Za-z0-9_\-]+', '_', 'g'), '--+', '_', 'g'), '-') AS slug FROM pages""",
)
def slugify(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.slugify("url").alias("slug"))


@query(
    "sanitize_filename",
    r"""SELECT page_id, regexp_replace(url, '[/\\?%*:|"<>]', '_', 'g') AS name FROM pages""",
)
def sanitize_filename(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.sanitize_filename("url").alias("name"))


@query(
    "edge_label",
    """SELECT p_partkey, CASE WHEN length(t) > 20 THEN concat(substr(t, 1, 19), '...') ELSE t END AS label
    FROM (SELECT p_partkey, concat(p_name, ' ', p_brand, ' ', p_type) AS t FROM part)""",
)
def edge_label(spark, sf):
    t = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return read(spark, sf, "part").select("p_partkey", tx.edge_label(t).alias("label"))


NOW = "timestamp '2024-01-20 13:30:00'"


def now():
    return F.lit("2024-01-20 13:30:00").cast("timestamp_ntz")


@query(
    "recency_bucket",
    """SELECT event_id, CASE WHEN ts >= timestamp '2024-01-20' THEN 'Today' WHEN ts >= timestamp '2024-01-19' THEN 'Yesterday'
    WHEN ts >= timestamp '2024-01-13' THEN 'Last 7 Days' WHEN ts >= timestamp '2023-12-21' THEN 'Last 30 Days'
    ELSE 'Older' END AS bucket FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN timestamp '2023-12-20 23:59:59' ELSE ts END AS ts FROM events)""",
)
def recency_bucket(spark, sf):
    old = F.lit("2023-12-20 23:59:59").cast("timestamp_ntz")
    e = read(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 9 == 0, old).otherwise(F.col("ts")))
    return e.select("event_id", v.recency_bucket("ts", now()).alias("bucket"))


def js_number(c: str) -> str:
    """Numbers with a few decimals below 1e15 as the library prints them."""
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS bigint) AS varchar) ELSE CAST({c} AS varchar) END"


@query(
    "sql_literal",
    f"""SELECT event_id, CAST(event_id AS varchar) AS id_lit, {js_number('value')} AS value_lit,
    concat('''', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z''') AS ts_lit,
    concat('''', replace(concat(props, ' it''s'), '''', ''''''), '''') AS props_lit,
    CASE WHEN value > 50 THEN 'TRUE' ELSE 'FALSE' END AS flag_lit,
    CASE WHEN event_type = 'view' THEN 'NULL' ELSE concat('''', event_type, '''') END AS type_lit,
    CASE WHEN event_id % 3 = 0 THEN 'NULL' ELSE {js_number('value')} END AS nan_lit FROM events""",
)
def sql_literal(spark, sf):
    e = read(spark, sf, "events").select(
        "event_id",
        F.col("event_id").alias("id"),
        "value",
        "ts",
        F.concat("props", F.lit(" it's")).alias("props"),
        (F.col("value") > 50).alias("flag"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("type"),
        F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("nan"),
    )
    lits = [v.sql_literal(F.col(f.name), f.dataType).alias(f"{f.name}_lit") for f in e.schema.fields[1:]]
    return e.select("event_id", *lits)


@query(
    "normalize_type_name",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'varchar' WHEN 1 THEN 'timestamptz' WHEN 2 THEN 'int8'
    WHEN 3 THEN 'jsonb' WHEN 4 THEN 'double' ELSE 'bool' END AS type_name FROM lineitem""",
)
def normalize_type_name(spark, sf):
    names = ["character varying", "TIMESTAMP WITH TIME ZONE", "bigint", "jsonb", "double precision", "Boolean"]
    kind = F.get(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % 6).cast("int"))
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", v.normalize_type_name(kind).alias("type_name")
    )
