"""A corpus of query texts with notes, derived from documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import text as tx
from strata.operators import corpus, searchindex
from strata.session import cut
from workloads.catalog import COLUMNS
from workloads.registry import derive, query, texts, with_inputs
from workloads.scalars import CANONICAL, SQL_TEXTS

# One query text per document; two thirds have a note, which is the whole document.
QUERIES_OF_DOCS = """
SELECT concat('queries/', lang, '/', source, '/Q', doc_id, '.sql') AS path, CASE WHEN doc_id % 4 = 0 THEN concat('-- Report ', doc_id, chr(10), 'SELECT * FROM silver.', source)
  ELSE concat('SELECT count(*) FROM gold.', lang, ' /* ', doc_id % 10, ' */') END AS sql, e.ts AS created, e.ts AS updated
FROM {documents} LEFT JOIN {events} e ON event_id = doc_id
"""
NOTES_OF_DOCS = """
SELECT concat('queries/', lang, '/', source, '/Q', doc_id, '.md') AS path, concat('---', chr(10), 'title: ', CASE doc_id % 5 WHEN 0 THEN 'report' WHEN 1 THEN 'Report two' WHEN 2 THEN 'The report' ELSE source END,
  chr(10), 'tags: [', lang, ', ', source, ', weekly_report]', chr(10), '---', chr(10), text) AS note FROM {documents} WHERE doc_id % 3 <> 2
"""
# The index rows those give, without the rules on the texts.
INDEXED = """
SELECT concat('queries/', lang, '/', source, '/Q', doc_id, '.sql') AS path, CASE WHEN doc_id % 4 = 0 THEN concat('Report ', doc_id) END AS title,
  CASE WHEN doc_id % 3 <> 2 THEN CASE doc_id % 5 WHEN 0 THEN 'report' WHEN 1 THEN 'Report two' WHEN 2 THEN 'The report' ELSE source END END AS md_title,
  CASE WHEN doc_id % 3 <> 2 THEN concat(lang, ' ', source, ' weekly_report') END AS tags, CASE WHEN doc_id % 3 <> 2 THEN text END AS md_body,
  concat('select ', source, ' ', lang) AS search_text, lang, source, doc_id, e.ts AS updated, CASE WHEN doc_id % 7 = 0 THEN e.ts END AS last_run
FROM {documents} LEFT JOIN {events} e ON event_id = doc_id
"""


def index_rows(spark, sf):
    rows = derive(spark, sf, INDEXED)
    return rows.withColumn("tags", F.split("tags", " ")).drop("lang", "source", "doc_id")


@query(
    "corpus_companion_join",
    with_inputs(
        """SELECT q.path, q.sql, q.created, q.updated, n.path AS note_path, n.note FROM q LEFT JOIN n
        ON replace(q.path, '.sql', '') = replace(n.path, '.md', '')""",
        q=QUERIES_OF_DOCS,
        n=NOTES_OF_DOCS,
    ),
)
def corpus_companion_join(spark, sf):
    return corpus.companion_join(derive(spark, sf, QUERIES_OF_DOCS), derive(spark, sf, NOTES_OF_DOCS))


EDGES = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
PLAIN = rf"""trim(regexp_replace(replace(regexp_replace(regexp_replace(body, '(?m)^#+\s+', '', 'g'), '[*_~`]', '', 'g'),
  chr(13) || chr(10), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {EDGES})"""
FIRST_LINE = rf"""list_filter(list_transform(string_split_regex(body, '\r?\n'), lambda s: trim(regexp_replace(regexp_replace(s, '^#+\s+', ''), '[*_~`]', '', 'g'), {EDGES})),
  lambda s: s <> '' AND NOT starts_with(s, '---'))[1]"""


@query(
    "corpus_index",
    with_inputs(
        rf"""SELECT path, sql_hash, title, md_title, tags, md_body, CASE WHEN length(line) > 200 THEN concat(substr(line, 1, 200), '...') ELSE line END AS md_summary,
          lower(concat_ws(' ', md_title, title, nullif(tags, ''), nullif(md_body, ''), path, sql)) AS search_text FROM (
          SELECT q.path, q.sql, sha256({CANONICAL.replace('sql', 'q.sql')}) AS sql_hash, i.title, i.md_title, i.tags, CASE WHEN body IS NOT NULL THEN {PLAIN} END AS md_body, {FIRST_LINE} AS line
          FROM q JOIN (SELECT *, md_body AS body FROM i) i ON i.path = q.path)""",
        q=QUERIES_OF_DOCS,
        i=INDEXED,
    ),
)
def corpus_index(spark, sf):
    joined = corpus.companion_join(derive(spark, sf, QUERIES_OF_DOCS), derive(spark, sf, NOTES_OF_DOCS))
    index = corpus.corpus_index(joined).withColumn("tags", F.array_join("tags", " "))
    return index.select("path", "sql_hash", "title", "md_title", "tags", "md_body", "md_summary", "search_text")


def score(token: str, scope: str = "all") -> str:
    """Score of a token on an index row, for the check."""
    t = f"lower(coalesce(md_title, title, ''))"
    parts = {
        "title": f"CASE WHEN {t} = '{token}' THEN 100 WHEN starts_with({t}, '{token}') THEN 80 WHEN contains({t}, '{token}') THEN 60 ELSE 0 END",
        "tags": f"""CASE WHEN list_contains(string_split(lower(coalesce(tags, '')), ' '), '{token}') THEN 50
          WHEN len(list_filter(string_split(lower(coalesce(tags, '')), ' '), lambda x: contains(x, '{token}'))) > 0 THEN 40 ELSE 0 END""",
        "notes": f"CASE WHEN contains(lower(coalesce(md_body, '')), '{token}') THEN 30 ELSE 0 END",
        "path": f"""CASE WHEN contains(string_split(lower(path), '/')[-1], '{token}') THEN 25 WHEN contains(lower(path), '{token}') THEN 20 ELSE 0 END""",
    }
    best = f"greatest({', '.join(v for k, v in parts.items() if scope in ('all', k))}, 0)"
    if scope not in ("all", "sql"):
        return best
    if scope == "sql":
        best = "0"
    return f"CASE WHEN {best} > 0 THEN {best} WHEN contains(lower(search_text), '{token}') THEN 10 ELSE 0 END"


def searched(tokens: list[str], scope: str = "all", rows: int = 200) -> str:
    names = [f"s{i}" for i in range(len(tokens))]
    scores = ", ".join(f"{score(t, scope)} AS {n}" for t, n in zip(tokens, names))
    return f"""SELECT path, CAST({' + '.join(names)} AS integer) AS score FROM (SELECT *, {scores} FROM i)
      WHERE {' AND '.join(f'{n} > 0' for n in names)} ORDER BY score DESC, coalesce(last_run, updated) DESC, path LIMIT {rows}"""


@query("corpus_search", with_inputs(searched(["report", "en"]), i=INDEXED))
def corpus_search(spark, sf):
    return corpus.corpus_search(index_rows(spark, sf), '"report" EN').select("path", "score")


@query("search_topk", with_inputs(searched(["select src1"]), i=INDEXED))
def search_topk(spark, sf):
    return corpus.corpus_search(index_rows(spark, sf), '"Select src1"').select("path", "score")


def _scoped(scope: str, tokens: list[str]):
    @query(
        "corpus_search_scoped" if scope == "tags" else f"corpus_search_{scope}", with_inputs(searched(tokens, scope), i=INDEXED)
    )
    def run(spark, sf):
        return corpus.corpus_search(index_rows(spark, sf), " ".join(tokens), scope).select("path", "score")


_scoped("tags", ["src1"])
_scoped("title", ["report"])
_scoped("notes", ["the", "in"])
_scoped("sql", ["select", "src2"])


@query(
    "corpus_search_many",
    with_inputs(
        "\nUNION ALL ".join(
            f"SELECT '{name}' AS query_id, path, CAST({' + '.join(f'({score(t)})' for t in tokens)} AS integer) AS score FROM i WHERE {' AND '.join(f'({score(t)}) > 0' for t in tokens)}"
            for name, tokens in (("a", ["report"]), ("b", ["weekly", "fr"]), ("c", ["und", "q1"]))
        ),
        i=INDEXED,
    ),
)
def corpus_search_many(spark, sf):
    return corpus.corpus_search_many(index_rows(spark, sf), {"a": "report", "b": "weekly fr", "c": "und Q1"})


# A line per customer: a phrase or word and a number, in a few hundred different lines.
LINES = """
SELECT c_custkey AS line_id, CASE c_custkey % 5 WHEN 0 THEN '"the report"' WHEN 1 THEN 'REPORT' WHEN 2 THEN 'weekly' WHEN 3 THEN 'src1' ELSE 'e' END AS first,
  concat('q', c_custkey % 120) AS second FROM {customer}
"""
_TOKENS = """tokens AS (SELECT DISTINCT lower(trim(replace(first, '"', ''))) AS token FROM l UNION SELECT DISTINCT second FROM l)"""
_TITLE = "lower(coalesce(md_title, title, ''))"


@query(
    "corpus_search_lines",
    with_inputs(
        f"""SELECT * FROM (WITH {_TOKENS}, s AS (SELECT token, path, coalesce(last_run, updated) AS at, CASE WHEN best > 0 THEN best WHEN contains(lower(search_text), token) THEN 10 ELSE 0 END AS score
          FROM (SELECT *, greatest(CASE WHEN {_TITLE} = token THEN 100 WHEN starts_with({_TITLE}, token) THEN 80 WHEN contains({_TITLE}, token) THEN 60 ELSE 0 END,
            CASE WHEN list_contains(string_split(lower(coalesce(tags, '')), ' '), token) THEN 50 WHEN contains(lower(coalesce(tags, '')), token) AND NOT contains(token, ' ') THEN 40 ELSE 0 END,
            CASE WHEN contains(lower(coalesce(md_body, '')), token) THEN 30 ELSE 0 END,
            CASE WHEN contains(string_split(lower(path), '/')[-1], token) THEN 25 WHEN contains(lower(path), token) THEN 20 ELSE 0 END) AS best FROM i, tokens)),
        hits AS (SELECT * FROM s WHERE score > 0),
        pairs AS (SELECT DISTINCT first, second FROM l),
        found AS (SELECT first, second, a.path, a.score + b.score AS score, row_number() OVER (PARTITION BY first, second ORDER BY a.score + b.score DESC, a.at DESC NULLS LAST, a.path) AS rank
          FROM pairs JOIN hits a ON a.token = lower(trim(replace(first, '"', ''))) JOIN hits b ON b.token = second AND a.path = b.path)
        SELECT line_id, rank::INT AS rank, path, score::INT AS score FROM l JOIN found USING (first, second) WHERE rank <= 25)""",
        i=INDEXED,
        l=LINES,
    ),
)
def corpus_search_lines(spark, sf):
    """One search line per customer, through a stored index."""
    index = searchindex.build_search_index(index_rows(spark, sf))
    lines = derive(spark, sf, LINES).select("line_id", F.concat_ws(" ", "first", "second").alias("line"))
    return searchindex.search_lines(index, lines, rows=25).select("line_id", "rank", "path", "score")


@query(
    "recent_entries",
    with_inputs("SELECT path, last_run, updated FROM i ORDER BY coalesce(last_run, updated) DESC, path LIMIT 50", i=INDEXED),
)
def recent_entries(spark, sf):
    return corpus.recent_entries(index_rows(spark, sf)).select("path", "last_run", "updated")


HASHED = f"(SELECT path, sha256({CANONICAL}) AS sql_hash FROM texts)"


def hashed_texts(spark, sf):
    return texts(spark, sf, SQL_TEXTS).select("path", tx.sql_hash("sql").alias("sql_hash"))


@query(
    "hash_groups",
    with_inputs(
        f"SELECT sql_hash, count(*) AS n_queries, min(path) AS first_path, max(path) AS last_path FROM {HASHED} GROUP BY sql_hash",
        texts=SQL_TEXTS,
    ),
)
def hash_groups(spark, sf):
    return corpus.hash_groups(hashed_texts(spark, sf))


@query(
    "hash_members",
    with_inputs(
        f"""SELECT path, sql_hash, count(*) OVER (PARTITION BY sql_hash) AS n_queries, min(path) OVER (PARTITION BY sql_hash) AS first_path,
        count(*) OVER (PARTITION BY sql_hash) - 1 AS n_others FROM {HASHED}""",
        texts=SQL_TEXTS,
    ),
)
def hash_members(spark, sf):
    return corpus.hash_members(cut(hashed_texts(spark, sf), "hashes"))


@query(
    "similar_queries",
    with_inputs(
        f"""SELECT path, sql_hash FROM {HASHED} WHERE path <> (SELECT path FROM texts WHERE qid = 9)
        AND sql_hash = (SELECT sql_hash FROM {HASHED} WHERE path = (SELECT path FROM texts WHERE qid = 9))""",
        texts=SQL_TEXTS,
    ),
)
def similar_queries(spark, sf):
    path = texts(spark, sf, SQL_TEXTS).where("qid = 9").select("path").first()[0]
    return corpus.similar_queries(hashed_texts(spark, sf), path)


FILES = "SELECT concat('queries/', lang, '/', source, '/Q', doc_id, '.sql') AS path, text AS md_body FROM {documents} WHERE doc_id % 5 <> 0"


@query(
    "corpus_cleanup",
    with_inputs(
        """SELECT path, title, md_body FROM i WHERE doc_id % 2 = 0 AND path IN (SELECT path FROM f)
        UNION ALL SELECT path, NULL, md_body FROM f WHERE path NOT IN (SELECT path FROM i WHERE doc_id % 2 = 0)""",
        i=INDEXED,
        f=FILES,
    ),
)
def corpus_cleanup(spark, sf):
    index = derive(spark, sf, INDEXED).where("doc_id % 2 = 0").select("path", "title", "md_body")
    return corpus.corpus_cleanup(index, derive(spark, sf, FILES))


# -- descriptions --------------------------------------------------------------------------------

DESCRIBED = """
SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END, '.Ent', o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 's' WHEN 1 THEN 'es' ELSE '' END) AS key, concat('about ', o_orderpriority) AS description,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ai' ELSE 'manual' END AS source, o_orderkey % 10 = 0 AS stale FROM {orders} WHERE o_orderkey % 4 <> 3
"""
INCOMING = """
SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END, '.Ent', o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 's' WHEN 1 THEN 'es' ELSE '' END) AS key, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('new ', o_totalprice) END AS description
FROM {orders} WHERE o_orderkey % 3 <> 1
"""
COLUMN_TEXTS = f"SELECT concat(table_schema, '.', table_name, '.', column_name) AS key, concat('as ', data_type, ' ', ordinal) AS description FROM ({COLUMNS}) c WHERE ordinal % 2 = 0"
REFERRED = "SELECT concat(table_schema, '.', table_name) AS table_ref, ordinal FROM ({columns}) c WHERE ordinal < 3".format(columns=COLUMNS)


@query(
    "merge_descriptions",
    with_inputs(
        """SELECT coalesce(e.key, n.key) AS key, CASE WHEN takes THEN n.description ELSE e.description END AS description,
          CASE WHEN takes THEN 'ai' ELSE e.source END AS source, CASE WHEN takes THEN false ELSE e.stale END AS stale
        FROM (SELECT e.*, n.*, n.key IS NOT NULL AND coalesce(e.source, 'ai') = 'ai' AS takes FROM
          (SELECT * FROM e) e FULL JOIN (SELECT * FROM n WHERE description <> '') n ON e.key = n.key)""".replace(
            """SELECT coalesce(e.key, n.key) AS key, CASE WHEN takes THEN n.description ELSE e.description END AS description,
          CASE WHEN takes THEN 'ai' ELSE e.source END AS source, CASE WHEN takes THEN false ELSE e.stale END AS stale
        FROM (SELECT e.*, n.*, n.key IS NOT NULL AND coalesce(e.source, 'ai') = 'ai' AS takes FROM""",
            """SELECT coalesce(ek, nk) AS key, CASE WHEN takes THEN nd ELSE ed END AS description, CASE WHEN takes THEN 'ai' ELSE source END AS source,
          CASE WHEN takes THEN false ELSE stale END AS stale
        FROM (SELECT e.key AS ek, n.key AS nk, n.description AS nd, e.description AS ed, e.source, e.stale, n.key IS NOT NULL AND coalesce(e.source, 'ai') = 'ai' AS takes FROM""",
        ),
        e=DESCRIBED,
        n=INCOMING,
    ),
)
def merge_descriptions(spark, sf):
    return corpus.merge_descriptions(derive(spark, sf, DESCRIBED), derive(spark, sf, INCOMING))


@query(
    "stale_descriptions",
    with_inputs(
        """SELECT key, description, source, key NOT IN (SELECT concat(table_schema, '.', table_name) FROM c) AS stale FROM e""",
        e=DESCRIBED,
        c=COLUMNS,
    ),
)
def stale_descriptions(spark, sf):
    known = derive(spark, sf, COLUMNS).select(F.concat_ws(".", "table_schema", "table_name").alias("key"))
    return corpus.stale_descriptions(derive(spark, sf, DESCRIBED), known)


JOINED = """SELECT concat(c.table_schema, '.', c.table_name) AS table_ref, t.description AS table_description, column_name, data_type, ordinal,
  d.description AS column_description FROM c LEFT JOIN t ON t.key = concat(c.table_schema, '.', c.table_name)
  LEFT JOIN d ON d.key = concat(c.table_schema, '.', c.table_name, '.', column_name)
  WHERE concat(c.table_schema, '.', c.table_name) IN (SELECT table_ref FROM r)"""


@query("describe_join", with_inputs(JOINED, c=COLUMNS, t=DESCRIBED, d=COLUMN_TEXTS, r=REFERRED))
def describe_join(spark, sf):
    return corpus.describe_join(*[derive(spark, sf, x) for x in (REFERRED, COLUMNS, DESCRIBED, COLUMN_TEXTS)])


# Texts that refer to one or two of the described tables.
CONTEXT_TEXTS = """
SELECT o_orderkey AS qid, concat('SELECT * FROM bronze.Ent', o_custkey * 15, 's a JOIN silver.Ent', o_custkey * 15 + 7, ' b ON a.id = b.id JOIN gold.Missing', o_custkey, ' ON 1=1') AS sql FROM {orders}
"""


@query(
    "query_context",
    with_inputs(
        f""", j AS ({JOINED}),
        tabs AS (SELECT table_ref, concat('{{"schema":"', split_part(table_ref, '.', 1), '","table":"', split_part(table_ref, '.', 2), '"',
          CASE WHEN max(table_description) IS NULL THEN '' ELSE concat(',"description":"', max(table_description), '"') END, ',"columns":[',
          string_agg(concat('{{"name":"', column_name, '","type":"', data_type, '"', CASE WHEN column_description IS NULL THEN '' ELSE concat(',"description":"', column_description, '"') END, '}}'), ',' ORDER BY ordinal, column_name), ']}}') AS entry
          FROM j GROUP BY table_ref),
        refs AS (SELECT qid, concat('bronze.Ent', o_custkey * 15, 's') AS table_ref FROM q JOIN orders ON o_orderkey = qid UNION SELECT qid, concat('silver.Ent', o_custkey * 15 + 7) FROM q JOIN orders ON o_orderkey = qid),
        full_text AS (SELECT qid, concat('{{"tables":[', string_agg(entry, ',' ORDER BY table_ref), ']}}') AS body FROM refs JOIN tabs USING (table_ref) GROUP BY qid)
        SELECT qid, CASE WHEN length(body) > 600 THEN concat(substr(body, 1, 600), chr(10), '...truncated...') ELSE body END AS context FROM full_text""",
        c=COLUMNS,
        t=DESCRIBED,
        d=COLUMN_TEXTS,
        q=CONTEXT_TEXTS,
        r="SELECT concat('bronze.Ent', o_custkey * 15, 's') AS table_ref FROM {orders} UNION SELECT concat('silver.Ent', o_custkey * 15 + 7) FROM {orders}",
    ).replace(")\n, j AS", "),\nj AS"),
)
def query_context(spark, sf):
    queries = texts(spark, sf, CONTEXT_TEXTS)
    refs = queries.select(F.explode(corpus.table_refs("sql")).alias("table_ref"))
    described = corpus.describe_join(refs, *[derive(spark, sf, x) for x in (COLUMNS, DESCRIBED, COLUMN_TEXTS)])
    return corpus.query_context(queries, "qid", described, 600)


# Answers in text form with JSON blocks: bare, fenced, several in one text, and broken ones.
ANSWERS = """
SELECT o_orderkey AS answer_id, CASE o_orderkey % 5
  WHEN 0 THEN concat('{{"table": {{"key": "s.t', o_orderkey, '", "description": "table of ', o_custkey, '"}}, "columns": [{{"key": "s.t', o_orderkey, '.c", "description": "price", "sampleValue": "', o_custkey, '"}}, {{"key": "", "description": "x"}}]}}')
  WHEN 1 THEN concat('```json', chr(10), '{{"columns": [{{"key": "s.t', o_orderkey, '.d", "description": "day"}}]}}', chr(10), '```')
  WHEN 2 THEN concat('{{"table": {{"key": "s.a', o_orderkey, '", "description": "first"}}', chr(10), '}}', chr(10), 'and', chr(10), '{{"table": {{"key": "s.b', o_orderkey, '", "description": "second"}}', chr(10), '}}')
  WHEN 3 THEN concat('[{{"table": {{"key": "s.l', o_orderkey, '", "description": "listed"}}}}, {{"other": 1}}]')
  ELSE concat('no JSON here ', o_comment) END AS text FROM (SELECT *, o_orderpriority AS o_comment FROM {orders}) o
"""


@query(
    "description_blocks",
    """SELECT o_orderkey AS answer_id, CAST(b AS integer) AS block_no, kind, concat(p, o_orderkey, x) AS target, replace(d, '#', CAST(o_custkey AS varchar)) AS description,
      CASE WHEN v THEN CAST(o_custkey AS varchar) END AS sample_value FROM orders JOIN (VALUES
      (0, 0, 'table', 's.t', '', 'table of #', false), (0, 0, 'column', 's.t', '.c', 'price', true), (1, 0, 'column', 's.t', '.d', 'day', false),
      (2, 0, 'table', 's.a', '', 'first', false), (2, 1, 'table', 's.b', '', 'second', false), (3, 0, 'table', 's.l', '', 'listed', false)
      ) t(m, b, kind, p, x, d, v) ON o_orderkey % 5 = m""",
)
def description_blocks(spark, sf):
    return corpus.description_blocks(texts(spark, sf, ANSWERS), "answer_id")
