"""The registered queries of the operators and, where SQL can say it, the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import edit_counts, exact_dedup, kn_model, mixing, near_dup, packing, quality_rules, ranked_search, resample, suffix_dedup, token_store, warc, window_dedup
from strata.llm.common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]', '', 'g')), 0) AS size,
    (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), bounds AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS bound FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER before, 0)) / sum(w) OVER after AS level
  FROM bounds
  WINDOW before AS (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), free AS (
  SELECT arg_min(level, bound / w) AS level FROM levels WHERE level * w <= bound
), targets AS (
  SELECT source, source_size, coalesce(least(bound, (SELECT level FROM free) * w), bound) AS target FROM bounds
), odds AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank FROM odds
), cumulated AS (
  SELECT *, target - floor(e) * source_size AS need,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(e) + CASE WHEN rank IS NOT NULL AND upto + size / 2.0 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM cumulated
"""


@query(OP1_SQL)
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


@query()
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kn_model.classify(docs, table(spark, sf_dir, "labels"), slack=1.0, own_limits=True, order=7, held_out=True).drop("row")


OP3_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""


@query(OP3_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("__row")


def document_edits(docs: DataFrame) -> DataFrame:
    """Three edits per document, taken from its own text: a passage goes, one is put in twice, one is replaced by blanks."""

    def place(salt: int, size) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), size)

    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    piece = F.substring(F.col("text"), place(4, n + 1).cast("int"), place(5, F.lit(40)).cast("int"))
    edits = F.array(
        F.struct(place(1, n + 1).alias("at"), place(6, F.lit(60)).alias("remove"), F.lit("").alias("put")),
        F.struct(place(2, n + 1).alias("at"), F.lit(0).cast("bigint").alias("remove"), piece.alias("put")),
        F.struct(place(3, n + 1).alias("at"), place(7, F.lit(12)).alias("remove"), F.lit(" \n ").alias("put")),
    )
    return docs.select("doc_id", F.inline(edits))


@query()
def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = edit_counts.recount(docs, edit_counts.stored_trees(docs), document_edits(docs))
    return counted.select("doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_refused", "chars_encoded")


OP9_SQL = r"""
WITH parts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), triples AS (
  SELECT doc_id, i, list_slice(words, i, i + 2) AS triple FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, triple) AS found FROM triples) WHERE found > 1
  ) GROUP BY doc_id
), counts AS (
  SELECT p.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN covered c USING (doc_id)
), rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words = 0 THEN 0 ELSE n_symbols * 1000 // n_words END AS symbol_rate,
    CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 1000 // n_words END AS word_length,
    CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 1000 // n_lines END AS dup_line_rate,
    CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 1000 // n_words END AS repeat_rate
  FROM counts
), long AS (
  UNPIVOT (SELECT lang, source, symbol_rate, word_length, dup_line_rate, repeat_rate FROM rated WHERE NOT base_failed)
  ON symbol_rate, word_length, dup_line_rate, repeat_rate INTO NAME rule VALUE rate
), cells AS (
  SELECT lang, source, rule, (rate >> greatest(length(bin(rate)) - 7, 0)) << greatest(length(bin(rate)) - 7, 0) AS cell FROM long
), own AS (
  SELECT lang, source, rule, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3, count(*) AS n FROM cells GROUP BY ALL
), by_lang AS (
  SELECT lang, rule, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM cells GROUP BY ALL
), chosen AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.n >= 100 THEN o.q1 ELSE l.q1 END AS q1, CASE WHEN o.n >= 100 THEN o.q3 ELSE l.q3 END AS q3
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule
), slack AS (
  SELECT * FROM (VALUES ('symbol_rate', 100, false), ('word_length', 1500, true), ('dup_line_rate', 500, false), ('repeat_rate', 350, false)) t(rule, least, two_sided)
), fence AS (
  SELECT lang, source, rule, CASE WHEN two_sided THEN q1 - greatest(4 * (q3 - q1), least) ELSE 0 END AS low, q3 + greatest(4 * (q3 - q1), least) AS high
  FROM chosen JOIN slack USING (rule)
), out AS (
  SELECT r.doc_id FROM (
    UNPIVOT (SELECT doc_id, lang, source, symbol_rate, word_length, dup_line_rate, repeat_rate FROM rated)
    ON symbol_rate, word_length, dup_line_rate, repeat_rate INTO NAME rule VALUE rate
  ) r JOIN fence f ON r.rule = f.rule AND r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
  WHERE r.rate NOT BETWEEN f.low AND f.high
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept
FROM rated
"""


@query(OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [words] ELSE [words[i:i + 3] FOR i IN range(1, len(words) - 2)] END) AS shingle FROM parts
  )
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common >= 80 * (s.n + t.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), first AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT f.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, f.doc_id = component_id AS kept FROM first f LEFT JOIN sizes USING (doc_id)
"""


@query(OP5_SQL)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH sums AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS html FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM sums
), fives AS (
  SELECT *, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS INT) FOR i IN range(8)] AS parts FROM firsts
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', p % 32 + 1, 1)
    FOR p IN parts], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM fives
"""


@query(OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    names = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, names).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS step
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), found AS (
  SELECT r, unnest(words) AS word FROM docs
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), vocabulary AS (
  SELECT word, hex(word) AS h FROM (SELECT word FROM found UNION SELECT word FROM wanted)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM vocabulary, steps
), s AS (
  SELECT bucket, count(*) AS n FROM found JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM found JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS enough FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * enough // 100 THEN place END AS rank FROM ranked
"""


@query(OP11_SQL)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = resample.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM items GROUP BY ALL
), size AS (
  SELECT count(*) AS n_docs, sum(len(words))::HUGEINT AS n_terms FROM docs WHERE len(words) > 0
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), rated AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, size GROUP BY term, n_docs
), lengths AS (
  SELECT r, doc_id, 100 - 25 + (25 * len(words)::HUGEINT * n_docs) // n_terms AS m FROM docs, size WHERE len(words) > 0
), scored AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf::HUGEINT) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN rated USING (term) JOIN lengths USING (r) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query(OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ranked_search.search(docs, items).select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, doc_id, place, sha256(array_to_string(list_slice(words, place, place + 49), ' ')) AS content
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM docs WHERE len(words) >= 50)
), firsts AS (
  SELECT content, min(doc_id) AS first FROM windows GROUP BY content
), starts AS (
  SELECT r, place FROM windows JOIN firsts USING (content) WHERE first < doc_id
), places AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs
), marked AS (
  SELECT p.r, p.place, word, max(s.place IS NOT NULL) OVER (PARTITION BY p.r ORDER BY p.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM places p LEFT JOIN starts s ON p.r = s.r AND p.place = s.place
), kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS text FROM marked GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (r)
"""


@query(OP13_SQL)
def op13_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = window_dedup.remove_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
