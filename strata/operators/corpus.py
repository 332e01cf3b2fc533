"""The corpus of query texts: index, groups of equal texts, search, and descriptions.

Index rows: path, title, md_title, tags (array), md_body, search_text, sql_hash, created, updated,
last_run (times may be null).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions import text as tx
from strata.functions.sqlparts import table_refs
from strata.operators.spread import HOT_ROWS, spread_join, top_per_key
from strata.session import cut

# Scores of a token by where it is found, and sizes.
TITLE_EQUAL, TITLE_PREFIX, TITLE_PART = 100, 80, 60
TAG_EQUAL, TAG_PART, NOTE, FILE_NAME, PATH, TEXT = 50, 40, 30, 25, 20, 10
SEARCH_ROWS = 200
RECENT_ROWS = 50
CONTEXT_CHARS = 150_000
CONTEXT_START = '{"tables":['
CONTEXT_END = "\n...truncated..."


def companion_join(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """Query texts with the note of the same base path, where there is one."""
    base = lambda: F.regexp_replace("path", r"\.[^./]+$", "")
    kept = notes.select(base().alias("base"), F.col("path").alias("note_path"), F.col("note"))
    return queries.withColumn("base", base()).join(kept, "base", "left").drop("base")


def corpus_index(corpus: DataFrame) -> DataFrame:
    """Index of texts: hash, title, note fields and search text.

    `corpus`: path, sql, note, created, updated, and optionally last_run, connection, dialect.
    """
    has = set(corpus.columns)
    null = F.lit(None).cast("string")
    meta = corpus.withColumn("_m", F.when(F.col("note").isNotNull(), tx.front_matter("note")))
    given = lambda name, own: F.coalesce(own, F.col(name)) if name in has else own
    fields = meta.select(
        "path",
        "sql",
        tx.sql_hash("sql").alias("sql_hash"),
        tx.query_title("sql").alias("title"),
        F.col("_m.title").alias("md_title"),
        F.col("_m.tags").alias("tags"),
        tx.body_normalize(tx.note_body("note")).alias("md_body"),
        tx.body_summary(tx.note_body("note")).alias("md_summary"),
        given("connection", F.col("_m.connection_name")).alias("connection"),
        given("dialect", F.col("_m.dialect")).alias("dialect"),
        "created",
        "updated",
        (F.col("last_run") if "last_run" in has else F.lit(None).cast("timestamp_ntz")).alias("last_run"),
    )
    search = tx.search_text(
        F.col("md_title"), F.col("title"), F.array_join("tags", " "), F.col("md_body"), F.col("path"),
        F.col("connection"), F.col("dialect"), F.col("sql"),
    )
    return fields.withColumn("search_text", search).drop("sql")


def hash_groups(hashed: DataFrame) -> DataFrame:
    """One row per hash: number of texts, and the first and last path.

    The members stay where they are (see `hash_members`): a group may hold much of the corpus.
    """
    return hashed.groupBy("sql_hash").agg(
        F.count(F.lit(1)).alias("n_queries"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def hash_members(hashed: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Each text with its group: size, number of the others, and the path that names the group.

    The equal texts of a path are the rows of the same ``first_path``; the group is given in this
    form because its pairs would grow with the square of its size.
    """
    groups = hash_groups(hashed).drop("last_path")
    joined = spread_join(hashed, groups, ["sql_hash"], "inner", min_rows)
    return joined.withColumn("n_others", F.col("n_queries") - 1)


def similar_queries(hashed: DataFrame, path: str) -> DataFrame:
    """The other texts equal to the one at `path`."""
    own = hashed.where(F.col("path") == path).select("sql_hash").distinct().limit(1)
    # One row at most.
    return hashed.where(F.col("path") != path).join(F.broadcast(own), "sql_hash", "left_semi")


def corpus_cleanup(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index after a look at the files: entries without a file go, new files come in."""
    here = files.select("path").distinct()
    kept = index.join(here, "path", "left_semi")
    new = files.join(index.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def recency(df: DataFrame) -> Column:
    return F.coalesce(F.col("last_run"), F.col("updated")) if "last_run" in df.columns else F.col("updated")


def recent_entries(index: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """The entries used last, newest first."""
    return index.orderBy(recency(index).desc_nulls_last(), "path").limit(rows)


def token_score(token: Column, scope: str = "all") -> Column:
    """Score of one lower-case token on an index row; 0 when it is not found."""
    title = F.lower(F.coalesce("md_title", "title", F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    body = F.lower(F.coalesce("md_body", F.lit("")))
    path = F.lower("path")
    name = F.element_at(F.split(path, "/"), -1)
    text = F.lower(F.coalesce("search_text", F.lit("")))
    zero = F.lit(0)
    on = lambda *scopes: scope == "all" or scope in scopes
    parts = [
        F.when(title == token, TITLE_EQUAL)
        .when(title.startswith(token), TITLE_PREFIX)
        .when(title.contains(token), TITLE_PART)
        .otherwise(zero)
        if on("title")
        else zero,
        F.when(F.array_contains(tags, token), TAG_EQUAL)
        .when(F.exists(tags, lambda t: t.contains(token)), TAG_PART)
        .otherwise(zero)
        if on("tags")
        else zero,
        F.when(body.contains(token), NOTE).otherwise(zero) if on("notes") else zero,
        F.when(name.contains(token), FILE_NAME).when(path.contains(token), PATH).otherwise(zero)
        if on()
        else zero,
    ]
    best = F.greatest(*parts)
    if not on("sql"):
        return best
    return F.when(best > 0, best).when(text.contains(token), TEXT).otherwise(zero)


def search_tokens(query: str) -> list[str]:
    """Tokens of one search line: quoted phrases and words, lower-cased."""
    found = re.findall(r'"([^"]+)"|(\S+)', query)
    return [t for t in ((a or b).lower().strip() for a, b in found) if t]


def corpus_search(index: DataFrame, query: str, scope: str = "all", rows: int = SEARCH_ROWS) -> DataFrame:
    """Entries that hit every token, by score and then recency, with a snippet of the note.

    One pass with literal tokens and a top-k; `rows` is the length of the result list.
    """
    tokens = search_tokens(query)
    if not tokens:
        return index.limit(0).withColumn("score", F.lit(0)).withColumn("snippet", F.lit(None).cast("string"))
    scores = [token_score(F.lit(t), scope) for t in tokens]
    scored = index.withColumn("_scores", F.array(*scores)).where(F.array_min("_scores") > 0)
    total = F.aggregate("_scores", F.lit(0), lambda a, b: a + b)
    # The first token whose best place is the note supplies the snippet.
    snippets = [
        F.when(F.get("_scores", i) == NOTE, tx.snippet("md_body", F.lit(t))) for i, t in enumerate(tokens)
    ]
    return (
        scored.withColumn("score", total)
        .orderBy(F.col("score").desc(), recency(index).desc_nulls_last(), "path")
        .limit(rows)
        .withColumn("snippet", F.coalesce(*snippets))
        .drop("_scores")
    )


def corpus_search_many(index: DataFrame, queries: dict[str, str], scope: str = "all") -> DataFrame:
    """Scores of several search lines in one pass over the index: query_id, path, score.

    Each row is scored for the lines it fits; lines are literals, so nothing is joined.
    """
    entries = []
    for query_id, query in queries.items():
        scores = F.array(*[token_score(F.lit(t), scope) for t in search_tokens(query)])
        total = F.aggregate(scores, F.lit(0), lambda a, b: a + b)
        entries.append(
            F.struct(
                F.lit(query_id).alias("query_id"), F.when(F.array_min(scores) > 0, total).otherwise(0).alias("score")
            )
        )
    hits = F.filter(F.array(*entries), lambda e: e["score"] > 0)
    return index.select("path", F.explode(hits).alias("h")).select("h.query_id", "path", "h.score")


# -- descriptions --------------------------------------------------------------------------------


def describe_join(refs: DataFrame, columns: DataFrame, table_texts: DataFrame, column_texts: DataFrame) -> DataFrame:
    """Columns of the referenced tables with table and column descriptions.

    `refs`: table_ref. `columns`: table_schema, table_name, column_name, data_type, ordinal.
    Descriptions: key, description.
    """
    wanted = refs.select("table_ref").distinct()
    table_key = F.concat_ws(".", "table_schema", "table_name")
    keyed = columns.withColumn("table_ref", table_key).join(wanted, "table_ref", "left_semi")
    keyed = keyed.withColumn("column_key", F.concat_ws(".", "table_ref", "column_name"))
    t = table_texts.select(F.col("key").alias("table_ref"), F.col("description").alias("table_description"))
    c = column_texts.select(F.col("key").alias("column_key"), F.col("description").alias("column_description"))
    return (
        keyed.join(t, "table_ref", "left")
        .join(c, "column_key", "left")
        .select("table_ref", "table_description", "column_name", "data_type", "ordinal", "column_description")
    )


def query_context(texts: DataFrame, key: str, described: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Per text a JSON listing of the tables it refers to, cut at a character limit.

    `described` comes from `describe_join`. Only as many columns and tables are gathered as can
    show before the cut: an entry takes at least a dozen characters, so the ranks below suffice
    for the exact text, and the gathered lists stay small whatever a table's width.
    """
    enough = max_chars // 12 + 1
    column_entry = F.struct(
        F.col("column_name").alias("name"), F.col("data_type").alias("type"),
        F.col("column_description").alias("description"),
    )
    tables = (
        top_per_key(described, ["table_ref"], [F.col("ordinal"), F.col("column_name")], enough)
        .groupBy("table_ref")
        .agg(
            F.max("table_description").alias("description"),
            F.array_sort(F.collect_list(F.struct("_rn", column_entry.alias("c")))).alias("_cols"),
        )
    )
    entry = F.struct(
        F.substring_index("table_ref", ".", 1).alias("schema"),
        F.substring_index("table_ref", ".", -1).alias("table"),
        "description",
        F.transform("_cols", lambda x: x["c"]).alias("columns"),
    )
    shown = cut(tables.select("table_ref", F.to_json(entry).alias("entry")), "entries")
    refs = cut(texts.select(key, F.explode(table_refs("sql")).alias("table_ref")), "refs")
    # Ranks and lengths go first; an entry travels only to the texts in which it begins before the cut.
    sizes = shown.select("table_ref", F.length("entry").alias("_size"))
    ranked = top_per_key(spread_join(refs, sizes, ["table_ref"], "inner"), [key], [F.col("table_ref")], enough)
    before = Window.partitionBy(key).orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.lit(len(CONTEXT_START)) + F.coalesce(F.sum(F.col("_size") + 1).over(before), F.lit(0))
    visible = cut(ranked.withColumn("_begin", begin).where(F.col("_begin") <= max_chars).select(key, "table_ref", "_rn"), "visible")
    listed = (
        spread_join(visible, shown, ["table_ref"], "inner")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "entry"))).alias("_t"))
    )
    body = F.concat(F.lit(CONTEXT_START), F.array_join(F.transform("_t", lambda x: x["entry"]), ","), F.lit("]}"))
    cut_off = F.concat(F.substring(body, 1, max_chars), F.lit(CONTEXT_END))
    return listed.select(key, F.when(F.length(body) > max_chars, cut_off).otherwise(body).alias("context"))


def stale_descriptions(descriptions: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Descriptions with ``stale`` set where their key is not in the catalog (column ``key``)."""
    known = known_keys.select("key").distinct().withColumn("_known", F.lit(True))
    return descriptions.join(known, "key", "left").withColumn("stale", F.col("_known").isNull()).select(
        *descriptions.columns if "stale" in descriptions.columns else [*descriptions.columns, "stale"]
    )


def merge_descriptions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Descriptions after an import: new ones replace absent or machine-made ones, manual ones stay.

    Both sides: key, description, source, stale; blank texts are skipped. Of several texts for a key
    the one of the last block counts (``block_no``, where the import has it), then the greatest. A
    ``sample_value`` on both sides goes with the text that stays.
    """
    usable = incoming.where(F.coalesce("description", F.lit("")) != "")
    order = F.struct(*[c for c in ("block_no", "description") if c in incoming.columns])
    samples = ["sample_value"] if {"sample_value"} <= set(existing.columns) & set(incoming.columns) else []
    new = usable.groupBy("key").agg(
        F.max_by("description", order).alias("_new"), *[F.max_by(s, order).alias("_sample") for s in samples]
    )
    takes = F.col("_new").isNotNull() & (F.col("source").isNull() | (F.col("source") == "ai"))
    return existing.join(new, "key", "full").select(
        "key",
        F.when(takes, F.col("_new")).otherwise(F.col("description")).alias("description"),
        F.when(takes, "ai").otherwise(F.col("source")).alias("source"),
        F.when(takes, F.lit(False)).otherwise(F.col("stale")).alias("stale"),
        *[F.when(takes, F.col("_sample")).otherwise(F.col(s)).alias(s) for s in samples],
    )


_BLOCK = (
    "struct<schemaDescription:string, table:struct<key:string, description:string>, "
    "columns:array<struct<key:string, description:string, sampleValue:string>>>"
)


def description_blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Table and column descriptions found in JSON blocks of texts, fenced or bare.

    A text is one object, an array of objects, or several objects that each end on a line of
    their own; what does not parse, or names neither table nor columns, is skipped. Columns:
    `key`, block_no, kind (schema, table or column), target, description, sample_value. The schema
    is that of the block's table, or of its first column.
    """
    clean = tx.strip(F.regexp_replace(F.regexp_replace(F.col(text), r"```json\s*", ""), r"```\s*", ""))
    listed = F.from_json(clean, f"array<{_BLOCK}>")
    one = F.from_json(clean, _BLOCK)
    pieces = F.transform(
        F.regexp_extract_all(clean, F.lit(r"(?s)\{.*?\n\}"), F.lit(0)), lambda p: F.from_json(p, _BLOCK)
    )
    valid = lambda b: b["table"].isNotNull() | b["columns"].isNotNull()
    whole = F.when(clean.startswith("["), listed).otherwise(F.array(one))
    good = F.filter(F.coalesce(whole, F.array().cast(f"array<{_BLOCK}>")), valid)
    # As the only element of an array the text parses to its end or not at all.
    single = F.json_array_length(F.concat(F.lit("["), clean, F.lit("]"))) == 1
    blocks = F.when(single, good).otherwise(F.filter(pieces, valid))
    rows = texts.select(key, F.posexplode(blocks).alias("block_no", "b"))
    none = F.lit(None).cast("string")
    first = F.coalesce(F.col("b.table.key"), F.get("b.columns.key", F.lit(0)))
    table = F.array(
        F.struct(
            F.lit("schema").alias("kind"), F.when(first.contains("."), F.substring_index(first, ".", 1)).alias("target"),
            F.col("b.schemaDescription").alias("description"), none.alias("sample_value"),
        ),
        F.struct(
            F.lit("table").alias("kind"), F.col("b.table.key").alias("target"),
            F.col("b.table.description").alias("description"), none.alias("sample_value"),
        ),
    )
    columns = F.transform(
        F.coalesce("b.columns", F.array().cast("array<struct<key:string,description:string,sampleValue:string>>")),
        lambda c: F.struct(
            F.lit("column").alias("kind"), c["key"].alias("target"), c["description"].alias("description"),
            c["sampleValue"].alias("sample_value"),
        ),
    )
    found = rows.select(key, "block_no", F.explode(F.concat(table, columns)).alias("d")).select(key, "block_no", "d.*")
    return found.where((F.coalesce("target", F.lit("")) != "") & (F.coalesce("description", F.lit("")) != ""))
