"""Parts of SQL texts as column expressions: table references, aliases, select items.

These are heuristics over a column of texts. All but one are built-in functions, whose patterns
read a text in one go whatever its length; following parentheses takes a state, which is what the
one vectorized function here is for. Nothing is looked up across rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import BLOCK_COMMENT, LINE_COMMENT, WORD_END, WORD_START, WS, col, strip
from strata.session import LAYERS

# Words that are no table alias and no column, and scores of select items.
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "ON", "AND", "OR", "AS", "CASE", "WHEN", "THEN", "ELSE",
    "END", "GROUP", "BY", "ORDER", "HAVING", "LIMIT", "OFFSET", "INNER", "LEFT", "RIGHT", "OUTER",
    "CROSS", "UNION", "ALL", "DISTINCT", "COUNT", "SUM", "AVG", "MIN", "MAX", "CAST", "TRUE",
    "FALSE", "NULL", "IS", "NOT", "IN", "BETWEEN", "LIKE", "ILIKE", "SIMILAR", "TO", "TRIM",
    "UPPER", "LOWER", "SUBSTRING", "CONCAT", "COALESCE", "NULLIF", "INITCAP", "REGEXP_REPLACE",
)
# Words that can follow a table in FROM and would otherwise pass for an alias.
TABLE_FOLLOWERS = ("FULL", "USING", "NATURAL")
# Words that end a list of tables.
LIST_ENDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "ON", "USING", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION",
    "INTERSECT", "EXCEPT", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "LATERAL", "WINDOW", "SET",
)
# Words behind which an expression may end.
CLOSING_WORDS = ("END", "NULL", "TRUE", "FALSE")
QUALIFIED_SCORE, CALL_SCORE, BARE_SCORE, OTHER_SCORE, WILDCARD_SCORE = 0.9, 0.8, 0.6, 0.5, 0.4

NAME = "[a-zA-Z_][A-Za-z0-9_]*"
PART = "[a-zA-Z0-9_]+"
TARGET = rf"(?i){WORD_START}(?:into|update|table){WS}+({NAME}(?:{WS}*\.{WS}*{NAME}){{0,2}})"
_NO_ALIAS = rf"(?!(?:{'|'.join(KEYWORDS + TABLE_FOLLOWERS)}){WORD_END})"
# Marks for the start and the end of a list of tables; a run between them is one character class, which
# a pattern reads without recursion.
_OPEN, _CLOSE = "\u0002", "\u0003"
_LONE = r"(?<![A-Za-z0-9_.])(?:{})(?![A-Za-z0-9_.])"
STRING = "'[^']*'"


def _lists(flat: Column) -> Column:
    """Runs of text between FROM or JOIN and the next clause word, parenthesis or semicolon, cut at commas."""
    ended = F.regexp_replace(flat, rf"(?i)[();]|{_LONE.format('|'.join(w for w in LIST_ENDS if w not in ('FROM', 'JOIN')))}", _CLOSE)
    marked = F.regexp_replace(ended, rf"(?i){_LONE.format('FROM|JOIN')}(?={WS})", _OPEN)
    runs = F.regexp_extract_all(marked, F.lit(rf"{_OPEN}([^{_OPEN}{_CLOSE}]*+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda run: F.split(run, ",")))


def table_refs(c: Column | str) -> Column:
    """``schema.table`` names in the lists after FROM and JOIN and after INTO, UPDATE and TABLE, each once.

    Of three parts the last two count; a bare name does not.
    """
    bare = F.regexp_replace(F.regexp_replace(col(c), LINE_COMMENT, ""), BLOCK_COMMENT, " ")
    listed = F.transform(_lists(bare), lambda t: F.regexp_extract(t, rf"^{WS}*({NAME}(?:{WS}*\.{WS}*{NAME}){{0,2}})", 1))
    found = F.concat(listed, F.regexp_extract_all(bare, F.lit(TARGET), F.lit(1)))
    names = F.transform(found, lambda m: F.split(F.regexp_replace(m, WS, ""), r"\."))
    dotted = F.filter(names, lambda p: F.size(p) >= 2)
    return F.array_distinct(F.transform(dotted, lambda p: F.array_join(F.slice(p, -2, 2), ".")))


def strip_comments(c: Column | str) -> Column:
    """Comments become a blank; comment marks inside string literals stay."""
    kept = F.regexp_replace(col(c), rf"({STRING})|(?s:/\*.*?\*/)|--[^\r\n]*", "$1\u0001")
    return F.regexp_replace(F.regexp_replace(kept, "'\u0001", "'"), "\u0001", " ")


def sources(clean: Column) -> Column:
    """Tables of the five layers in FROM and JOIN, as structs of fqn, table and alias.

    `clean` has no comments; literals are ignored. Comma lists are read to the end.
    """
    flat = F.regexp_replace(F.regexp_replace(clean, STRING, "''"), WS + "+", " ")
    each = _lists(flat)

    def parts(text: Column) -> Column:
        text = strip(text)
        name = F.regexp_extract(text, rf"^({PART}(?:\.{PART}){{0,3}}+)(?![.A-Za-z0-9_])", 1)
        alias = F.regexp_extract(text, rf"(?i)^{PART}(?:\.{PART}){{0,3}}+{WS}+(?:AS{WS}+)?{_NO_ALIAS}({PART})", 1)
        return F.struct(
            F.split(name, r"\.").alias("path"), F.nullif(alias, F.lit("")).alias("alias")
        )

    named = F.transform(each, parts)
    layered = F.filter(named, lambda s: (F.size(s["path"]) == 2) & F.lower(s["path"][0]).isin(*LAYERS))
    return F.transform(
        layered,
        lambda s: F.struct(
            F.array_join(s["path"], ".").alias("fqn"),
            s["path"][0].alias("schema"),
            s["path"][1].alias("table"),
            s["alias"].alias("alias"),
        ),
    )


def alias_map(found: Column) -> Column:
    """Alias (or table name where there is none) to fqn; the first use of a name wins."""
    empty = F.create_map().cast("map<string,string>")

    def add(acc: Column, s: Column) -> Column:
        name = F.coalesce(s["alias"], s["table"])
        return F.when(F.map_contains_key(acc, name), acc).otherwise(F.map_concat(acc, F.create_map(name, s["fqn"])))

    return F.aggregate(found, empty, add)


_LAST_SELECT = re.compile(rf"{WORD_START}SELECT{WORD_END}", re.IGNORECASE)
_SIGN = re.compile(rf"'[^']*'|{WORD_START}FROM{WORD_END}|[(),']", re.IGNORECASE)


def split_select(text: str | None) -> list[str] | None:
    """Item texts between the last SELECT and its FROM; null without them or behind an open literal."""
    start = None
    for start in _LAST_SELECT.finditer(text or ""):
        pass
    if start is None:
        return None
    items, depth, begin = [], 0, start.end()
    for sign in _SIGN.finditer(text, begin):
        mark = sign[0]
        if mark in "()":
            depth += 1 if mark == "(" else -1
        elif mark == "'":
            return None
        elif mark == "," and depth == 0:
            items.append(text[begin : sign.start()])
            begin = sign.end()
        elif mark[0] in "fF" and depth == 0:
            last = text[begin : sign.start()]
            return [*items, last] if last.strip() else items
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_selects(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(split_select)


def select_clause(clean: Column) -> Column:
    """The select list of the last SELECT as an array of item texts; null without FROM.

    The last SELECT is the outer one of a text whose subqueries are CTEs.
    """
    return _split_selects(clean)


def is_keyword(c: Column) -> Column:
    return F.upper(c).isin(*KEYWORDS)


def select_items(clean: Column) -> Column:
    """Items of the select list: structs of position, expression, alias, confidence, is_wildcard."""
    # Each step binds what the next one uses several times.
    ending = rf"(?is){WS}+(?:AS{WS}+)?{PART}\z"
    texts = F.transform(
        select_clause(clean),
        lambda s, i: F.struct(i.cast("int").alias("position"), strip(s).alias("raw")),
    )
    cut = F.transform(
        F.filter(texts, lambda s: s["raw"] != ""),
        lambda s: F.struct(s["position"], s["raw"], F.regexp_extract(s["raw"], ending, 0).alias("end")),
    )

    def split(s: Column) -> Column:
        head = strip(F.substring(s["raw"], F.lit(1), F.length(s["raw"]) - F.length(s["end"])))
        return F.struct(
            s["position"],
            s["raw"],
            head.alias("head"),
            F.regexp_extract(s["end"], rf"({PART})\z", 1).alias("name"),
            s["end"].rlike(rf"(?i)^{WS}+AS{WS}").alias("marked"),
        )

    def named(s: Column) -> Column:
        last_word = F.upper(F.regexp_extract(s["head"], rf"({PART})\z", 1))
        closed = s["head"].rlike(r"""[A-Za-z0-9_)\]"'`]\z""") & (~is_keyword(last_word) | last_word.isin(*CLOSING_WORDS))
        free = closed & ~is_keyword(s["name"]) & ~s["name"].rlike("^[0-9]+$")
        return F.struct(
            s["position"],
            s["raw"],
            ((s["raw"] == "*") | s["raw"].endswith(".*")).alias("is_wildcard"),
            F.when((s["name"] != "") & (s["marked"] | free), s["head"]).otherwise(s["raw"]).alias("expression"),
            F.when((s["name"] != "") & (s["marked"] | free), s["name"]).alias("alias"),
        )

    def scored(s: Column) -> Column:
        e = s["expression"]
        own = F.element_at(F.split(e, r"\."), -1)
        own_ok = own.rlike(rf"^{PART}$") & ~is_keyword(own) & ~e.contains("(")
        unnamed = F.concat(F.lit("__unnamed_"), s["position"].cast("string"))
        score = (
            F.when(e.rlike(rf"^{PART}\.{PART}$"), QUALIFIED_SCORE)
            .when(e.rlike(rf"^{PART}$"), BARE_SCORE)
            .when(e.contains("("), CALL_SCORE)
            .otherwise(OTHER_SCORE)
        )
        return F.struct(
            s["position"],
            F.when(s["is_wildcard"], s["raw"]).otherwise(e).alias("expression"),
            F.when(s["is_wildcard"], "*").otherwise(F.coalesce(s["alias"], F.when(own_ok, own), unnamed)).alias("alias"),
            F.when(s["is_wildcard"], WILDCARD_SCORE).otherwise(score).alias("confidence"),
            s["is_wildcard"],
        )

    return F.transform(F.transform(F.transform(cut, split), named), scored)


def column_refs(expression: Column, aliases: Column, tables: Column) -> Column:
    """Columns an expression reads, as structs of table (fqn) and column, each once.

    `aliases` maps names to fqn; `tables` lists the distinct source tables. A bare name belongs
    to the only source table, if there is just one.
    """
    text = F.regexp_replace(expression, STRING, " ")
    found = F.regexp_extract_all(text, F.lit(rf"({PART}(?:\.{PART}){{0,2}}+)({WS}*\()?"), F.lit(0))
    names = F.filter(found, lambda t: ~t.endswith("("))
    paths = F.filter(
        F.transform(names, lambda t: F.split(t, r"\.")),
        lambda p: ~is_keyword(p[0]) & ~p[0].rlike("^[0-9]+$"),
    )
    none = F.lit(None).cast("string")
    layer = lambda p: p.isin(*LAYERS)

    def resolve(p: Column) -> Column:
        n = F.size(p)
        table = (
            F.when((n == 3) & layer(p[0]), F.concat_ws(".", p[0], F.get(p, 1)))
            .when((n == 2) & F.map_contains_key(aliases, p[0]), F.element_at(aliases, p[0]))
            .when((n == 2) & layer(p[0]), p[0])
            .when((n == 1) & (F.size(tables) == 1), F.get(tables, 0))
            .otherwise(none)
        )
        return F.struct(table.alias("table"), F.element_at(p, -1).alias("column"))

    return F.array_distinct(F.filter(F.transform(paths, resolve), lambda r: r["table"].isNotNull()))
