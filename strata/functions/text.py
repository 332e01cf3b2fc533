r"""Rules over a column of texts: canonical SQL, names, notes and search helpers.

Every function takes columns (or column names) and returns a column of built-in expressions, so
the work stays in the JVM. Java's ``\b`` also counts letters outside ASCII; the rules here are
meant on ASCII words, hence the explicit look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, and patterns of the rules below.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
LINE_REST = r"[^\n\r\u2028\u2029]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = "--" + LINE_REST
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
RESULT_HEADS = "SELECT|WITH|VALUES|TABLE|SHOW|DESCRIBE|EXPLAIN"
DDL_HEADS = "CREATE|DROP|ALTER|TRUNCATE"
SUMMARY_CHARS = 200
SNIPPET_CONTEXT = 80
LABEL_CHARS = 50
EDGE_LABEL_CHARS = 20


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim white space of every kind on both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def flatten_spaces(c: Column | str) -> Column:
    """Each run of white space becomes one blank."""
    return F.regexp_replace(col(c), WS + "+", " ")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def canonical_sql(c: Column | str) -> Column:
    """Comments out, white space flattened, closing semicolons off, lower case.

    Plain text rules: a comment mark inside a string literal counts as a comment too.
    """
    bare = F.regexp_replace(F.regexp_replace(col(c), BLOCK_COMMENT, " "), LINE_COMMENT, " ")
    return F.lower(F.regexp_replace(strip(flatten_spaces(bare)), rf";+{WS}*\z", ""))


def sql_hash(c: Column | str) -> Column:
    """SHA-256 in hex of the canonical text."""
    return F.sha2(canonical_sql(c), 256)


def sanitize_identifier(c: Column | str) -> Column:
    """Anything but letters, digits and ``_`` becomes ``_`` (two for characters beyond the BMP)."""
    wide = F.regexp_replace(col(c), r"[\x{10000}-\x{10FFFF}]", "__")
    return F.regexp_replace(wide, "[^a-zA-Z0-9_]", "_")


def slugify(c: Column | str) -> Column:
    """Lower-case name for cached tables."""
    s = F.regexp_replace(F.lower(col(c)), WS + "+", "_")
    s = F.regexp_replace(s, r"[^A-Za-z0-9_\-]+", "_")
    s = F.regexp_replace(s, "--+", "_")
    return F.btrim(s, F.lit("-"))


def sanitize_filename(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r'[/\\?%*:|"<>]', "_")


def query_title(c: Column | str) -> Column:
    """Text of a leading ``--`` comment line, else null."""
    line = F.regexp_extract(col(c), rf"\A{WS}*--([^\n]*)", 1)
    return blank_to_null(strip(line))


def _fence_end(c: Column) -> Column:
    return F.locate("\n---", c, 4)


def _has_front_matter(c: Column) -> Column:
    return c.startswith("---") & (_fence_end(c) > 0)


def _unquote(c: Column) -> Column:
    quoted = (c.startswith('"') & c.endswith('"')) | (c.startswith("'") & c.endswith("'"))
    return F.when(quoted, F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def note_head(c: Column | str) -> Column:
    """The block between the ``---`` fences, or an empty text."""
    c = col(c)
    size = F.greatest(_fence_end(c) - 5, F.lit(0))
    return F.when(_has_front_matter(c), F.substring(c, F.lit(5), size)).otherwise(F.lit(""))


def note_body(c: Column | str) -> Column:
    """The text after the front matter, or the whole text when there is none."""
    c = col(c)
    return F.when(_has_front_matter(c), F.substring(c, _fence_end(c) + 4, F.length(c))).otherwise(c)


def head_string(head: Column, key: str) -> Column:
    """Value of ``key: value`` in a front-matter block; surrounding quotes are dropped."""
    found = F.regexp_extract(head, rf"(?m)^{key}:{WS}*([^\n\r\u2028\u2029]+)$", 1)
    return blank_to_null(_unquote(strip(found)))


def head_list(head: Column, key: str) -> Column:
    """Items of ``key: [a, b]`` or of a dash list below ``key:``; null when there are none."""
    inline_at = rf"(?m)^{key}:{WS}*\[([^\]]*)\]"
    inline = F.filter(
        F.transform(F.split(F.regexp_extract(head, inline_at, 1), ","), lambda s: _unquote(strip(s))),
        lambda s: s != "",
    )
    below = F.regexp_extract(head, rf"(?ms)^{key}:{WS}*?$(.*)\z", 1)
    lines = F.split(below, "\n")
    is_item = lambda s: s.rlike(rf"^{WS}+-{WS}+.")
    next_key = F.array_position(
        F.transform(lines, lambda s: ~is_item(s) & s.rlike(rf"^{WS}*\S+:")), F.lit(True)
    )
    block = F.when(next_key > 0, F.slice(lines, F.lit(1), (next_key - 1).cast("int"))).otherwise(lines)
    dashes = F.transform(
        F.filter(block, is_item), lambda s: _unquote(strip(F.regexp_replace(s, rf"^{WS}+-{WS}+", "")))
    )
    items = F.when(head.rlike(inline_at), inline).otherwise(dashes)
    return F.when(F.size(items) > 0, items)


def front_matter(c: Column | str) -> Column:
    """Struct of title, tags, connection id and name, and dialect of a note."""
    head = note_head(c)
    return F.struct(
        head_string(head, "title").alias("title"),
        head_list(head, "tags").alias("tags"),
        head_string(head, "connection_id").alias("connection_id"),
        head_string(head, "connection").alias("connection_name"),
        head_string(head, "dialect").alias("dialect"),
    )


def body_normalize(c: Column | str) -> Column:
    """Plain text of a note: heading and emphasis marks off, line ends unified."""
    s = F.regexp_replace(col(c), rf"(?m)^#+{WS}+", "")
    s = F.regexp_replace(s, "[*_~`]", "")
    s = F.regexp_replace(s, "\r\n", "\n")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def body_summary(c: Column | str) -> Column:
    """First line with content that is no ``---`` rule, cut at 200 characters."""
    def plain(line: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(line, rf"^#+{WS}+", ""), "[*_~`]", ""))

    lines = F.transform(F.split(col(c), "\r?\n"), plain)
    line = F.get(F.filter(lines, lambda s: (s != "") & ~s.startswith("---")), 0)
    return F.when(
        F.length(line) > SUMMARY_CHARS, F.concat(F.substring(line, 1, SUMMARY_CHARS), F.lit("..."))
    ).otherwise(line)


def search_text(*fields: Column | str) -> Column:
    """Lower-cased concatenation of the given fields; absent and empty ones are left out."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(f) for f in fields]))


def snippet(text: Column | str, token: Column | str, context: int = SNIPPET_CONTEXT) -> Column:
    """The surroundings of the first hit of `token`, null without a hit."""
    text, token = col(text), col(token)
    hit = F.instr(F.lower(text), F.lower(token))
    start = F.greatest(hit - context, F.lit(1))
    stop = F.least(hit + F.length(token) + (context - 1), F.length(text))
    piece = strip(F.substring(text, start, stop - start + 1))
    piece = F.when(start > 1, F.concat(F.lit("..."), piece)).otherwise(piece)
    piece = F.when(stop < F.length(text), F.concat(piece, F.lit("..."))).otherwise(piece)
    return F.when(hit > 0, flatten_spaces(piece))


def truncate_label(c: Column | str, size: int = LABEL_CHARS) -> Column:
    """One-line label of a query, cut at `size` characters."""
    flat = strip(flatten_spaces(c))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def edge_label(c: Column | str, size: int = EDGE_LABEL_CHARS) -> Column:
    """Short label of a lineage edge: longer than `size` keeps `size` - 1 characters."""
    c = col(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 1), F.lit("..."))).otherwise(c)


def is_result_statement(c: Column | str) -> Column:
    return F.upper(strip(c)).rlike(rf"^({RESULT_HEADS}){WORD_END}")


def is_ddl_statement(c: Column | str) -> Column:
    return col(c).rlike(rf"(?i){WORD_START}({DDL_HEADS}){WS}+")


def existing_limit(c: Column | str) -> Column:
    """n of a closing ``LIMIT n [OFFSET m]``, else null."""
    found = F.regexp_extract(col(c), rf"(?i)LIMIT{WS}+([0-9]+)(?:{WS}+OFFSET{WS}+[0-9]+)?{WS}*;?{WS}*\z", 1)
    return found.try_cast("bigint")


def history_schema(c: Column | str, default: Column | str = "main") -> Column:
    """Schema of the first qualified table after FROM or JOIN."""
    default = F.lit(default) if isinstance(default, str) else default
    found = F.regexp_extract(col(c), rf"(?i)(?:FROM|JOIN){WS}+([a-zA-Z_][a-zA-Z0-9_]*)\.", 1)
    return F.coalesce(blank_to_null(found), default)


def search_tokens(c: Column | str) -> Column:
    """Quoted phrases and words of a search line, lower-cased."""
    raw = F.regexp_extract_all(col(c), F.lit(r'"([^"]+)"|(\S+)'), F.lit(0))
    plain = F.transform(
        raw,
        lambda t: strip(F.lower(F.when(t.rlike('^"[^"]+"$'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))),
    )
    return F.filter(plain, lambda t: t != "")
