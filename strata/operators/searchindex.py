"""Search of a table of lines in a stored inverted index over the corpus of query texts.

Entries are numbered by recency and path, the order in which equal scores are listed; `CHUNK` neighbours form a chunk. For each run of one to three
characters (a gram, packed into a bigint) a chunk has a block: the entries with the gram, as gaps between their places, and for each the
highest score that a token with the gram could have there; the block's head has the best of them. Blocks are made chunk by chunk, so a
frequent gram is many blocks of many tasks.

A line's tokens are cut into grams. Heads alone give the chunks that could hold hits of all tokens, with a bound on their score. Of these the best
chunks with enough entries are opened first: blocks are intersected, and the entries left are scored exactly on their texts. The last row of the
list so far then rules out every chunk, and every entry, whose bound does not beat it; only the rest is opened. The result is that
of `corpus.corpus_search` for every line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators import corpus
from strata.operators.spread import number_rows, top_per_key
from strata.session import cut

CHUNK = 1024
#: Grams of lines that are sent to every task that reads heads (about 30 bytes each); with more, heads and grams are joined by a shuffle.
MOST_SENT = 200_000
#: Lines that one task intersects in one chunk.
PART_LINES = 20_000
_START, _TITLE = 100, 60
# Fields of an entry, lowest score first, and the highest score of a token found there.
_FIELDS = (("text", corpus.TEXT), ("path", corpus.PATH), ("name", corpus.FILE_NAME), ("body", corpus.NOTE), ("tags", corpus.TAG_EQUAL), ("title", _TITLE))


@dataclass(frozen=True)
class SearchIndex:
    """Entries (the index rows with `entry`, their number from 0) and blocks (gram, chunk, best, n, gaps, bounds), both stored."""

    entries: DataFrame
    blocks: DataFrame
    chunk: int


def grams_of(text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """The grams of a text in order of size and place, 21 bits a character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = []
    for size in sizes:
        n = len(codes) - size + 1
        if n > 0:
            gram = codes[:n]
            for i in range(1, size):
                gram = gram << 21 | codes[i : i + n]
            out.append(gram)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def token_grams(token: str) -> list[int]:
    """The grams that an entry with a token holds; the first is that of its beginning."""
    return list(dict.fromkeys(grams_of(token, (min(len(token), 3),)).tolist()))


def _entry_bounds(fields: dict[str, str | list[str] | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of an entry and the highest score of a token that holds each."""
    found, bounds = [], []
    for name, bound in _FIELDS:
        value = fields[name]
        for part in value if isinstance(value, list) else [value]:
            if part:
                some = grams_of(part)
                found.append(some)
                bounds.append(np.full(len(some), bound, np.uint8))
                if name == "title":
                    first = np.array([g for n in (1, 2, 3) if len(part) >= n for g in grams_of(part[:n], (n,))], np.int64)
                    found.append(first)
                    bounds.append(np.full(len(first), _START, np.uint8))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    gram, bound = np.concatenate(found), np.concatenate(bounds)
    order = np.lexsort((bound, gram))
    last = np.flatnonzero(np.append(gram[order][1:] != gram[order][:-1], True))
    return gram[order][last], bound[order][last]


def build_search_index(index: DataFrame, chunk: int = CHUNK) -> SearchIndex:
    """Number the entries and write their blocks; `index` has the columns of `corpus.corpus_index`."""
    order = [corpus.recency(index).desc_nulls_last(), F.col("path")]
    entries = cut(number_rows(index, order, "entry").withColumn("entry", F.col("entry") - 1), "entries")
    path = F.lower("path")
    fields = entries.select(
        F.expr(f"entry DIV {chunk}").alias("chunk"), "entry",
        F.lower(F.coalesce("search_text", F.lit(""))).alias("text"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"),
        F.lower(F.coalesce("md_body", F.lit(""))).alias("body"), F.transform("tags", lambda t: F.lower(t)).alias("tags"),
        F.lower(F.coalesce("md_title", "title", F.lit(""))).alias("title"),
    )

    def build(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        place, found, bounds = [], [], []
        names = [name for name, _ in _FIELDS]
        for entry, *values in zip(*(table.column(c).to_pylist() for c in ("entry", *names)), strict=True):
            gram, bound = _entry_bounds(dict(zip(names, values, strict=True)))
            place.append(np.full(len(gram), entry - number * chunk, np.int64))
            found.append(gram)
            bounds.append(bound)
        gram, at, bound = np.concatenate(found), np.concatenate(place), np.concatenate(bounds)
        order = np.lexsort((at, gram))
        gram, at, bound = gram[order], at[order], bound[order]
        edges = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]])) if len(gram) else np.zeros(1, np.int64)
        gaps = np.diff(at, prepend=0)
        gaps[edges[:-1]] = at[edges[:-1]]
        gaps = gaps.astype(np.uint16)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.table(
            {
                "gram": pa.array(gram[edges[:-1]], pa.int64()), "chunk": pa.array([number] * len(spans), pa.int64()),
                "best": pa.array([int(bound[a:b].max()) for a, b in spans], pa.int32()), "n": pa.array(np.diff(edges), pa.int32()),
                "gaps": pa.array([gaps[a:b].tobytes() for a, b in spans], pa.binary()), "bounds": pa.array([bound[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    schema = "gram bigint, chunk bigint, best int, n int, gaps binary, bounds binary"
    made = fields.groupBy("chunk").applyInArrow(build, schema)
    # Sorted by gram, so that a look-up reads the row groups of its grams only.
    return SearchIndex(entries, cut(made.sortWithinPartitions("gram", "chunk"), "blocks"), chunk)


def line_tokens(lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id_col` and tokens of each line, as `corpus.search_tokens` has them; lines without a token fall away."""
    pattern = F.lit(r'"[^"]+"|\S+')
    plain = F.transform(F.regexp_extract_all(F.col(text_col), pattern, F.lit(0)), lambda t: F.trim(F.lower(F.when(t.rlike('^"[^"]+"$'), F.expr("''")).otherwise(t))))
    quoted = F.transform(
        F.regexp_extract_all(F.col(text_col), pattern, F.lit(0)),
        lambda t: F.when(t.rlike('(?s)^"[^"]+"$'), F.trim(F.lower(F.substring(t, F.lit(2), F.length(t) - 2)))),
    )
    tokens = F.filter(F.zip_with(quoted, plain, lambda q, p: F.coalesce(q, p)), lambda t: t != "")
    return lines.select(id_col, tokens.alias("tokens")).where(F.size("tokens") > 0)


def _bound(first: Column, least: Column) -> Column:
    """The highest score of a token by that of its first gram and the least of its grams, where the start of a title counts as the title."""
    return F.when((first == _START) & (least == _TITLE), F.lit(_START)).otherwise(least)


def _grams(asked: DataFrame) -> DataFrame:
    """token, gram, place (0 for that of the token's beginning), of_token (its grams) of a table of tokens."""

    def work(batches):
        for batch in batches:
            out = [(t, g, i, len(found)) for t in batch.column(0).to_pylist() for found in [token_grams(t)] for i, g in enumerate(found)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["token", "gram", "place", "of_token"]
            )

    return asked.select("token").distinct().mapInArrow(work, "token string, gram bigint, place int, of_token int")


def candidate_chunks(index: SearchIndex, asked: DataFrame, grams: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """line, chunk, bound, most: the chunks whose heads allow a hit of all tokens, with bounds on score and number of hits.

    `asked`: line, place, token, of_line (the line's tokens).
    """
    few = grams.limit(most_sent + 1).count() <= most_sent
    heads = index.blocks.select("gram", "chunk", "best", "n").join(F.broadcast(grams) if few else grams, "gram")
    per_token = heads.groupBy("token", "chunk", "of_token").agg(
        F.count(F.lit(1)).alias("found"), F.max(F.when(F.col("place") == 0, F.col("best"))).alias("first"),
        F.min(F.least("best", F.lit(_TITLE))).alias("least"), F.min("n").alias("most"),
    ).where("found = of_token")
    per_token = per_token.select("token", "chunk", _bound(F.col("first"), F.col("least")).alias("bound"), "most")
    return asked.join(per_token, "token").groupBy("line", "chunk", "of_line").agg(
        F.count(F.lit(1)).alias("found"), F.sum("bound").alias("bound"), F.min("most").alias("most")
    ).where("found = of_line").select("line", "chunk", "bound", "most")


def opened(index: SearchIndex, chosen: DataFrame, asked: DataFrame, grams: DataFrame, parts: int) -> DataFrame:
    """line, entry, bound of the entries of the chosen (line, chunk) that hold all grams of all tokens of the line."""
    part = F.pmod(F.xxhash64("line"), F.lit(parts)).alias("part")
    wanted = chosen.join(asked, "line").join(grams, "token").select("chunk", part, "line", F.col("place_in_line").alias("at"), "gram", "place")
    blocks = index.blocks.join(wanted.select("gram", "chunk").distinct(), ["gram", "chunk"], "left_semi")
    held = blocks.select("gram", "chunk", "gaps", "bounds", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    chunk = index.chunk

    def work(key: tuple, asked_for: pa.Table, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        decoded = {
            gram: (np.cumsum(np.frombuffer(gaps, np.uint16).astype(np.int64)), np.frombuffer(bounds, np.uint8).astype(np.int64))
            for gram, gaps, bounds in zip(*(table.column(c).to_pylist() for c in ("gram", "gaps", "bounds")), strict=True)
        }
        lines: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for line, at, gram, place in zip(*(asked_for.column(c).to_pylist() for c in ("line", "at", "gram", "place")), strict=True):
            lines.setdefault(line, {}).setdefault(at, []).append((place, gram))
        out: list[tuple[np.ndarray, np.ndarray, int]] = []
        for line, tokens in lines.items():
            total = np.zeros(chunk, np.int64)
            hit = np.ones(chunk, bool)
            for found in tokens.values():
                least, first, seen = np.full(chunk, _TITLE, np.int64), np.zeros(chunk, np.int64), np.zeros(chunk, np.int64)
                for place, gram in found:
                    at, bound = decoded[gram]
                    seen[at] += 1
                    least[at] = np.minimum(least[at], bound)
                    if place == 0:
                        first[at] = bound
                hit &= seen == len(found)
                total += np.where((first == _START) & (least == _TITLE), _START, least)
            at = np.flatnonzero(hit)
            out.append((at + number * chunk, total[at], line))
        entry = np.concatenate([e for e, _, _ in out]) if out else np.empty(0, np.int64)
        bound = np.concatenate([b for _, b, _ in out]) if out else np.empty(0, np.int64)
        line = np.repeat(np.array([n for _, _, n in out], np.int64), [len(e) for e, _, _ in out])
        return pa.table({"line": pa.array(line, pa.int64()), "entry": pa.array(entry, pa.int64()), "bound": pa.array(bound, pa.int64())})

    keys = ["chunk", "part"]
    return wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(work, "line bigint, entry bigint, bound bigint")


def _scored(index: SearchIndex, found: DataFrame, tokens: DataFrame, scope: str) -> DataFrame:
    """line, entry, path, score of the found entries that hit every token."""
    joined = found.join(tokens, "line").join(index.entries, "entry")
    scored = joined.withColumn("_scores", F.transform("tokens", lambda t: corpus.token_score(t, scope))).where(F.array_min("_scores") > 0)
    return scored.select("line", "entry", "path", F.aggregate("_scores", F.lit(0), lambda a, b: a + b).alias("score"))


def search_lines(
    index: SearchIndex, lines: DataFrame, id_col: str = "line_id", text_col: str = "line", scope: str = "all", rows: int = corpus.SEARCH_ROWS,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """`id_col`, rank, path and score of the best `rows` entries of every line, as `corpus.corpus_search` lists them.

    Equal lists of tokens are searched once; lines that repeat an id keep their lists apart.
    """
    named = cut(line_tokens(lines, id_col, text_col), "lines")
    tokens = cut(number_rows(named.select("tokens").distinct(), [F.col("tokens")], "line"), "tokens")
    asked = tokens.select("line", F.size("tokens").alias("of_line"), F.posexplode("tokens").alias("place_in_line", "token"))
    grams = cut(_grams(asked), "grams")
    parts = max(1, -(-tokens.count() // PART_LINES))
    chunks = cut(candidate_chunks(index, asked, grams, most_sent), "chunks")
    # First the chunks of the highest bounds until they could hold a whole list.
    best = Window.partitionBy("line").orderBy(F.col("bound").desc(), "chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(chunks.withColumn("upto", F.coalesce(F.sum("most").over(best), F.lit(0))), "ordered")
    order = [F.col("score").desc(), F.col("entry")]

    def listed(chosen: DataFrame, limits: DataFrame | None) -> DataFrame:
        found = opened(index, chosen.select("line", "chunk"), asked, grams, parts)
        if limits is not None:
            found = found.join(limits, "line", "left").where(_beats(F.col("entry")))
        return cut(top_per_key(_scored(index, found, tokens, scope), ["line"], order, rows, "rank"), "hits")

    first = listed(placed.where(F.col("upto") < rows), None)
    # The last row of a full list; lists that are not full have no limit.
    limits = cut(first.where(F.col("rank") == rows).select("line", F.col("score").alias("least"), F.col("entry").alias("upto_entry")), "limits")
    rest = placed.where(F.col("upto") >= rows).join(limits, "line", "left").where(_beats(F.col("chunk") * index.chunk))
    second = listed(rest, limits)
    both = top_per_key(first.unionByName(second).drop("rank"), ["line"], order, rows, "rank")
    return named.join(tokens, "tokens").join(both, "line").select(id_col, "rank", "path", "score")


def _beats(entry: Column) -> Column:
    """Whether a bound and a first entry could come before the last row of a list."""
    return F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (entry < F.col("upto_entry")))
