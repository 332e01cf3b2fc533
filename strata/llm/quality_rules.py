"""Quality rules (9): adaptive fences from mergeable quantile sketches per language and source.

The sketch of a group is a histogram over a fixed log-linear grid of integers (`grid`): exact below
128 and within 1/64 above. It is a plain count per (group, rule, cell), so it merges by adding, has
at most some 1 500 cells per rule whatever the number of documents, and does not depend on the order of rows.

Defined results: a null text has no words; a document without words gets 0 for every rate and fails
the base rules; null languages and sources form groups of their own; repeated rows count each; an
empty table gives an empty result. Columns that the operator adds replace input columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strata.llm.common import WORD, cut, text_batches

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules: rate per document in thousandths, the least distance of a fence from its quartile, and
#: whether too small a rate is an outlier as well.
RULES: dict[str, tuple[str, int, bool]] = {
    "symbol_rate": ("IF(n_words = 0, 0, n_symbols * 1000 DIV n_words)", 100, False),
    "word_length": ("IF(n_words = 0, 0, word_chars * 1000 DIV n_words)", 1500, True),
    "dup_line_rate": ("IF(n_lines = 0, 0, n_dup_lines * 1000 DIV n_lines)", 500, False),
    "repeat_rate": ("IF(n_words = 0, 0, n_repeat_words * 1000 DIV n_words)", 350, False),
}
#: A fence lies this many interquartile ranges outside the quartiles.
REACH = 4
#: Groups of fewer documents use the merged sketch of their language.
LEAST_DOCS = 100


def repeated_words(words: list[str]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    _, pair = np.unique(seq[:-2] * len(ids) + seq[1:-1], return_inverse=True)
    _, window, found = np.unique(pair * len(ids) + seq[2:], return_inverse=True, return_counts=True)
    if len(found) == len(window):
        return 0
    again = found[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The counts of `MEASURES` for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _measure_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")


# Marked as not deterministic, so that no rule of the optimizer runs it once for a filter and once more for its columns.
_measures = F.pandas_udf(_measure_batches, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])).asNondeterministic()


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the measures, the rates of `RULES` and `base_failed`."""
    text_batches(docs.sparkSession)
    kept = docs.drop(*(c for c in MEASURES if c != text_col))
    out = kept.withColumn("__m", _measures(F.col(text_col))).select("*", "__m.*").drop("__m")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({name: F.expr(rate) for name, (rate, _, _) in RULES.items()} | {"base_failed": base})


def grid(value: Column) -> Column:
    """The lower end of a value's sketch cell: itself below 128, else its seven leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per (lang, source, rule, cell) with the documents in it, over documents that pass the base rules."""
    rates = F.array(*(F.struct(F.lit(name).alias("rule"), grid(F.col(name)).alias("cell")) for name in RULES))
    return (
        measured.where(~F.col("base_failed"))
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.inline(rates))
        .groupBy("lang", "source", "rule", "cell")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile (nearest rank) and size of each group of a sketch."""
    group = Window.partitionBy(*keys)
    run = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.select("*", F.sum("docs").over(run).alias("upto"), F.sum("docs").over(group).alias("n"))

    def rank(quarter: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("n") * quarter, F.col("cell")))

    return ranked.groupBy(*keys).agg(rank(1).alias("q1"), rank(3).alias("q3"), F.max("n").alias("n"))


def fences(cells: DataFrame) -> DataFrame:
    """One row per (lang, source) with the bounds `<rule>_low` and `<rule>_high` of each rule."""
    own = _quartiles(cells, ["lang", "source", "rule"])
    merged = cells.groupBy("lang", "rule", "cell").agg(F.sum("docs").alias("docs"))
    by_lang = _quartiles(merged, ["lang", "rule"]).select(
        F.col("lang").alias("__lang"), F.col("rule").alias("__rule"), F.col("q1").alias("l1"), F.col("q3").alias("l3")
    )
    both = own.join(by_lang, own.lang.eqNullSafe(by_lang["__lang"]) & (own.rule == by_lang["__rule"]))
    q1 = F.when(F.col("n") >= LEAST_DOCS, F.col("q1")).otherwise(F.col("l1"))
    q3 = F.when(F.col("n") >= LEAST_DOCS, F.col("q3")).otherwise(F.col("l3"))
    both = both.select("lang", "source", "rule", q1.alias("q1"), q3.alias("q3"))
    bounds = []
    for name, (_, slack, two_sided) in RULES.items():
        reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), F.lit(slack))
        mine = F.col("rule") == name
        low = (F.col("q1") - reach) if two_sided else F.lit(0)
        bounds += [
            F.max(F.when(mine, low)).alias(f"{name}_low"),
            F.max(F.when(mine, F.col("q3") + reach)).alias(f"{name}_high"),
        ]
    return both.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(*bounds)


def judge(measured: DataFrame, bounds: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`measured` with `kept`: the base rules hold and each rate lies inside its group's fences."""
    names = [f"{name}_{end}" for name in RULES for end in ("low", "high")]
    joined = measured.drop(*names).join(
        bounds, F.col(lang_col).eqNullSafe(F.col("__lang")) & F.col(source_col).eqNullSafe(F.col("__source")), "left"
    )
    inside = F.lit(True)
    for name in RULES:
        inside &= F.coalesce(F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("__lang", "__source")


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every document with measures, rates, fences and `kept`.

    Two passes over the texts: one for the sketches, one for the verdicts. The fences are stored in
    between: a row per group, so that Spark sees their size and joins them without moving the texts.
    """
    measured = measure(docs.drop("kept", "base_failed", *RULES), text_col)
    bounds = cut(fences(sketch(measured, lang_col, source_col)).coalesce(1), "fences")
    return judge(measured, bounds, lang_col, source_col)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that `apply_rules` keeps, with all their columns as they are, whatever their names."""
    judged = apply_rules(
        docs.select(F.struct("*").alias("document"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    )
    return judged.where("kept").select("document.*")
