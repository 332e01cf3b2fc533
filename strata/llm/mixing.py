"""Mixing sources to target weights (1): whole copies first, then Pareto order sampling.

A source's target divided by its size gives the expected copies of each of its documents. The whole
part is taken for certain; the rest is an inclusion probability p < 1, drawn by Pareto order
sampling (Rosen 1997): documents are ranked by u/(1-u) divided by p/(1-p), u being a hash of seed
and id, and the lowest ranks are taken until the words that are left are reached. The size of the
sample is fixed in words: the document at the cut is taken if that brings the words nearer to it.
With `weight_col`, expected copies within a source grow with the weight.

The cut is found without sorting a source in one task: ranks fall into `BINS` cells by a monotone
function of the rank, the cells' word sums give the cell of the cut, and only that cell is ordered.

Defined results: a null text has size 0; null sources form one source, last in order; a null or
non-positive weight counts as never taken; equal ranks are ordered by id, then by size, and rows
that repeat an id share its u. Input columns are kept by `take`; names with two leading underscores are its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import WORD_PATTERN, cut, fresh, numbered, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"
BINS = 1 << 14


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)).cast("bigint"), F.lit(0).cast("bigint"))


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on seed and id alone: 52 bits of their MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, share: float = SHARE, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source with `source_size` and `target`.

    `sized` has `source` and `size`. Sources stand in code-point order, null last, and get the weights in turn.
    Sharing a total by weight under upper bounds and resharing the excess ends at one level l with
    target = min(bound, l x weight). Sources in order of bound / weight reach their bounds one by one, so l
    follows from the first source that stays below. The windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    named = totals.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).cast("double").alias("bound"))
    order = everything.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = named.withColumn("level", left / F.sum("w").over(after))
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), "level"))).over(everything)
    return level.withColumn("free", free["level"]).select(
        F.col("source").alias("__source"),
        "source_size",
        F.coalesce(F.least(F.col("bound"), F.col("free") * F.col("w")), F.col("bound")).alias("target"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weight_col: str | None = None, seed: str = SEED, share: float = SHARE, bins: int = BINS,
) -> DataFrame:
    """One row per document: the id, `source`, `size`, `source_size`, `target`, `copies` (0 to 2) and `__row`, its number (`common.numbered`)."""
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    docs = stored(docs)
    row = fresh(docs, "__row")
    sized = cut(
        numbered(docs, row).select(
            F.col(id_col).alias("__id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
            weight.alias("weight"), uniform(id_col, seed).alias("u"), F.col(row).alias("__row"),
        ),
        "sizes",
    )
    targets = cut(source_targets(sized, share).coalesce(1), "targets")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if weight_col is not None:
        # Words per unit of weight, bounded by MOST_COPIES a document; what the bound cuts off is not reshared.
        per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("weight")).alias("mass")).select(F.col("source").alias("__s"), "mass")
        rows = rows.join(per, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        expected = F.when(F.col("mass") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") * F.col("weight") / F.col("mass"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("e", expected).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, odds))
    # rank / (1 + rank) grows with the rank and lies in (0, 1).
    rows = rows.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int"))
    sums = rows.groupBy("source", "bin").agg(
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.max("target").alias("goal"), F.sum(F.col("p") * F.col("size")).alias("share"),
    )
    by_source = Window.partitionBy("source")
    cells = sums.select(
        F.col("source").alias("__source"), F.col("bin").alias("__bin"), "words",
        F.sum("share").over(by_source).alias("expected"),
        (F.col("goal") - F.sum("certain").over(by_source)).alias("exact"),
        F.coalesce(F.sum("words").over(by_source.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    ).where(F.col("__bin").isNotNull())
    need = F.col("exact") if weight_col is None else F.col("expected")
    cells = cells.select("__source", "__bin", "words", "before", need.alias("need"))
    placed = rows.join(cells, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bin") == F.col("__bin")), "left")
    inside = Window.partitionBy("source", "bin").orderBy("rank", F.col("__id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (F.col("before") < F.col("need")) & (F.col("before") + F.col("words") > F.col("need"))
    edge = placed.where(crossing).withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("drawn", (F.col("upto") + F.col("size") / 2 <= F.col("need")).cast("int"))
    clear = placed.where(~F.coalesce(crossing, F.lit(False))).withColumn(
        "drawn", F.coalesce((F.col("before") + F.col("words") <= F.col("need")).cast("int"), F.lit(0))
    )
    out = [F.col("__id").alias(id_col), "source", "size", "source_size", "target", (F.col("whole") + F.col("drawn")).cast("int").alias("copies"), "__row"]
    return clear.select(*out).unionByName(edge.select(*out))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: `docs` with all its columns, each row as often as the mix takes it."""
    docs = stored(docs)
    row, times = fresh(docs, "__row"), fresh(docs, "__copies")
    copies = mix(docs, id_col, text_col, source_col, **options).where("copies > 0").select(F.col("__row").alias(row), F.col("copies").alias(times))
    rows = numbered(docs, row).join(copies, row)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
