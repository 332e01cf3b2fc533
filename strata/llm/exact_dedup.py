"""Exact dedup (3), DataFrame functions only: combining in three steps, each over the full content.

Equal texts meet in three steps: rows of one task combine before the shuffle (the map side of the
first aggregation), the winners of the tasks meet per salt, and the winners of the salts meet per
content. Every step groups by the SHA-256 *and the normalised text itself*, so nothing rests on the
digest. A group that holds a third of all rows reaches a salt with one row per task and the last
step with one row per salt.

Defined results: a null text counts as empty, all empty texts are one group; of equal texts the one
with the most code points stays, then the smallest id, an id before a null id, and of rows that
repeat id and text the first of the stored table. Empty tables give empty results. Input columns
are kept; added ones replace those of the same name.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BLANKS, cut, fresh, numbered, stored

SALTS = 32
_TOP = Decimal(2**63)
_SPAN = Decimal(2 * 10**19)
_WIDE = "decimal(38,0)"


def normalised(text: str) -> Column:
    """The text without ASCII blanks; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _priority(text: str, doc_id: str) -> Column:
    """One number that grows with the length and shrinks with the id: an aggregate of fixed width."""
    length = F.length(F.coalesce(F.col(text), F.lit(""))).cast(_WIDE)
    order = (F.lit(_TOP) - F.col(doc_id).cast("decimal(19,0)")).cast(_WIDE)
    return ((length * F.lit(_SPAN)).cast(_WIDE) + F.coalesce(order, F.lit(0).cast(_WIDE))).cast(_WIDE)


def _winner_id(priority: Column) -> Column:
    order = (priority % F.lit(_SPAN)).cast(_WIDE)
    return F.when(order > 0, (F.lit(_TOP) - order).cast("bigint"))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: `text_sha256`, `keep_id`, `__best` and `group_size`."""
    rows = docs.select(
        normalised(text_col).alias("norm"),
        _priority(text_col, id_col).alias("best"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),  # one per task, so that a task's copies meet before the shuffle
    ).withColumn("digest", F.sha2("norm", 256))
    salted = rows.groupBy("digest", "norm", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    # Different contents under one digest would be two rows here: refuse them instead of mixing them up.
    return whole.groupBy("digest").agg(
        F.max("best").alias("__best"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents")
    ).select(
        F.when(F.col("contents") > 1, F.raise_error(F.lit("different texts share a SHA-256")).cast("string"))
        .otherwise(F.col("digest")).alias("text_sha256"),
        _winner_id(F.col("__best")).alias("keep_id"), "__best", "group_size",
    )


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document, dropped ones too: the id, keep_id, group_size, kept, text_sha256 and `__row`.

    `__row` numbers the stored rows of `docs` (`common.numbered`; a frame that is no stored table is stored). The keys of the
    documents and the winners (no texts) are stored once, as both are read for the join and for ties between rows.
    """
    docs = stored(docs)
    row = fresh(docs, "__row")
    keys = cut(
        numbered(docs, row).select(
            F.col(id_col).alias("__id"),
            F.sha2(normalised(text_col), 256).alias("text_sha256"),
            _priority(text_col, id_col).alias("__mine"),
            F.col(row).alias("__row"),
        ),
        "digests",
    )
    judged = keys.join(cut(winners(docs, id_col, text_col, salts), "winners"), "text_sha256")
    first = (
        judged.where(F.col("__mine") == F.col("__best")).groupBy("text_sha256").agg(F.min("__row").alias("__first"))
    )
    return judged.join(first, "text_sha256").select(
        F.col("__id").alias(id_col), "keep_id", "group_size", (F.col("__row") == F.col("__first")).alias("kept"), "text_sha256", "__row"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """`docs` with one row of each group of equal texts and all its columns."""
    docs = stored(docs)
    row = fresh(docs, "__row")
    stays = find_copies(docs, id_col, text_col, salts).where("kept").select(F.col("__row").alias(row))
    return numbered(docs, row).join(stays, row, "left_semi").drop(row)
