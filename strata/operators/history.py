"""The run history: retention, buckets, and totals of statement results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.values import recency_bucket
from strata.operators.spread import top_per_key

KEEP_ROWS = 20
KEEP_DAYS = 7


def retain(
    df: DataFrame, ts: str, tie: str, now: Column, keep: int = KEEP_ROWS, days: int = KEEP_DAYS, by: list[str] | None = None
) -> DataFrame:
    """The newest `keep` entries (per `by`) and anything younger than `days` days.

    Young rows pass through a filter. For the older ones only the newest `keep` of each group
    matter; that rank limit is applied before the shuffle, so a large group does not travel.
    """
    since = now - F.expr(f"INTERVAL {days} DAYS")
    young = F.col(ts) > since
    order = [F.col(ts).desc(), F.col(tie)]
    if by:
        newest = top_per_key(df, by, order, keep).drop("_rn")
    else:
        newest = df.orderBy(*order).limit(keep)
    return df.where(young).unionByName(newest.where(~young | young.isNull()))


def bucket_counts(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """Entries per calendar bucket."""
    return df.groupBy(recency_bucket(ts, now).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def script_summary(status: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of script runs: statements by status, failed index, summed time.

    `status`: idx, status, elapsed_ms.
    """
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return status.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        count("success", "error").alias("executed"),
        count("success").alias("succeeded"),
        count("error").alias("failed"),
        count("skipped").alias("skipped"),
        F.min(F.when(F.col("status") == "error", F.col("idx"))).alias("failed_at"),
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("elapsed_ms"),
    )


def affected_rows_total(results: DataFrame, by: list[str]) -> DataFrame:
    """Affected rows over the statements of a batch, with a warning on several tabular results.

    `results`: affected_rows, is_tabular.
    """
    n = F.count_if("is_tabular")
    warning = F.concat(
        n.cast("string"), F.lit(" statements gave rows; the first of them is shown."),
    )
    return results.groupBy(*by).agg(
        F.sum(F.coalesce("affected_rows", F.lit(0))).alias("affected_rows"),
        n.alias("n_tabular"),
        F.when(n > 1, warning).alias("warning"),
    )
