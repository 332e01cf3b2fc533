"""Change streams: a keyed index that follows a feed, and a history that prunes itself.

Both keep their state in numbered folders of the shared storage. A batch writes only its own
folder, by batch id, so running a batch again after a failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.edits import apply_change_feed
from strata.operators.history import KEEP_DAYS, KEEP_ROWS, retain
from strata.session import delete_path, path_exists


def _batch_path(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id:012d}"


def read_log(spark: SparkSession, folder: str, schema, after: int = -1) -> DataFrame:
    """The batches written so far, those up to `after` left out."""
    return spark.read.schema(schema).parquet(folder).where(F.col("batch") > after).drop("batch")


def _start(feed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def stream_changes(feed: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch of a change feed to the change log below `folder`.

    The index is not rewritten per batch; `current_index` folds the log when it is read, and
    the order numbers in the events decide, so late older events change nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(folder, batch_id))

    return _start(feed, write, checkpoint, once)


def current_index(base: DataFrame, folder: str, feed_schema, fields: list[str], after: int = -1) -> DataFrame:
    """The index after the changes logged so far.

    To keep the fold short, `fold_index` stores a base now and then.
    """
    found = apply_change_feed(base, read_log(base.sparkSession, folder, feed_schema, after), fields)
    return found.select("key", *fields, "seq")


def fold_index(
    base: DataFrame, folder: str, feed_schema, fields: list[str], path: str, upto: int, after: int = -1
) -> DataFrame:
    """Store the index after the batches `after` + 1 to `upto` at `path` and give it as the next base.

    It keeps the order number of every entry and the deleted keys with theirs, so late older events
    lose and bring nothing back. Pass `upto` as the next `after`; the folders up to it are then no
    longer read and may go (`drop_batches`).
    """
    spark = base.sparkSession
    log = spark.read.schema(feed_schema).parquet(folder).where(F.col("batch").between(after + 1, upto)).drop("batch")
    done = apply_change_feed(base, log, fields, tombstones=True)
    done.write.parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def drop_batches(spark: SparkSession, folder: str, upto: int) -> None:
    """Remove the folders of batches up to `upto`, once a base that holds them is stored."""
    for batch in range(upto, -1, -1):
        path = _batch_path(folder, batch)
        if not path_exists(spark, path):
            break
        delete_path(spark, path)


def stream_history(runs: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch of runs to the history log below `folder`."""
    return stream_changes(runs, folder, checkpoint, once)


def current_history(
    spark: SparkSession,
    folder: str,
    schema,
    ts: str,
    tie: str,
    now: Column,
    keep: int = KEEP_ROWS,
    days: int = KEEP_DAYS,
) -> DataFrame:
    """The history under its retention rule.

    What an earlier pruning would have dropped stays dropped by a later one, so the rule gives the
    same rows when it is applied on reading, and a batch costs only its own rows. Store the
    result with `Workbench.replace_table` to shorten a long log.
    """
    return retain(read_log(spark, folder, schema), ts, tie, now, keep, days)
