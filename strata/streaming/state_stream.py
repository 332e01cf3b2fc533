"""Change streams whose state is the table: the newest event of every key by a streaming aggregation, and a history that prunes itself by timers.

The state lives in the state store (RocksDB) below the checkpoint and is read as a table from there, so nothing is folded on reading and nothing
of a batch is kept but what still counts. A restart goes on from the checkpoint. `index_stream` keeps logs instead; it also takes renames, which move
state from one key to another and cannot be settled key by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strata.operators.history import KEEP_DAYS, KEEP_ROWS, retain
from strata.session import StrataError, path_exists

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DAY = 86_400_000_000
#: Microseconds of a slice of time, whose young runs of a key are one state value.
_SLICE = _DAY // 4
#: Before the name of a further column of a run in the state.
_OTHER = "of_"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeptRuns(StatefulProcessor):
    """Keeps the runs of a key in one slice of time while they are younger than `days` days of event time, until a timer ends the youth of the oldest;
    without a slice, the newest `keep` runs of the key. A state value has an array per column."""

    def __init__(self, schema: T.StructType, keep: int, days: int):
        self.schema, self.keep, self.youth = schema, keep, days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.schema)

    def _held(self) -> dict[tuple, tuple]:
        held = self.kept.get()
        if held is None:
            return {}
        others = zip(*held[2:], strict=True) if len(held) > 2 else repeat(())
        return dict(zip(zip(held[0], held[1], strict=True), others))

    def _store(self, runs: dict[tuple, tuple]) -> None:
        if runs:
            self.kept.update(tuple(list(c) for c in zip(*((*k, *v) for k, v in runs.items()), strict=True)))
        else:
            self.kept.clear()

    def _prune(self, runs: dict[tuple, tuple], timerValues: Any) -> None:
        """Store what is young, and wake up when the oldest of it no longer is."""
        now = timerValues.getCurrentWatermarkInMs()
        young = {k: v for k, v in runs.items() if k[0] > now * 1000 - self.youth} if now > 0 else runs
        self._store(young)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if young:
            self.handle.registerTimer((min(k[0] for k in young) + self.youth) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        runs, n = self._held(), 0
        for row in rows:
            runs[row[3], row[4]] = tuple(row[5:])
            n += 1
        if key[1] is None:
            # Newest first; equal times by the tie.
            newest = sorted(runs, key=lambda k: (-k[0], k[1] is not None, k[1]))[: self.keep]
            self._store({k: runs[k] for k in newest})
        else:
            self._prune(runs, timerValues)
            yield Row(key=key[0], added=n)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        old = (key[1] + 1) * _SLICE <= timerValues.getCurrentWatermarkInMs() * 1000 - self.youth
        self._prune({} if old else self._held(), timerValues)
        yield Row(key=key[0], added=0)

    def close(self) -> None:
        pass


def _with_newest(runs: DataFrame, key: str, tie: str, keep: int) -> DataFrame:
    """All runs, and once more, marked as `_newest`, the newest `keep` of every key in an input partition: no others can be the newest of all."""

    def first(rows: pa.Table) -> pa.Table:
        order = [(key, "ascending"), ("_us", "descending"), (tie, "ascending")]
        rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start"))
        codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        rank = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
        return rows.filter(pa.array(rank < keep))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                newest = first(rows if newest is None else pa.concat_tables([newest, rows]))
                yield batch.append_column("_newest", pa.array(np.zeros(batch.num_rows, bool)))
        if newest is not None:
            yield from newest.append_column("_newest", pa.array(np.ones(newest.num_rows, bool))).to_batches()

    return runs.mapInArrow(work, T.StructType([*runs.schema.fields, T.StructField("_newest", T.BooleanType())]))


def _start(spark: SparkSession, out: DataFrame, checkpoint: str, once: bool) -> StreamingQuery:
    writer = out.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")
    # A query takes the store of the session that starts it; the session's own setting stays.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def follow_index(feed: DataFrame, fields: list[str], checkpoint: str, base: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Keep the newest event of each key of a feed (seq, op, key and `fields`; op is upsert or delete) as state.

    Late older events change nothing, also those of deleted keys. `base` (key, seq, `fields`) is the state that a new checkpoint begins
    with; entries that no event has touched have a null seq. It is stored beside the checkpoint and joins the feed as its first
    batch; a base entry wins over events up to its seq.
    """
    spark = feed.sparkSession
    stored = f"{checkpoint.rstrip('/')}-base"
    known = F.when(F.col("op").isin("upsert", "delete"), F.col("seq").isNotNull()).otherwise(F.raise_error(F.lit("the state takes upserts and deletes only")))
    seq, deleted = F.col("seq").cast("bigint").alias("seq"), F.col("op") == "delete"
    events = feed.where(known).select("key", seq, F.lit(False).alias("based"), deleted.alias("deleted"), *[F.when(~deleted, F.col(f)).alias(f) for f in fields])
    begun = path_exists(spark, f"{checkpoint}/offsets")
    if base is not None and not begun:
        types = {f.name: f.dataType for f in events.schema.fields}
        held = [F.col(c).cast(types[c]).alias(c) for c in ("key", "seq", *fields)]
        entries = base.select(*held[:2], F.lit(True).alias("based"), F.lit(False).alias("deleted"), *held[2:])
        entries.write.mode("overwrite").parquet(stored)
    if path_exists(spark, stored) and (begun or base is not None):
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema.fields])
        events = events.unionByName(spark.readStream.schema(schema).parquet(stored))
    newest = F.max_by(F.struct("seq", "deleted", *fields), F.struct("seq", "based"))
    return _start(spark, events.groupBy("key").agg(newest.alias("latest")), checkpoint, once)


def index_state(spark: SparkSession, checkpoint: str, fields: list[str]) -> DataFrame:
    """The index as the state has it: key, `fields`, seq of the keys that are not deleted."""
    state = spark.read.format("statestore").load(checkpoint)
    # The first part of the aggregate's state is its value, the second what it goes by.
    latest = state.select("key.key", F.col(f"value.{state.schema['value'].dataType.names[0]}").alias("latest")).where("NOT latest.deleted")
    return latest.select("key", *[F.col(f"latest.{f}").alias(f) for f in fields], F.col("latest.seq").alias("seq"))


def follow_history(
    runs: DataFrame, key: str, ts: str, tie: str, checkpoint: str, keep: int = KEEP_ROWS, days: int = KEEP_DAYS, delay: str | None = None, once: bool = True
) -> StreamingQuery:
    """Keep, per `key`, the newest `keep` runs and those younger than `days` days as state, pruned by event-time timers.

    Time is that of the newest run seen, less `delay` (by default `days` days); what arrives later than that is not taken. (ts, tie) tells
    the runs of a key apart.
    """
    if {key, ts, tie} - set(runs.columns):
        raise StrataError("the runs lack the key, the time or the tie")
    columns = [c for c in runs.columns if c not in (key, ts, tie)]
    # Watermarks go by a timestamp with zone; the runs' times are read as UTC, whatever the session's zone.
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', CAST(`{ts}` AS timestamp_ntz))")
    placed = runs.select(key, F.coalesce(micros, F.raise_error(F.lit("a run has no time"))).cast("bigint").alias("_us"), tie, *columns)
    types = {f.name: f.dataType for f in placed.schema.fields}
    schema = T.StructType([T.StructField(n, T.ArrayType(types[c])) for n, c in (("ts", "_us"), ("tie", tie), *((f"{_OTHER}{c}", c) for c in columns))])
    at, time_slice = F.timestamp_micros("_us"), F.when(~F.col("_newest"), F.expr(f"_us DIV {_SLICE}"))
    copied = _with_newest(placed, key, tie, keep).select(key, time_slice.alias("_slice"), at.alias("_at"), "_us", tie, *columns)
    timed = copied.withWatermark("_at", delay or f"{days} days")
    out_type = T.StructType([T.StructField("key", types[key]), T.StructField("added", T.LongType())])
    out = timed.groupBy(key, "_slice").transformWithState(KeptRuns(schema, keep, days), out_type, "Update", "EventTime")
    return _start(runs.sparkSession, out, checkpoint, once)


def history_state(spark: SparkSession, checkpoint: str, key: str, ts: str, tie: str) -> DataFrame:
    """The runs that the state holds; one that is young and among the newest is listed once."""
    state = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    names = state.schema["value"].dataType.names
    runs = state.select(F.col(f"key.{key}").alias(key), F.explode(F.arrays_zip(*[F.col(f"value.{n}").alias(n) for n in names])).alias("_r"))
    at = F.expr("timestampadd(MICROSECOND, _r.ts, timestamp_ntz'1970-01-01')")
    others = [F.col(f"_r.{n}").alias(n.removeprefix(_OTHER)) for n in names[2:]]
    return runs.select(key, at.alias(ts), F.col("_r.tie").alias(tie), *others).dropDuplicates([key, ts, tie])


def kept_history(
    spark: SparkSession, checkpoint: str, key: str, ts: str, tie: str, now: Column, keep: int = KEEP_ROWS, days: int = KEEP_DAYS
) -> DataFrame:
    """The history under its retention rule at `now`; the state holds it and what is not pruned yet."""
    return retain(history_state(spark, checkpoint, key, ts, tie), ts, tie, now, keep, days, by=[key])
