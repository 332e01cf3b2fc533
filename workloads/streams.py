"""Change streams over given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.session import scratch_path
from strata.streaming import index_stream, state_stream
from workloads.edits import FIELDS, INDEX, feed_text
from workloads.registry import derive, query, read, with_inputs
from workloads.scalars import NOW, now


@query(
    "stream_index_upsert",
    with_inputs(
        """SELECT key, title, score, seq FROM (
          SELECT key, op, title, score, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC NULLS LAST) AS rn FROM (
            SELECT key, 'upsert' AS op, title, score, CAST(NULL AS bigint) AS seq FROM idx
            UNION ALL SELECT key, op, title, score, seq FROM feed)) WHERE rn = 1 AND op <> 'delete'""",
        idx=INDEX,
        feed=feed_text("varchar"),
    ),
)
def stream_index_upsert(spark, sf):
    """The feed arrives in several files, so late older events come in later batches."""
    incoming, log, point = (scratch_path(spark, n) for n in ("feed", "change-log", "stream-point"))
    feed = derive(spark, sf, feed_text("string"))
    feed.repartition(4, F.col("seq") % 4).write.parquet(incoming)
    source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(incoming)
    index_stream.stream_changes(source, log, point).awaitTermination()
    base = derive(spark, sf, INDEX).withColumn("seq", F.lit(None).cast("bigint"))
    return index_stream.current_index(base, log, feed.schema, FIELDS)


@query(
    "stream_index_fold",
    with_inputs(
        """SELECT key, title, score, seq FROM (
          SELECT key, op, title, score, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC NULLS LAST) AS rn FROM (
            SELECT key, 'upsert' AS op, title, score, CAST(NULL AS bigint) AS seq FROM idx
            UNION ALL SELECT key, op, title, score, seq FROM feed)) WHERE rn = 1 AND op <> 'delete'""",
        idx=INDEX,
        feed=feed_text("varchar"),
    ),
)
def stream_index_fold(spark, sf):
    """The newest half of the feed comes first and is folded into the base; older events of deleted keys come after."""
    incoming, log, point, base_path = (scratch_path(spark, n) for n in ("feed", "change-log", "stream-point", "base"))
    feed = derive(spark, sf, feed_text("string"))
    base = derive(spark, sf, INDEX).withColumn("seq", F.lit(None).cast("bigint"))

    def follow(part):
        part.write.mode("append").parquet(incoming)
        source = spark.readStream.schema(feed.schema).parquet(incoming)
        index_stream.stream_changes(source, log, point).awaitTermination()

    middle = feed.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    follow(feed.where(F.col("seq") >= middle))
    folded = index_stream.fold_index(base, log, feed.schema, FIELDS, base_path, upto=0)
    follow(feed.where(F.col("seq") < middle))
    index_stream.drop_batches(spark, log, 0)
    return index_stream.current_index(folded, log, feed.schema, FIELDS, after=0)


@query(
    "stream_history_append",
    f"""SELECT event_id, ts, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM events)
    WHERE rn <= 20 OR ts > {NOW} - INTERVAL 7 DAY""",
)
def stream_history_append(spark, sf):
    incoming, log, point = (scratch_path(spark, n) for n in ("runs", "run-log", "stream-point"))
    runs = read(spark, sf, "events").select("event_id", "ts", "event_type")
    runs.repartition(3).write.parquet(incoming)
    source = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    index_stream.stream_history(source, log, point).awaitTermination()
    return index_stream.current_history(spark, log, runs.schema, "ts", "event_id", now())


def appended(spark, incoming, frame, run, cuts, column):
    """Append parts of a frame, cut at values of a column, and follow each with a run that goes on from the checkpoint."""
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = frame if lo is None else frame.where(F.col(column) >= F.lit(lo))
        part = part if hi is None else part.where(F.col(column) < F.lit(hi))
        part.write.mode("append").parquet(incoming)
        run(spark.readStream.schema(frame.schema).parquet(incoming)).awaitTermination()


@query(
    "stream_index_state",
    with_inputs(
        """SELECT key, title, score, seq FROM (
          SELECT key, op, title, score, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC NULLS LAST) AS rn FROM (
            SELECT key, 'upsert' AS op, title, score, CAST(NULL AS bigint) AS seq FROM idx
            UNION ALL SELECT key, op, title, score, seq FROM feed)) WHERE rn = 1 AND op <> 'delete'""",
        idx=INDEX,
        feed=feed_text("varchar"),
    ),
)
def stream_index_state(spark, sf):
    """The state is the index: a third of the keys' events by score first, so that older events come late, and a restart between the parts."""
    incoming, point = (scratch_path(spark, n) for n in ("feed", "stream-point"))
    feed = derive(spark, sf, feed_text("string"))
    base = derive(spark, sf, INDEX).withColumn("seq", F.lit(None).cast("bigint"))
    cuts = feed.agg(F.expr("percentile_approx(score, array(0.3, 0.6))")).first()[0]
    appended(spark, incoming, feed, lambda s: state_stream.follow_index(s, FIELDS, point, base), cuts, "score")
    return state_stream.index_state(spark, point, FIELDS)


@query(
    "stream_history_state",
    """SELECT event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn, max(ts) OVER () AS newest FROM events)
    WHERE rn <= 20 OR ts > newest - INTERVAL 7 DAY""",
)
def stream_history_state(spark, sf):
    """Runs in order of time, in three parts with a restart between them; the state prunes itself by timers."""
    incoming, point = (scratch_path(spark, n) for n in ("runs", "stream-point"))
    runs = read(spark, sf, "events").select("event_id", "ts", "event_type")
    cuts = runs.agg(F.expr("percentile_approx(ts, array(0.3, 0.7))")).first()[0]
    appended(spark, incoming, runs, lambda s: state_stream.follow_history(s, "event_type", "ts", "event_id", point), cuts, "ts")
    newest = F.lit(runs.agg(F.max("ts")).first()[0])
    return state_stream.kept_history(spark, point, "event_type", "ts", "event_id", newest).select("event_id", "ts", "event_type")
