"""Queries run as streams over the test tables (SS), compared with batch SQL."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from moraine.operators import cow
from moraine.plans.base import CW, Registry, sql
from moraine.session import scratch_path
from moraine.streaming import feeds

q = Registry()
QUERIES, ORACLE = q.QUERIES, q.ORACLE


def _stream(t, name):
    path = f"{t.base}/{name}.parquet"
    return feeds.files(t.spark, path, t.spark.read.parquet(path).schema, per_batch=16)


def _delivered(df, order, parts=4):
    """``df`` as a stream of as many batches as there are parts."""
    return feeds.files(df.sparkSession, feeds.deliveries(df, order, parts), df.schema, per_batch=1)


@q(sql(CW, "SELECT content_id, pack_blob_id FROM cw WHERE live"))
def ss01_feed_upsert(t):
    table = cow.BucketedTable(t.spark, scratch_path(t.spark, "stream"), "content_id", cow.CONTENT_ORDER)
    feeds.feed_into(table, _delivered(t.content_entries, "arrived_at"), scratch_path(t.spark, "progress"))
    return cow.alive_contents(table)


@q(sql(CW, "SELECT content_id, timestamp_seconds, live, pack_blob_id FROM cw"))
def ss02_running_winners(t):
    stream = feeds.running_winners(_delivered(t.content_entries, "arrived_at"))
    return feeds.upserted(t.spark, stream, ["content_id"], cow.CONTENT_ORDER, "winners")


@q("SELECT max(timestamp_seconds) watermark FROM content_entries")
def ss03_deletion_watermark(t):
    held: list = [None]

    def each(df, _):
        held[0] = feeds.raised_watermark(held[0], df)

    feeds.run_to_end(_stream(t, "content_entries"), each, scratch_path(t.spark, "progress"))
    return t.spark.createDataFrame([(held[0],)], "watermark bigint")


@q("SELECT count(*) n FROM content_entries")
def ss04_resumed(t):
    """A stream that fails in its second batch and is started again counts every row once."""
    stream, out, at = _delivered(t.content_entries, "arrived_at"), scratch_path(t.spark, "counts"), scratch_path(t.spark, "progress")
    with contextlib.suppress(StreamingQueryException):
        feeds.counted(stream, out, at, stop_at=1)
    feeds.counted(stream, out, at)
    return t.spark.read.schema("n bigint").option("recursiveFileLookup", "true").parquet(out).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@q("SELECT 's' || user_id session_id, max(epoch_us(ts) // 1000000) AS checkpoint FROM events GROUP BY 1 HAVING 1706572800 - max(epoch_us(ts) // 1000000) < 86400")
def ss05_active_sessions(t):
    rows = t.events.select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)").alias("checkpoint"))
    return feeds.active_sessions(rows, 1_706_572_800, 86_400)


@q("SELECT date_trunc('hour', ts)::TIMESTAMP begins, event_type, count(*) n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def ss06_tumbling(t):
    stream = feeds.tumbling(_delivered(t.events, "ts"), "ts", "1 hour", "60 days", ["event_type"])
    return feeds.upserted(t.spark, stream, ["begins", "event_type"], ["n"], "windows")


@q("SELECT count(*) n, sum(event_id)::BIGINT s FROM events")
def ss07_file_stream(t):
    total = []
    feeds.run_to_end(_stream(t, "events"), lambda df, _: total.append(df.agg(F.count(F.lit(1)), F.sum("event_id")).first()), scratch_path(t.spark, "progress"))
    return t.spark.createDataFrame([(sum(r[0] for r in total), sum(r[1] or 0 for r in total) if any(r[1] is not None for r in total) else None)], "n bigint, s bigint")


@q("SELECT content_id, timestamp_seconds FROM content_entries WHERE timestamp_seconds <= 1717200000 - 3600")
def ss09_settled(t):
    return feeds.settled(t.content_entries, "timestamp_seconds", 1_717_200_000, 3_600).select("content_id", "timestamp_seconds")
