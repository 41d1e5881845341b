"""Streams: index feeds into a table, running winners, tumbling windows, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moraine.operators import cow
from moraine.session import scratch_path


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream (SS07), in batches of so many files; a single file is a
    stream of one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a pattern that only this file matches
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def deliveries(df: DataFrame, order: str, parts: int) -> str:
    """A folder with ``df`` cut into about ``parts`` files by ``order``, as if delivered one after
    the other."""
    path = scratch_path(df.sparkSession, "deliveries")
    df.repartitionByRange(parts, order).write.parquet(path)
    return path


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run what is there now through ``each`` and stop. Progress lies in ``checkpoint`` (SS04): a
    second call goes on where the first ended."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def feed_into(table: cow.BucketedTable, stream: DataFrame, checkpoint: str, name: str = "feed") -> None:
    """Apply a change feed batch by batch (SS01). A batch that is delivered again after a failure
    is recognised by its number. The order of arrival doesn't matter: rows carry the whole
    winner key."""
    run_to_end(stream, lambda df, no: table.apply(cow.content_feed(df), (name, no)) and None, checkpoint)


def running_winners(stream: DataFrame) -> DataFrame:
    """Winner of each content id as streaming state (SS02)."""
    rows = cow.content_feed(stream)
    best = rows.groupBy("content_id").agg(F.max(F.struct("timestamp_seconds", "live", "pack_blob_id")).alias("w"))
    return best.select("content_id", "w.timestamp_seconds", "w.live", "w.pack_blob_id")


def raised_watermark(previous: int | None, batch: DataFrame) -> int | None:
    """Deletion watermark after a batch (SS03): the newest time seen, never lower than before."""
    seen = batch.agg(F.max("timestamp_seconds")).first()[0]
    return seen if previous is None else previous if seen is None else max(previous, seen)


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per window and key (SS06); rows later than ``late`` behind the newest are left out
    once their window is closed."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), *keys, "n")


def active_sessions(checkpoints: DataFrame, now: int, expiry: int) -> DataFrame:
    """Sessions whose last checkpoint is younger than ``expiry`` seconds (SS05)."""
    return checkpoints.groupBy("session_id").agg(F.max("checkpoint").alias("checkpoint")).filter(F.lit(now) - F.col("checkpoint") < expiry)


def settled(df: DataFrame, column: str, now: int, delay: int) -> DataFrame:
    """Rows old enough to be seen by every reader (SS09)."""
    return df.filter(F.col(column) <= now - delay)


def upserted(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Last result of an aggregating stream run to its end. Each batch gives only the groups it
    changed, which replace their rows in a bucketed table; of two rows of a group the one with the
    greater ``order`` is the later one. A group with a null key is kept."""
    table = cow.BucketedTable(spark, scratch_path(spark, name), "_key", order, [*keys, *[c for c in stream.columns if c not in (*keys, *order)]])
    key = F.to_json(F.struct(*keys))
    run_to_end(stream, lambda df, no: table.apply(df.withColumn("_key", key), (name, no)) and None, scratch_path(spark, name + "-progress"), "update")
    if not table.versions():
        return spark.createDataFrame([], stream.schema)
    return table.read().select(*stream.columns)


def counted(stream: DataFrame, folder: str, checkpoint: str, stop_at: int | None = None) -> None:
    """Rows of each batch, written under the batch's number, so that one run again after a failure
    replaces what it left (SS04). ``stop_at`` ends the stream by an error before that batch is
    done, for tests of a restart."""

    def each(df: DataFrame, no: int) -> None:
        df.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={no}")
        if no == stop_at:
            raise RuntimeError("stopped")

    run_to_end(stream, each, checkpoint)
