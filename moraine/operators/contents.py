"""The content index: merge, compaction, listing, statistics, verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import running_within
from moraine.operators.state import winners

PAYLOAD = ["original_length", "packed_length", "pack_offset", "compression_id", "index_blob_id"]


def usable(entries: DataFrame) -> DataFrame:
    """Rows with id and time, with ``live`` (a null ``deleted`` is not deleted)."""
    return entries.filter(F.col("content_id").isNotNull() & F.col("timestamp_seconds").isNotNull()).withColumn("live", ~F.coalesce("deleted", F.lit(False)))


def merged(entries: DataFrame) -> DataFrame:
    """One winning row per content id: newest, then live, then greatest pack id (IX01, IX02)."""
    order = [F.col("timestamp_seconds"), F.col("live"), F.col("pack_blob_id")]
    return winners(usable(entries), ["content_id"], order, ["timestamp_seconds", "live", "pack_blob_id", *PAYLOAD])


def point_lookup(entries: DataFrame, content_id: str) -> DataFrame:
    """Winner of one id; the equality reaches the scan before the merge (IX03)."""
    return merged(entries.filter(F.col("content_id") == content_id))


def id_range(df: DataFrame, start: str, end: str, column: str = "content_id") -> DataFrame:
    """Ids in ``[start, end)`` by plain string order (FI03)."""
    return df.filter((F.col(column) >= start) & (F.col(column) < end))


#: Ranges of ids without a prefix, and with one of the prefix letters g to z.
UNPREFIXED, PREFIXED = ("0", "g"), ("g", "{")


def above_watermark(df: DataFrame, seconds: int) -> DataFrame:
    """Hide tombstones that aren't newer than the deletion watermark (FI05)."""
    return df.filter(F.col("live") | (F.col("timestamp_seconds") > seconds))


def overlaid(committed: DataFrame, pending: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Committed and pending winners as listed while writes are pending (FI04): the pending row of
    an id decides whether its committed row is visible, and both copies may come out."""
    flag = pending.select(F.col("content_id").alias("_id"), F.col("live").alias("_live"))
    seen = committed.join(flag, committed["content_id"] == flag["_id"], "left").withColumn("_v", F.coalesce("_live", "live")).withColumn("origin", F.lit("committed"))
    rows = pending.withColumn("_v", F.col("live")).withColumn("origin", F.lit("pending"))
    out = seen.drop("_id", "_live").unionByName(rows)
    return (out if include_deleted else out.filter("_v")).drop("_v")


def compacted(entries: DataFrame, drop_ids: DataFrame | None = None, drop_before: int | None = None) -> DataFrame:
    """Compaction (IX08): merge first, then drop listed ids and tombstones older than a time."""
    out = merged(entries)
    if drop_ids is not None:
        out = out.join(drop_ids.select("content_id").distinct(), "content_id", "left_anti")
    return out if drop_before is None else out.filter(F.col("live") | (F.col("timestamp_seconds") >= drop_before))


def sharded(df: DataFrame, shards: int, column: str = "content_id") -> DataFrame:
    """Stable shard of each id (IX06, SF16)."""
    return df.withColumn("shard", F.pmod(F.xxhash64(column), F.lit(shards)).cast("int"))


def combined_indexes(entries: DataFrame, least: int = 100, name: str = "combined") -> DataFrame:
    """Rows of the index blobs after those below ``least`` ids are merged into one, named ``name``
    (IX05), with the winner of each id; large ones stay. A single small one stays as well."""
    rows = usable(entries).filter("index_blob_id is not null")
    small = rows.select("index_blob_id", "content_id").distinct().groupBy("index_blob_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < least).select("index_blob_id", F.lit(True).alias("_small"))
    if small.limit(2).count() < 2:
        small = small.filter("false")
    put = rows.join(small, "index_blob_id", "left").withColumn("in_index", F.when(F.col("_small"), F.lit(name)).otherwise(F.col("index_blob_id")))
    order = [F.col("timestamp_seconds"), F.col("live"), F.col("pack_blob_id")]
    return winners(put, ["in_index", "content_id"], order, ["timestamp_seconds", "live", "pack_blob_id", *PAYLOAD])


def write_time(previous: Column, now: Column) -> Column:
    """Time of a rewritten content: now, but later than its previous time (IX11)."""
    return F.greatest(now, F.coalesce(previous + 1, now))


def deduplicated_writes(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that have to be written: ids that aren't alive in ``index`` (IX11). A
    deleted id is written again with a later time."""
    old = index.select("content_id", F.col("timestamp_seconds").alias("_t"), F.col("live").alias("_l"))
    rows = batch.dropDuplicates(["content_id"]).join(old, "content_id", "left").filter(~F.coalesce("_l", F.lit(False)))
    return rows.withColumn("timestamp_seconds", write_time(F.col("_t"), F.col("timestamp_seconds"))).drop("_t", "_l")


def tombstones(index: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Delete rows for live ids (IX12)."""
    rows = index.filter("live").join(ids.select("content_id").distinct(), "content_id", "left_semi")
    return rows.withColumns({"timestamp_seconds": write_time(F.col("timestamp_seconds"), F.lit(now)), "live": F.lit(False)})


def pack_usage(index: DataFrame) -> DataFrame:
    """Contents and packed bytes per pack (AG03)."""
    return index.groupBy("pack_blob_id").agg(F.count(F.lit(1)).alias("n_contents"), F.sum("packed_length").alias("packed_bytes"), F.max(F.col("pack_offset") + F.col("packed_length")).alias("extent"))


def content_stats(index: DataFrame) -> DataFrame:
    """Totals by compression with integer averages (AG04)."""
    return index.groupBy("compression_id").agg(F.count(F.lit(1)).alias("n"), F.sum("original_length").alias("original_bytes"), F.sum("packed_length").alias("packed_bytes"), F.expr("sum(packed_length) div count(1)").alias("average"))


#: Size classes of the histograms: below 10, 100, ..., 10^8; what is larger has none.
CLASSES = 8


def size_histogram(df: DataFrame, column: str) -> DataFrame:
    """Count and bytes per power of ten (AG04, AG05): class k holds sizes below 10^k and not below
    10^(k-1). Sizes of 10^8 and more and nulls are in no class."""
    k = F.coalesce(*[F.when(F.col(column) < 10**i, F.lit(i)) for i in range(1, CLASSES + 1)])
    return df.select(k.alias("size_class"), F.col(column).alias("_s")).filter("size_class is not null").groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("bytes"))


def verify(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """State of every live content against the blob list (JN05): ``missing`` pack, ``truncated``
    (offset plus length, as unsigned 32-bit, beyond the blob) or ``ok``. A blob without a known
    length cannot be called truncated."""
    held = blobs.select(F.col("blob_id").alias("pack_blob_id"), "blob_length", F.lit(True).alias("_there"))
    end = F.pmod(F.col("pack_offset") + F.col("packed_length"), F.lit(1 << 32))
    state = F.when(F.col("_there").isNull(), "missing").when(end > F.col("blob_length"), "truncated").otherwise("ok")
    return index.filter("live").join(held, "pack_blob_id", "left").withColumn("state", state).drop("_there", "blob_length")


def short_packs(index: DataFrame, max_pack: int, percent: int = 60) -> DataFrame:
    """Packs below a share of the pack size whose one-letter prefix has two or more of them (WN16)."""
    packs = index.filter("pack_blob_id is not null").groupBy("pack_blob_id").agg(F.count(F.lit(1)).alias("n_contents"), F.sum("packed_length").alias("packed_bytes"))
    short = packs.filter(F.col("packed_bytes") < max_pack * percent // 100).withColumn("prefix", F.substring("pack_blob_id", 1, 1))
    many = short.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("prefix")
    return short.join(many, "prefix", "left_semi")


def rewrite_candidates(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of contents to rewrite from several rules (SE04): an id may come more than once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefetch_packs(wanted: DataFrame, least_contents: int = 2, least_bytes: int = 5_000_000) -> DataFrame:
    """Packs worth reading whole for a list of contents (IX19)."""
    return wanted.groupBy("pack_blob_id").agg(F.count(F.lit(1)).alias("n_contents"), F.sum("packed_length").alias("packed_bytes")).filter((F.col("n_contents") >= least_contents) & (F.col("packed_bytes") >= least_bytes))


def recovered(entries: DataFrame) -> DataFrame:
    """Index rows as a pack's own record has them (SC15): live rows by pack and offset, once."""
    cols = ["pack_blob_id", "content_id", "pack_offset", "packed_length", "original_length"]
    return usable(entries).filter(F.col("live") & F.col("pack_blob_id").isNotNull()).select(*cols).distinct()


def dedup_counters(entries: DataFrame) -> DataFrame:
    """Writes, distinct contents and bytes saved by deduplication and compression (AG25)."""
    rows = usable(entries).filter("live")
    per = rows.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"), F.max("original_length").alias("o"), F.max("packed_length").alias("p"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("writes"), F.count(F.lit(1)).alias("distinct_contents"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduplicated"), F.sum((F.col("n") - 1) * F.col("o")).alias("deduplicated_bytes"), F.sum(F.greatest(F.col("o") - F.col("p"), F.lit(0))).alias("compression_saved"))


def pack_kind(content_id: Column) -> Column:
    """Pack kind of a content (IX13): ``q`` (metadata) if its id has a prefix letter, else ``p``."""
    return F.when(F.substring(content_id, 1, 1).between("g", "z"), "q").otherwise("p")


def packed_bins(df: DataFrame, size: str, order: Sequence[str], capacity: int, group: Sequence[str]) -> DataFrame:
    """Approximate packing in arrival order (IX13): a row belongs to the bin in which the bytes
    before it in its group fall. Large groups are run in slices."""
    run = running_within(df, group, order, sums={"_before": size}, before=True)
    return run.withColumn("bin", F.floor(F.col("_before") / F.lit(capacity)).cast("bigint")).drop("_before")
