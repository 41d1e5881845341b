"""Index blobs and packs as binary columns: written, parsed, recovered, in bounded shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions import indexformat as X

ENTRY = "content_id string, timestamp_seconds bigint, deleted boolean, pack_blob_id string, pack_offset bigint, original_length bigint, packed_length bigint, compression_id int, format_version int, encryption_key_id int"
_ARROW = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
#: Entries of one index blob; more are sharded by a hash of the id.
MOST_ENTRIES = 500_000


def sized_shards(entries: DataFrame, most: int, key: str = "content_id") -> DataFrame:
    """Entries with a ``shard`` (IX06): as many as keep about ``most`` entries in each, by the first
    32 bits of the id's MD5, so that equal ids share a shard whatever the entries' order."""
    shards = max(1, -(-entries.count() // most))
    return entries.withColumn("shard", F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int"))


def written(entries: DataFrame, blob: str = "index_blob_id", version: int = 2, most: int = MOST_ENTRIES) -> DataFrame:
    """``blob, part, data``: each index blob's entries in binary form (SC14). Blobs of more than
    ``most`` entries come in several parts by hash of the id, and ids with keys of different length
    in parts of their own, so a task holds ``most`` entries. Ids must be hex digits after at most
    one letter; a null number is 0, a null pack has an empty name."""
    sizes = entries.groupBy(blob).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    rows = entries.join(sizes, blob).withColumn("part", F.concat_ws("-", F.length("content_id"), F.pmod(F.xxhash64("content_id"), F.col("_n"))))

    encode = lambda key, cols: (*key, X.encoded(cols, version))
    return _by_part(rows.select(blob, "part", *X.COLUMNS), [blob, "part"], encode)


def _by_part(rows: DataFrame, keys: list[str], encode: Callable[[tuple, dict[str, list]], tuple]) -> DataFrame:
    """``keys, data`` of each group of ``keys``: the groups come one after the other in sorted
    partitions, so that many small ones cost little. Each is held whole while it is encoded."""
    rest = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        now: tuple | None = None
        done: list[tuple] = []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            groups = list(zip(*cols[: len(keys)], strict=True))
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if groups[lo] != now:
                    if now is not None:
                        done.append(encode(now, held))
                    now, held = groups[lo], {c: [] for c in rest}
                for name, c in zip(rest, cols[len(keys) :], strict=True):
                    held[name] += c[lo:hi]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[*keys, "data"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(encode(now, held), kinds, strict=True)], names=[*keys, "data"])

    kinds = [*[pa.string() for _ in keys], pa.binary()]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", data binary")


def _entries_of(df: DataFrame, name: str, data: str, read: Callable[[bytes], dict | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = read(raw) if raw is not None else None
                if cols:
                    n = len(cols["content_id"])
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), *[pa.array(cols[c], k) for c, k in zip(X.COLUMNS, _ARROW, strict=True)]], names=[name, *X.COLUMNS])

    return df.select(F.col(name).cast("string"), data).mapInArrow(run, f"{name} string, {ENTRY}")


def _index_or_none(raw: bytes) -> dict | None:
    try:
        return X.decoded(raw)
    except ValueError:
        return None


def parsed(blobs: DataFrame, blob: str = "index_blob_id", data: str = "data") -> DataFrame:
    """Entries of index blobs (SC11), each blob's in the order of their ids. Damaged and null blobs
    give none."""
    return _entries_of(blobs, blob, data, _index_or_none)


def packs_with_index(index: DataFrame, body: str = "body", version: int = 2, most: int = MOST_ENTRIES) -> DataFrame:
    """``pack_blob_id, part, data``: the packs of live entries, made of ``body`` (binary, the greatest
    of a pack's rows), their own index and the closing record. Packs of more than ``most`` entries
    are cut into parts as index blobs are."""
    live = index.filter(~F.col("deleted") & F.col("pack_blob_id").isNotNull())
    sizes = live.groupBy("pack_blob_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    rows = live.join(sizes, "pack_blob_id").withColumn("part", F.concat_ws("-", F.length("content_id"), F.pmod(F.xxhash64("content_id"), F.col("_n"))))

    def encode(key: tuple, cols: dict[str, list]) -> tuple:
        held = max((x for x in cols.pop("_body") if x is not None), default=b"")
        own = X.encoded(cols, version)
        return (*key, held + own + X.closing_record(len(held), len(own)))

    return _by_part(rows.select("pack_blob_id", "part", *[c for c in X.COLUMNS if c != "pack_blob_id"], F.col("pack_blob_id").alias("_pack"), F.col(body).cast("binary").alias("_body")).withColumnRenamed("pack_blob_id", "pack"), ["pack", "part"], lambda k, c: encode(k, {("pack_blob_id" if n == "_pack" else n): v for n, v in c.items()})).withColumnRenamed("pack", "pack_blob_id")


def recovered_entries(packs: DataFrame, opened: Callable[[bytes, bytes], bytes] | None = None, data: str = "data") -> DataFrame:
    """Entries of packs by the packs' own records (SC15), for a store that lost its index. ``opened``
    decrypts an index by its nonce. Packs without a valid record give none."""

    def read(raw: bytes) -> dict | None:
        found = X.own_index(raw)
        if found is None:
            return None
        return _index_or_none(opened(*found) if opened else found[1])

    rows = packs.select(F.col("pack_blob_id").alias("_pack"), data)
    return _entries_of(rows, "_pack", data, read).drop("_pack")
