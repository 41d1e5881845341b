"""Splitting, hashing, compressing, encrypting and packing of byte strings; objects of chunks."""

from __future__ import annotations

import gzip
import hashlib
import hmac
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions import codes
from moraine.operators.ranking import running_within
from moraine.session import materialise


def fixed_chunks(df: DataFrame, data: str, size: int) -> DataFrame:
    """Chunks of ``size`` characters or bytes with number, start and length (CH01); an empty value
    has one empty chunk (OB02), a null none."""
    n = F.greatest(F.ceil(F.length(data) / F.lit(size)), F.lit(1)).cast("int")
    rows = df.filter(F.col(data).isNotNull()).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk_no") * size
    return rows.withColumns({"start": start.cast("bigint"), "chunk": F.substring(F.col(data), start + 1, F.lit(size))}).withColumn("length", F.length("chunk").cast("bigint"))


#: Bytes of the rolling window.
WINDOW = 64


def _table(seed: int = 1) -> np.ndarray:
    """256 random 32-bit values, from a seed."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


_BUZ = _table()


def _rolled_buz(raw: np.ndarray) -> np.ndarray:
    """Cyclic-polynomial hash of the last 64 bytes at every byte, the stream being preceded by
    zeros. By doubling: the hash of 2n bytes is that of the older n turned by n, xor the newer."""
    h = np.concatenate((np.full(WINDOW, _BUZ[0], np.uint32), _BUZ[raw]))
    n = 1
    while n < WINDOW:
        older = np.concatenate((np.zeros(n, np.uint32), h[:-n]))
        r = np.uint32(n % 32)
        turned = older if r == 0 else (older << r) | (older >> np.uint32(32 - r))
        h = turned ^ h
        n *= 2
    return h[WINDOW:]


def _rolled_poly(raw: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the last 64 bytes at every byte."""
    base, h, n = 0x9E3779B97F4A7C15, np.concatenate((np.zeros(WINDOW, np.uint64), raw.astype(np.uint64) + np.uint64(1))), 1
    with np.errstate(over="ignore"):
        while n < WINDOW:
            h = np.concatenate((np.zeros(n, np.uint64), h[:-n])) * np.uint64(pow(base, n, 1 << 64)) + h
            n *= 2
    h = h[WINDOW:]
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


ROLLING = {"buzhash": _rolled_buz, "rabinkarp": _rolled_poly}


def cut_points(raw: bytes, average: int, kind: str = "buzhash") -> list[int]:
    """Ends of content-defined chunks (CH02, CH03): where the hash of the last 64 bytes ends in
    zeros, not before half and not after twice the average, which is a power of two. The window
    runs on across cuts."""
    least, most, n = average // 2, average * 2, len(raw)
    if n == 0:
        return [0]
    hits = np.flatnonzero((ROLLING[kind](np.frombuffer(raw, np.uint8)) & np.uint32(average - 1)) == 0) + 1
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(hits, at + least))
        end = min(int(hits[k]) if k < len(hits) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def content_defined_chunks(df: DataFrame, key: str, data: str, average: int, kind: str = "buzhash") -> DataFrame:
    """``key, chunk_no, start, length, content_id`` by rolling hash; the id is the SHA-256 of the
    chunk. Null values have no chunks, empty ones one."""
    kt = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for no, end in enumerate(cut_points(raw, average, kind)):
                    for c, v in zip(rows, (k, no, at, end - at, hashlib.sha256(raw[at:end]).hexdigest()), strict=True):
                        c.append(v)
                    at = end
            kinds = (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[key, "chunk_no", "start", "length", "content_id"])

    rows = df.filter(F.col(data).isNotNull()).select(key, F.col(data).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"`{key}` {kt}, chunk_no int, start bigint, length bigint, content_id string")


def _keyed(name: str, length: int) -> Callable[[bytes, bytes], bytes]:
    if name.startswith("blake2"):
        make = getattr(hashlib, name)
        return lambda data, secret: make(data, key=secret[: 64 if name == "blake2b" else 32], digest_size=32).digest()[:length]
    return lambda data, secret: hmac.new(secret, data, name).digest()[:length]



def _blake3(size: int) -> Callable[[bytes, bytes], bytes]:
    """Keyed BLAKE3; a secret that isn't 32 bytes long is hashed to a key first."""
    return lambda data, secret: codes.blake3(data, secret if len(secret) == 32 else codes.blake3(secret), size)


def _members(data: bytes, size: int = 1 << 20) -> bytes:
    return b"".join(gzip.compress(data[i : i + size], 6, mtime=0) for i in range(0, max(1, len(data)), size))


def _unsnapped(data: bytes) -> bytes:
    n = shift = 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    return pa.Codec("snappy").decompress(data, n).to_pybytes() if n else b""


#: Keyed hashes by name (CH04): the digest is cut to the given number of bytes.
HASHES = {"HMAC-SHA256": _keyed("sha256", 32), "HMAC-SHA256-128": _keyed("sha256", 16), "HMAC-SHA224": _keyed("sha224", 28), "HMAC-SHA3-224": _keyed("sha3_224", 28), "HMAC-SHA3-256": _keyed("sha3_256", 32), "BLAKE2S-128": _keyed("blake2s", 16), "BLAKE2S-256": _keyed("blake2s", 32), "BLAKE2B-256": _keyed("blake2b", 32), "BLAKE2B-256-128": _keyed("blake2b", 16), "BLAKE3-256": _blake3(32), "BLAKE3-256-128": _blake3(16)}

#: Compressors by name (CH05).
COMPRESSORS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "gzip": (lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress), "gzip-best-speed": (lambda b: gzip.compress(b, 1, mtime=0), gzip.decompress), "gzip-best-compression": (lambda b: gzip.compress(b, 9, mtime=0), gzip.decompress),
    "deflate-default": (lambda b: zlib.compress(b, 6), zlib.decompress), "deflate-best-speed": (lambda b: zlib.compress(b, 1), zlib.decompress), "deflate-best-compression": (lambda b: zlib.compress(b, 9), zlib.decompress),
    # Members of a megabyte one after the other, and blocks of the format that S2 extends.
    "pgzip": (_members, gzip.decompress), "s2-default": (lambda b: pa.Codec("snappy").compress(b).to_pybytes(), _unsnapped),
    "zstd": (lambda b: zstandard.compress(b, 3), zstandard.decompress), "zstd-fastest": (lambda b: zstandard.compress(b, 1), zstandard.decompress), "zstd-better-compression": (lambda b: zstandard.compress(b, 7), zstandard.decompress), "zstd-best-compression": (lambda b: zstandard.compress(b, 11), zstandard.decompress),
}


def mapped(df: DataFrame, column: str, to: str, fn: Callable[[bytes], bytes | None], kind: str = "binary") -> DataFrame:
    """A bytes function over a column, in Arrow batches; nulls stay null."""

    @F.arrow_udf(kind)
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fn(x) for x in v.to_pylist()], pa.binary() if kind == "binary" else pa.string())

    return df.withColumn(to, run(F.col(column).cast("binary")))


def hashed(df: DataFrame, column: str, to: str, name: str, secret: bytes) -> DataFrame:
    """Keyed hash of a column as hex text (CH04)."""
    fn = HASHES[name]
    return mapped(df, column, to, lambda b: fn(b, secret).hex(), "string")


def compressed(df: DataFrame, column: str, to: str, name: str) -> DataFrame:
    """Compressed bytes, null where they aren't smaller (CH05, CH06)."""
    pack = COMPRESSORS[name][0]
    return mapped(df, column, to, lambda b: c if len(c := pack(b)) < len(b) else None)


def decompressed(df: DataFrame, column: str, to: str, name: str) -> DataFrame:
    return mapped(df, column, to, COMPRESSORS[name][1])


def content_key(master: bytes, content_id: bytes) -> bytes:
    """Key of one content, derived from the master key (CH07)."""
    return hmac.new(master, content_id, "sha256").digest()


def encrypted(data: Column, key: Column, content_id: Column) -> Column:
    """AES-256-GCM with the content id as associated data (CH07)."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), content_id)


def decrypted(data: Column, key: Column, content_id: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), content_id)


def sealed(df: DataFrame, column: str, to: str, master: bytes, content_id: str) -> DataFrame:
    """ChaCha20-Poly1305 with a key per content, derived from the master key, and the content id as
    associated data (CH07). The nonce comes from key and content, so equal contents give equal bytes."""
    pair = F.concat(F.rpad(F.hex(F.col(content_id).cast("binary")), 512, "\0").cast("binary"), F.col(column).cast("binary"))

    def run(b: bytes) -> bytes:
        cid, data = bytes.fromhex(b[:512].rstrip(b"\0").decode()), b[512:]
        key = content_key(master, cid)
        return codes.sealed(data, key, hmac.new(key, data, "sha256").digest()[:12], cid)

    return mapped(df.withColumn("_pair", pair), "_pair", to, run).drop("_pair")


def unsealed(df: DataFrame, column: str, to: str, master: bytes, content_id: str) -> DataFrame:
    """The data of ``sealed``; changed data is an error."""
    pair = F.concat(F.rpad(F.hex(F.col(content_id).cast("binary")), 512, "\0").cast("binary"), F.col(column).cast("binary"))

    def run(b: bytes) -> bytes:
        cid = bytes.fromhex(b[:512].rstrip(b"\0").decode())
        return codes.opened(b[512:], content_key(master, cid), cid)

    return mapped(df.withColumn("_pair", pair), "_pair", to, run).drop("_pair")


def protected(df: DataFrame, column: str, to: str, shards: int = 16, parity: int = 4) -> DataFrame:
    """Bytes with Reed-Solomon parity and checksums (CH08)."""
    return mapped(df, column, to, lambda b: codes.protected(b, shards, parity))


def mended(df: DataFrame, column: str, to: str, shards: int = 16, parity: int = 4) -> DataFrame:
    """The bytes again; null where more pieces are damaged than there is parity for (CH08)."""

    def run(b: bytes) -> bytes | None:
        try:
            return codes.mended(b, shards, parity)
        except ValueError:
            return None

    return mapped(df, column, to, run)


# -- objects ------------------------------------------------------------------------------------
def objects(chunks: DataFrame, key: str) -> DataFrame:
    """Object of each key (OB01): the content itself for one chunk, else a seek table. ``chunks``
    has ``key, chunk_no, length, content_id``."""
    per = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start", "length", "content_id"))).alias("_c"))
    table = F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["content_id"].alias("object")))
    name = F.sha2(F.array_join(F.transform("_c", lambda c: c["content_id"]), ","), 256)
    oid = F.when(F.size("_c") == 1, F.col("_c")[0]["content_id"]).otherwise(F.concat(F.lit("Ix"), name))
    return per.select(key, oid.alias("object_id"), F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, c: a + c["length"]).alias("length"), F.when(F.size("_c") > 1, table).alias("entries"))


#: Most entries of one seek table that is stored as one content; a longer one is a tree of them.
FANOUT = 4_096


def seek_trees(chunks: DataFrame, key: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Objects of any size (OB01): ``objects`` with ``key, object_id, length, depth`` and ``links``
    with ``node, place, start, length, child``, one row per entry of a seek table.

    An object of one chunk is that content. Else its chunks are listed in seek tables of at most
    ``fanout`` entries, these in others, and so on up to one; the id has an ``I`` per level. No row
    holds more than ``fanout`` entries, so a huge object is spread over tasks like any other.
    ``chunks`` has ``key, chunk_no`` (from 0), ``start, length, content_id``.
    """
    cols = [F.col("chunk_no").cast("bigint").alias("place"), F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), F.col("content_id").alias("child")]
    rows = materialise(chunks.select(key, *cols, F.lit(0).alias("depth")), "seek")
    most, links = (rows.agg(F.max("place")).first()[0] or 0) + 1, None
    while most > 1 or links is None:
        most = -(-most // fanout)
        per = rows.groupBy(key, F.floor(F.col("place") / fanout).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("place", "start", "length", "child"))).alias("_c"), F.max("depth").alias("depth"))
        whole = (F.col("_g") == 0) & (F.size("_c") == 1)  # the only one of its object: nothing to list
        name = F.concat(F.lit("x"), F.sha2(F.array_join(F.transform("_c", lambda c: c["child"]), ","), 256))
        per = materialise(per.withColumns({"node": F.when(~whole, name)}), "seek")
        more = per.filter("node is not null").select("node", F.explode("_c").alias("c")).select("node", (F.col("c.place") % fanout).alias("place"), "c.start", "c.length", "c.child")
        links = more if links is None else links.unionByName(more)
        total = F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, c: a + c["length"])
        rows = per.select(key, F.col("_g").cast("bigint").alias("place"), F.col("_c")[0]["start"].alias("start"), total.alias("length"), F.coalesce("node", F.col("_c")[0]["child"]).alias("child"), (F.col("depth") + F.col("node").isNotNull().cast("int")).alias("depth"))
    return rows.select(key, F.concat(F.repeat(F.lit("I"), F.col("depth")), "child").alias("object_id"), "length", "depth"), links


def chunk_at(chunks: DataFrame, offset: Column) -> DataFrame:
    """The chunk an offset lies in (OB03)."""
    return chunks.filter((F.col("start") <= offset) & (offset < F.col("start") + F.col("length")))


def concatenated(parts: DataFrame, group: Sequence[str], order: str, length: str) -> DataFrame:
    """Start of each part when the parts of a group are put one after another (OB04)."""
    return running_within(parts, group, [order], sums={"start": length}, before=True).withColumn("start", F.col("start").cast("bigint"))


def upload_parts(size: Column, part: int) -> Column:
    """Offsets of the parts of a large file (OB05): one more than its whole parts."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(size / F.lit(part)).cast("bigint")), lambda i: i * part)
