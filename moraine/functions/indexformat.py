"""Binary form of index blobs, versions 1 and 2, and of the record at the end of a pack.

Both versions are a header, sorted entries of a fixed size (key, then values) and the names of the
packs. Version 2 keeps times relative to the oldest, packs and content formats by number, and lengths
of their own. Entries are packed and unpacked as whole columns.
"""

from __future__ import annotations

import binascii
import struct
from collections.abc import Sequence

import numpy as np

# Layout of the two versions, big-endian.
HEADERS = {1: struct.Struct(">BBHI"), 2: struct.Struct(">BBHIIBI")}
VALUES_1 = np.dtype([("time_hi", ">u2"), ("time_lo", ">u4"), ("format_version", "u1"), ("name_length", "u1"), ("name_at", ">u4"), ("offset", ">u4"), ("packed", ">u4")])
VALUES_2 = np.dtype([("time", ">u4"), ("offset", ">u4"), ("original", "u1", 3), ("packed", "u1", 3), ("pack", ">u2")])
PACK_2, FORMAT_2 = np.dtype([("name_length", "u1"), ("name_at", ">u4")]), np.dtype([("compression_id", ">u4"), ("format_version", "u1"), ("encryption_key_id", "u1")])
DELETED = np.uint32(1 << 31)

COLUMNS = ["content_id", "timestamp_seconds", "deleted", "pack_blob_id", "pack_offset", "original_length", "packed_length", "compression_id", "format_version", "encryption_key_id"]


def key_of(content_id: str) -> bytes:
    """One byte for the prefix letter, 0 for none, then the bytes of the hex digits."""
    odd = len(content_id) % 2
    return (content_id[:1].encode() if odd else b"\0") + bytes.fromhex(content_id[odd:])


def id_of(key: bytes) -> str:
    return (chr(key[0]) if key[0] else "") + key[1:].hex()


def _numbers(values: Sequence, kind=np.int64) -> np.ndarray:
    return np.array([v or 0 for v in values], kind)


def _named(packs: Sequence[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pack names in order, the number of each entry's, and where each name begins."""
    names, numbers = {}, []
    for p in packs:
        numbers.append(names.setdefault((p or "").encode(), len(names)))
    lengths = [len(n) for n in names]
    return list(names), np.array(numbers, np.int64), np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)


def encoded(rows: dict[str, Sequence], version: int = 2) -> bytes:
    """Index blob of entries given as columns. Ids must have keys of one length; of the entries only
    what the version can hold is kept: version 1 has no original length and no format."""
    keys = [key_of(c) for c in rows["content_id"]]
    if len({len(k) for k in keys}) > 1:
        raise ValueError("keys of several lengths in one index")
    order = sorted(range(len(keys)), key=keys.__getitem__)
    col = {c: [rows[c][i] for i in order] for c in rows if c != "content_id"}
    n, size = len(keys), len(keys[0]) if keys else 0
    names, number, begins = _named(col["pack_blob_id"])
    time, offset, packed = (_numbers(col[c]) for c in ("timestamp_seconds", "pack_offset", "packed_length"))
    if n and (offset.min() < 0 or offset.max() >= 1 << (31 if version == 1 else 30) or packed.min() < 0 or max(map(len, names)) > 255):
        raise ValueError("an offset, length or name is out of range")
    place = offset.astype(np.uint32) | np.where([bool(d) for d in col["deleted"]], DELETED, np.uint32(0)) if n else offset.astype(np.uint32)
    lengths = np.array([len(x) for x in names], np.int64)
    if version == 1:
        v = np.zeros(n, VALUES_1)
        start = HEADERS[1].size + n * (size + VALUES_1.itemsize)
        v["time_hi"], v["time_lo"], v["format_version"] = time >> 32, time & 0xFFFFFFFF, _numbers(col["format_version"])
        if n:
            v["name_length"], v["name_at"] = lengths[number], start + begins[number]
        v["offset"], v["packed"] = place, packed
        head, body, tail = HEADERS[1].pack(1, size, VALUES_1.itemsize, n), v.view(np.uint8).reshape(n, VALUES_1.itemsize), b""
    else:
        original = _numbers(col["original_length"])
        if n and (max(original.max(), packed.max()) >= 1 << 28 or original.min() < 0 or len(names) > 1 << 24):
            raise ValueError("a length is out of range")
        formats: dict[tuple, int] = {}
        form = np.array([formats.setdefault(tuple(int(x or 0) for x in f), len(formats)) for f in zip(col["compression_id"], col["format_version"], col["encryption_key_id"], strict=True)], np.int64)
        base = int(time.min()) if n else 0
        v = np.zeros(n, VALUES_2)
        v["time"], v["offset"], v["pack"] = time - base, place, number & 0xFFFF
        for name, value in (("original", original), ("packed", packed)):
            v[name] = np.stack([(value >> s) & 0xFF for s in (16, 8, 0)], 1) if n else 0
        more = [form, number >> 16, (original >> 24 << 4) | packed >> 24]
        need = 3 if n and more[2].any() else 2 if n and more[1].any() else 1 if len(formats) > 1 else 0
        body = np.concatenate([v.view(np.uint8).reshape(n, VALUES_2.itemsize), *[m.astype(np.uint8)[:, None] for m in more[:need]]], 1)
        start = HEADERS[2].size + n * (size + body.shape[1]) + len(names) * PACK_2.itemsize + len(formats) * FORMAT_2.itemsize
        packs, kinds = np.zeros(len(names), PACK_2), np.array(list(formats), np.int64).reshape(-1, 3)
        packs["name_length"], packs["name_at"] = lengths, start + begins
        f = np.zeros(len(formats), FORMAT_2)
        for i, c in enumerate(FORMAT_2.names):
            f[c] = kinds[:, i]
        head, tail = HEADERS[2].pack(2, size, body.shape[1], n, len(names), len(formats), base), packs.tobytes() + f.tobytes()
    key = np.frombuffer(b"".join(keys[i] for i in order), np.uint8).reshape(n, size)
    return head + np.concatenate([key, body], 1).tobytes() + tail + b"".join(names)


def _part(blob: bytes, start: int, length: int) -> bytes:
    if start + length > len(blob):
        raise ValueError("the blob ends early")
    return blob[start : start + length]


def _wide(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return a[:, 0] << 16 | a[:, 1] << 8 | a[:, 2]


def decoded(blob: bytes, overhead: int = 0) -> dict[str, list]:
    """Columns of an index blob of either version. Version 1 has no original length; it is the packed
    one less ``overhead``. Damaged blobs are a ValueError."""
    try:
        version = blob[0]
        head = HEADERS[version].unpack_from(blob)
        size, stride, n = head[1], head[2], head[3]
        at = HEADERS[version].size
        table = np.frombuffer(blob, np.uint8, n * (size + stride), at).reshape(n, size + stride)
        ids = [id_of(k.tobytes()) for k in table[:, :size]]
        values = np.ascontiguousarray(table[:, size:])
        name = lambda start, length: _part(blob, start, length).decode() or None
        if version == 1:
            v = values.view(VALUES_1)[:, 0] if n else np.zeros(0, VALUES_1)
            packed = v["packed"].astype(np.int64)
            time, offset = v["time_hi"].astype(np.int64) << 32 | v["time_lo"], v["offset"].astype(np.uint32)
            packs = [name(int(a), int(m)) for a, m in zip(v["name_at"], v["name_length"], strict=True)]
            original, form, other = packed - overhead, v["format_version"].tolist(), [[0] * n, [0] * n]
        else:
            count, kinds, base = head[4:]
            v = np.ascontiguousarray(values[:, : VALUES_2.itemsize]).view(VALUES_2)[:, 0] if n else np.zeros(0, VALUES_2)
            extra = [values[:, VALUES_2.itemsize + i].astype(np.int64) if stride > VALUES_2.itemsize + i else np.zeros(n, np.int64) for i in range(3)]
            after = at + n * (size + stride)
            p = np.frombuffer(blob, PACK_2, count, after)
            f = np.frombuffer(blob, FORMAT_2, kinds, after + count * PACK_2.itemsize)
            known = [name(int(a), int(m)) for a, m in zip(p["name_at"], p["name_length"], strict=True)]
            packs = [known[i] for i in (v["pack"].astype(np.int64) | extra[1] << 16).tolist()]
            time, offset = v["time"].astype(np.int64) + base, v["offset"].astype(np.uint32)
            original, packed = _wide(v["original"]) | extra[2] >> 4 << 24, _wide(v["packed"]) | (extra[2] & 15) << 24
            own = f[extra[0]] if n else f[:0]
            form, other = own["format_version"].tolist(), [own["compression_id"].tolist(), own["encryption_key_id"].tolist()]
    except (KeyError, IndexError, struct.error, ValueError) as e:
        raise ValueError("not an index blob") from e
    return dict(zip(COLUMNS, [ids, time.tolist(), (offset & DELETED != 0).tolist(), packs, (offset & ~DELETED).tolist(), original.tolist(), packed.tolist(), other[0], form, other[1]], strict=True))


# -- the record at the end of a pack --------------------------------------------------------------
def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varints(data: bytes, count: int) -> tuple[list[int], int]:
    got, at = [], 0
    for _ in range(count):
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        got.append(value)
    return got, at


def closing_record(index_at: int, index_length: int, nonce: bytes = b"") -> bytes:
    """Where a pack's own index lies, with a checksum and the record's length as the last byte."""
    body = _varint(1) + _varint(len(nonce)) + nonce + _varint(index_at) + _varint(index_length)
    body += struct.pack(">I", binascii.crc32(body))
    if len(body) > 255:
        raise ValueError("the record is too long")
    return body + bytes([len(body)])


def own_index(pack: bytes) -> tuple[bytes, bytes] | None:
    """``(nonce, index)`` of a pack by its closing record; None if there is none or it is damaged."""
    if not pack or not 5 <= pack[-1] < len(pack):
        return None
    body = pack[-1 - pack[-1] : -1]
    if struct.pack(">I", binascii.crc32(body[:-4])) != body[-4:]:
        return None
    try:
        (version, length), at = _read_varints(body[:-4], 2)
        nonce = body[at : at + length]
        (start, size), _ = _read_varints(body[at + length : -4], 2)
    except IndexError:
        return None
    if version != 1 or start + size > len(pack):
        return None
    return nonce, pack[start : start + size]
