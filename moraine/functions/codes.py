"""Hashes, ciphers and codes that neither the JVM nor the standard library has: BLAKE3,
ChaCha20-Poly1305 and Reed-Solomon over bytes, by their published specifications."""

from __future__ import annotations

import binascii
import hmac
import struct

import numpy as np

# -- BLAKE3 ---------------------------------------------------------------------------------------
# Initial words, order of message words from round to round, flags.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_SHUFFLE = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
_ROWS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compressed(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """All 16 words of the compression of many blocks at once: ``cv`` is (8, n), ``words`` (16, n)."""
    n = words.shape[1]
    v = [*cv, *[np.full(n, x, np.uint32) for x in _IV[:4]], (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_ROWS):
            for x, (r, s) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                v[a] = v[a] + v[b] + x
                v[d] = _turn(v[d] ^ v[a], r)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], s)
        m = [m[i] for i in _SHUFFLE]
    return np.stack([*[v[i] ^ v[i + 8] for i in range(8)], *[v[i + 8] ^ cv[i] for i in range(8)]])


def blake3(data: bytes, key: bytes | None = None, length: int = 32) -> bytes:
    """BLAKE3 of up to 64 bytes, keyed if a key of 32 bytes is given. Chunks of the data are hashed
    side by side, and so are the nodes of each level of the tree."""
    start = _IV if key is None else np.frombuffer(key, "<u4").astype(np.uint32)
    base = 0 if key is None else _KEYED
    chunks = max(1, -(-len(data) // 1024))
    padded = np.zeros(chunks * 1024, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").astype(np.uint32).reshape(chunks, 16, 16)  # chunk, block, word
    sizes = np.full(chunks, 1024)
    sizes[-1] = len(data) - 1024 * (chunks - 1)
    blocks = np.maximum(1, -(-sizes // 64))
    cv = np.repeat(start[:, None], chunks, 1)
    number = np.arange(chunks, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(int(blocks.max())):
            on = np.flatnonzero(blocks > b)
            last = blocks[on] - 1 == b
            flags = base | (_CHUNK_START if b == 0 else 0) | np.where(last, _CHUNK_END, 0) | (np.where(last, _ROOT, 0) if chunks == 1 else 0)
            full = _compressed(cv[:, on], words[on, b].T, number[on], np.minimum(64, sizes[on] - 64 * b), flags)
            cv[:, on] = full[:8]
        while cv.shape[1] > 1:
            pairs = cv.shape[1] // 2
            m = np.concatenate([cv[:, 0 : 2 * pairs : 2], cv[:, 1 : 2 * pairs : 2]])
            root = _ROOT if cv.shape[1] == 2 else 0
            full = _compressed(np.repeat(start[:, None], pairs, 1), m, np.zeros(pairs, np.uint64), np.full(pairs, 64), np.full(pairs, base | _PARENT | root))
            cv = np.concatenate([full[:8], cv[:, 2 * pairs :]], 1)
    return full[:, -1].astype("<u4").tobytes()[:length]


# -- ChaCha20-Poly1305 ----------------------------------------------------------------------------
def _stream(key: bytes, nonce: bytes, first: int, blocks: int) -> np.ndarray:
    state = np.zeros((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(first, first + blocks)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    v = list(state)
    with np.errstate(over="ignore"):
        for _ in range(10):
            for a, b, c, d in _ROWS:
                for r, s in ((16, 20), (24, 25)):
                    v[a] = v[a] + v[b]
                    v[d] = _turn(v[d] ^ v[a], r)
                    v[c] = v[c] + v[d]
                    v[b] = _turn(v[b] ^ v[c], s)
        out = np.stack(v) + state
    return np.ascontiguousarray(out.T).astype("<u4").view(np.uint8).reshape(-1)


def _poly1305(key: bytes, data: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total = 0
    for i in range(0, len(data), 16):
        total = (total + int.from_bytes(data[i : i + 16] + b"\1", "little")) * r % ((1 << 130) - 5)
    return ((total + int.from_bytes(key[16:], "little")) % (1 << 128)).to_bytes(16, "little")


def _tag(key: bytes, nonce: bytes, data: bytes, extra: bytes) -> bytes:
    pad = lambda b: b + b"\0" * (-len(b) % 16)
    return _poly1305(_stream(key, nonce, 0, 1)[:32].tobytes(), pad(extra) + pad(data) + struct.pack("<QQ", len(extra), len(data)))


def _xored(data: bytes, key: bytes, nonce: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ _stream(key, nonce, 1, -(-len(data) // 64))[: len(data)]).tobytes() if data else b""


def sealed(data: bytes, key: bytes, nonce: bytes, extra: bytes = b"") -> bytes:
    """ChaCha20-Poly1305: nonce, encrypted data, tag."""
    body = _xored(data, key, nonce)
    return nonce + body + _tag(key, nonce, body, extra)


def opened(data: bytes, key: bytes, extra: bytes = b"") -> bytes:
    """The data again; a wrong key, damage or other ``extra`` data is a ValueError."""
    nonce, body, tag = data[:12], data[12:-16], data[-16:]
    if len(data) < 28 or not hmac.compare_digest(tag, _tag(key, nonce, body, extra)):
        raise ValueError("the data was changed")
    return _xored(body, key, nonce)


# -- Reed-Solomon ---------------------------------------------------------------------------------
def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms in the field of 256 elements with the polynomial x^8+x^4+x^3+x^2+1."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 128 else 0)
    return power, log


_POWER, _LOG = _field()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), np.uint8(0), _POWER[_LOG[a] + _LOG[b]])


def _product(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), rows.shape[1]), np.uint8)
    for j in range(m.shape[1]):
        out ^= _times(m[:, j : j + 1], rows[j][None, :])
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    a = np.concatenate([m, np.eye(n, dtype=np.uint8)], 1)
    for i in range(n):
        p = i + int(np.flatnonzero(a[i:, i])[0])
        a[[i, p]] = a[[p, i]]
        a[i] = _times(a[i], _POWER[(255 - _LOG[a[i, i]]) % 255])
        for j in range(n):
            if j != i and a[j, i]:
                a[j] ^= _times(a[i], a[j, i])
    return a[:, n:]


def _matrix(data: int, parity: int) -> np.ndarray:
    """Any ``data`` of its rows can be solved for; the first rows are the data themselves."""
    at = np.arange(data + parity, dtype=np.int64)[:, None] * np.arange(data, dtype=np.int64)[None, :]
    v = _POWER[at % 255]
    return _product(v, _inverse(v[:data]))


def protected(data: bytes, shards: int = 128, parity: int = 4) -> bytes:
    """``data`` with parity (CH08): its length, then ``shards`` + ``parity`` pieces of equal size, each
    behind its CRC-32. Up to ``parity`` damaged pieces can be mended."""
    size = max(1, -(-len(data) // shards))
    rows = np.zeros(shards * size, np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    rows = rows.reshape(shards, size)
    every = np.concatenate([rows, _product(_matrix(shards, parity)[shards:], rows)])
    return struct.pack(">Q", len(data)) + b"".join(struct.pack(">I", binascii.crc32(r.tobytes())) + r.tobytes() for r in every)


def mended(block: bytes, shards: int = 128, parity: int = 4) -> bytes:
    """The data again, if at most ``parity`` pieces are damaged; else a ValueError."""
    n = shards + parity
    size = (len(block) - 8) // n - 4
    if len(block) < 8 + 5 * n or 8 + n * (size + 4) != len(block):
        raise ValueError("not a protected block")
    length = struct.unpack_from(">Q", block)[0]
    pieces = np.frombuffer(block, np.uint8, offset=8).reshape(n, size + 4)
    good = [i for i in range(n) if struct.pack(">I", binascii.crc32(pieces[i, 4:].tobytes())) == pieces[i, :4].tobytes()]
    if len(good) < shards or length > shards * size:
        raise ValueError("too many pieces are damaged")
    good = good[:shards]
    rows = pieces[good, 4:]
    if good != list(range(shards)):
        rows = _product(_inverse(_matrix(shards, parity)[good]), rows)
    return np.ascontiguousarray(rows).tobytes()[:length]
