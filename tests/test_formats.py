"""Binary index blobs, packs and codes: exact round trips and damaged input."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.functions import indexformat as X

ENTRY = st.tuples(
    st.sampled_from(["", "m", "x"]), st.binary(min_size=4, max_size=4), st.integers(0, 4_000_000_000), st.booleans(), st.sampled_from([None, "p1", "q22", "p" * 200]), st.integers(0, (1 << 30) - 1), st.sampled_from([0, 1, 5_000, 1 << 24, (1 << 28) - 1]), st.sampled_from([0, 7, (1 << 28) - 1]), st.sampled_from([0, 4096]), st.sampled_from([1, 2]), st.sampled_from([0, 3]),
)


def columns(rows):
    rows = [(p + b.hex(), *r) for p, b, *r in rows]
    return dict(zip(X.COLUMNS, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in X.COLUMNS}


@settings(max_examples=80, deadline=None)
@given(st.lists(ENTRY, max_size=20))
def test_version_2_round_trip(rows):
    want = columns(rows)
    order = sorted(range(len(rows)), key=lambda i: X.key_of(want["content_id"][i]))
    blob = X.encoded(want)
    assert X.decoded(blob) == {c: [v[i] for i in order] for c, v in want.items()}
    for cut in (1, 5, len(blob) // 2):
        if rows and cut < len(blob):
            with pytest.raises(ValueError):
                X.decoded(blob[:cut])


@settings(max_examples=40, deadline=None)
@given(st.lists(ENTRY, max_size=20))
def test_version_1_round_trip(rows):
    want = columns(rows)
    order = sorted(range(len(rows)), key=lambda i: X.key_of(want["content_id"][i]))
    got = X.decoded(X.encoded(want, 1), overhead=0)
    for c in ("content_id", "timestamp_seconds", "deleted", "pack_blob_id", "pack_offset", "packed_length", "format_version"):
        assert got[c] == [want[c][i] for i in order]


def test_many_packs_take_a_third_byte():
    n = 70_000
    rows = {"content_id": [f"{i:08x}" for i in range(n)], "timestamp_seconds": [5] * n, "deleted": [False] * n, "pack_blob_id": [f"p{i}" for i in range(n)], "pack_offset": [1] * n, "original_length": [2] * n, "packed_length": [3] * n, "compression_id": [0] * n, "format_version": [1] * n, "encryption_key_id": [0] * n}
    assert X.decoded(X.encoded(rows))["pack_blob_id"][-1] == f"p{n - 1}"


def test_closing_record():
    body, index = b"data" * 100, bytes(range(256)) * 2
    pack = body + index + X.closing_record(len(body), len(index), b"nonce")
    assert X.own_index(pack) == (b"nonce", index)
    rnd = random.Random(1)
    for _ in range(50):
        i = len(pack) - 1 - rnd.randrange(pack[-1])
        damaged = pack[:i] + bytes([pack[i] ^ (1 + rnd.randrange(255))]) + pack[i + 1 :]
        assert X.own_index(damaged) in (None, (b"nonce", index)) and X.own_index(damaged) is None
    assert X.own_index(b"") is None and X.own_index(pack[:-1]) is None and X.own_index(b"\xff") is None
    with pytest.raises(ValueError):
        X.encoded(columns([("", b"abcd", 1, False, "p", -1, 1, 1, 0, 1, 0)]))


def test_indexes_of_damaged_blobs_give_no_entries(spark):
    from moraine.operators import packindex as P

    good = X.encoded(columns([("x", b"abcd", 7, False, "p1", 9, 2, 1, 0, 1, 0)]))
    rows = [("a", good), ("b", good[:20]), ("c", b""), ("d", None)]
    got = P.parsed(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "index_blob_id string, data binary")).collect()
    assert [(r.index_blob_id, r.content_id, r.pack_blob_id) for r in got] == [("a", "x" + b"abcd".hex(), "p1")]


# Published test vectors.
def test_blake3():
    from moraine.functions.codes import blake3

    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3(bytes(i % 251 for i in range(102_400))).hex().startswith("bc3e3d41a1146b06")
    assert len({blake3(b"x" * n, b"k" * 32) for n in (0, 1, 64, 65, 1024, 1025, 2048, 3073)}) == 8


def test_chacha20_poly1305():
    from moraine.functions.codes import opened, sealed

    key, nonce, extra = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    box = sealed(text, key, nonce, extra)
    assert box[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691" and opened(box, key, extra) == text
    for i in (0, 13, len(box) - 1):
        with pytest.raises(ValueError):
            opened(box[:i] + bytes([box[i] ^ 1]) + box[i + 1 :], key, extra)
    with pytest.raises(ValueError):
        opened(b"short", key)
    assert opened(sealed(b"", key, nonce), key) == b""


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.lists(st.integers(0, 11), max_size=6, unique=True))
def test_reed_solomon(data, lost):
    from moraine.functions.codes import mended, protected

    block = bytearray(protected(data, 8, 4))
    size = (len(block) - 8) // 12
    for i in lost:
        block[8 + i * size + 3] ^= 0x55
    if len(lost) <= 4:
        assert mended(bytes(block), 8, 4) == data
    else:
        with pytest.raises(ValueError):
            mended(bytes(block), 8, 4)
    with pytest.raises(ValueError):
        mended(bytes(block[:-1]), 8, 4)
