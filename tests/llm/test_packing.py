import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import packing as P


def plain_ffd(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, room in enumerate(bins):
            if room >= sizes[i]:
                break
        else:
            bins.append(capacity)
            b = len(bins) - 1
        bins[b] -= sizes[i]
        out[i] = b
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_tree_gives_plain_first_fit_decreasing(sizes):
    assert P.first_fit_decreasing(sizes, 50) == plain_ffd(sizes, 50)


def test_oversize_is_an_error():
    with pytest.raises(ValueError):
        P.first_fit_decreasing([3, 9], 8)


def test_every_token_has_one_place(spark):
    rnd = random.Random(1)
    texts = ["", " ", None, "backup " * 3000, "x" * 5000] + [" ".join(rnd.choice(["pack", "index", "blob", "é", "<|endoftext|>"]) for _ in range(rnd.randint(1, 300))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int, capacity string")
    kinds = spark.createDataFrame([(1, 64), (2, 500), (3, None), (4, 0), (None, 9), (2, 500)], "container_id bigint, capacity_tokens bigint")
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    assert set(counts) == {i for i, t in enumerate(texts) if t is not None} and counts[0] == 0
    rows = P.packed(docs, kinds, group_items=40).collect()
    for kind, capacity in ((1, 64), (2, 500)):
        own = [r for r in rows if r.container_id == kind]
        at = {}
        for r in sorted(own, key=lambda r: (r.doc_id, r.piece_no)):
            assert r.token_from == at.get(r.doc_id, 0)
            at[r.doc_id] = r.token_from + r.n_tokens
            assert counts[r.doc_id] > capacity or r.piece_no == 0
        assert at == counts
        load = {}
        for r in own:
            load[(r.group_no, r.bin_no)] = load.get((r.group_no, r.bin_no), 0) + r.n_tokens
        assert max(load.values()) <= capacity
        for g in {r.group_no for r in own}:
            part = sorted((r for r in own if r.group_no == g), key=lambda r: (r.doc_id, r.piece_no))
            assert [r.bin_no for r in part] == plain_ffd([r.n_tokens for r in part], capacity)
    assert {r.container_id for r in rows} == {1, 2} and len({r.group_no for r in rows}) > 1
    assert P.packed(docs.limit(0), kinds).count() == 0 and P.packed(docs, kinds.limit(0)).count() == 0
    shares = {r.container_id: r.fill for r in P.fill(P.packed(docs, kinds), kinds.filter("capacity_tokens > 0 and container_id is not null").distinct()).collect()}
    assert all(0.9 < f <= 1 for f in shares.values())
