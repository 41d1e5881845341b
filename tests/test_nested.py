import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.functions import jsonindex as J
from moraine.operators import nested


def parse(text):
    """The last value of a name counts; None if it isn't JSON."""
    try:
        return json.loads(text, parse_constant=lambda _: 1 / 0), True
    except (ValueError, ZeroDivisionError):
        return None, False


def leaves(value, path="", pos=-1, name=None):
    if name in nested.LISTS and not isinstance(value, list) and value is not None:
        pos = 0
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k, pos, k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, path, i)
    elif value is not None:
        yield path, pos, value if isinstance(value, str) else json.dumps(value)


def brute(payload):
    value, ok = parse(payload)
    while ok and isinstance(value, str):
        value, ok = parse(value)
    if not ok or not isinstance(value, dict):
        return []
    out = []
    for s in nested.SECTIONS:
        v = value.get(s)
        while isinstance(v, str):
            held, ok = parse(v)
            if not ok:
                break
            v = held
        out += leaves(v, s, name=s)
    return out


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9999, 9999) | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(json_values, st.booleans(), st.integers(0, 99)), max_size=8))
def test_index_accepts_what_json_accepts(cases):
    texts = []
    for v, ascii_only, cut in cases:
        t = json.dumps(v, ensure_ascii=ascii_only)
        if cut < 30 and t:
            t = t[:cut] + random.Random(cut).choice(['"', "}", ",", "[", "\\", "0", ""]) + t[cut + 1 :]
        texts.append(t)
    nodes = J.index([t.encode("utf-8", "replace") for t in texts])
    assert list(nodes.valid) == [parse(t.encode("utf-8", "replace").decode())[1] for t in texts]


CASES = [
    '{"retention": {"keepLatest": "7", "keepDaily": null, "ignoreIdenticalSnapshots": false}}',
    '{"scheduling": {"timeOfDay": [{"hour": 1, "min": 0}, null, {"hour": 3}], "cron": "1 2 * * *"}}',
    '{"scheduling": {"timeOfDay": {"hour": 14, "min": null}, "cron": []}, "other": {"cron": [1]}}',
    '{"files": "{\\"ignore\\": [\\"a,b;\\\\u00e9\\", \\"\\\\\\"q\\\\\\"\\"], \\"maxFileSize\\": 10}"}',
    json.dumps(json.dumps({"osSnapshots": {"volumeShadowCopy": {"enable": "always"}}})),
    '{"files": {"ignore": ["a"]}', '{"files": {"ignore": ["a"],}}', "null", "", "[]", '"x"', '{"files": "not json", "retention": null}',
    '{"files": {"ignore": "x", "ignore": "y", "deep": {"a": {"b": [[1, 2], [3]]}}}}', '{"files": {"maxFileSize": 1e3, "a.b": -0.5}} x',
]


def test_leaves_against_parser(spark):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(CASES)] + [("n", None)], "id string, text string")
    nodes = nested.nested_nodes(df, "id", "text", nested.SECTIONS, nested.LISTS)
    got = sorted((r.policy_id, r.field_path, r.leaf_pos, r.leaf_text) for r in nested.policy_leaves(nodes).collect())
    assert got == sorted({(str(i), *leaf) for i, c in enumerate(CASES) for leaf in brute(c)})


def test_any_number_of_quotings(spark):
    text = '{"files": {"maxFileSize": 1}}'
    for _ in range(11):
        text = json.dumps(text)
    nodes = nested.nested_nodes(spark.createDataFrame([("a", text)], "id string, text string"), "id", "text", nested.SECTIONS, nested.LISTS)
    assert [tuple(r) for r in nested.policy_leaves(nodes).collect()] == [("a", "files.maxFileSize", -1, "1")]


def test_links_lead_to_the_root(spark):
    df = spark.createDataFrame([("a", CASES[1]), ("b", CASES[3])], "id string, text string")
    rows = nested.nested_nodes(df, "id", "text", nested.SECTIONS, nested.LISTS).collect()
    by = {(r.record_id, r.node_id): r for r in rows}
    assert len(by) == len(rows)
    for r in rows:
        while r.parent_id is not None:
            up = by[(r.record_id, r.parent_id)]
            assert up.node_kind in ("object", "list") and r.field_path.startswith(up.field_path)
            r = up
        assert r.node_id == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test data")
    from moraine.plans import core_problems as q
    from moraine.sources.tables import table

    state = {}
    for r in table(spark, sf, "policies").collect():
        if r.policy_id not in state or r.modified_at > state[r.policy_id].modified_at:
            state[r.policy_id] = r
    want = {(i, *leaf) for i, r in state.items() if not r.deleted and r.payload is not None for leaf in brute(r.payload)}
    assert {tuple(r) for r in q.p5_found(spark, sf).collect()} == want
