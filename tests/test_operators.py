"""Operators on small literal cases and against sequential models."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.functions import scalars as X
from moraine.functions import wildcards as W
from moraine.operators import blobs as B
from moraine.operators import chunks as K
from moraine.operators import contents as C
from moraine.operators import epochs as E
from moraine.operators import metrics as M
from moraine.operators import policies as P
from moraine.operators import snapshots as S
from moraine.operators import trees

T0 = dt.datetime(2024, 1, 1)
INDEX = "content_id string, timestamp_seconds bigint, deleted boolean, pack_blob_id string, original_length bigint, packed_length bigint, pack_offset bigint, compression_id int, index_blob_id string"


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


# -- contents -----------------------------------------------------------------------------------
def entry(cid, ts, deleted=False, pack="p", offset=0, packed=1, original=2):
    return (cid, ts, deleted, pack, original, packed, offset, None, "n")


def test_winner(spark):
    rows = [entry("aabbcc", 1, offset=11), entry("aabbcc", 3, offset=33), entry("aabbcc", 2, offset=22), entry("de1e1e", 4), entry("de1e1e", 4, True), entry("ddeeff", 3, pack="xx"), entry("ddeeff", 3, pack="zz"), entry("ddeeff", 3, pack=None), entry(None, 1), entry("x", None)]
    got = {r.content_id: r for r in C.merged(spark.createDataFrame(rows, INDEX)).collect()}
    assert set(got) == {"aabbcc", "de1e1e", "ddeeff"}
    assert got["aabbcc"].pack_offset == 33 and got["de1e1e"].live and got["ddeeff"].pack_blob_id == "zz"
    assert C.point_lookup(spark.createDataFrame(rows, INDEX), "aabbcc").count() == 1
    assert C.merged(spark.createDataFrame([], INDEX)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 4), st.booleans(), st.sampled_from([None, "p", "q"])), min_size=1, max_size=30), st.integers(0, 30))
def test_merge_is_idempotent_and_associative(spark, rows, cut):
    df = spark.createDataFrame([entry(a, b, c, d) for a, b, c, d in rows], INDEX)
    again = lambda m: m.withColumn("deleted", ~F.col("live")).select(*df.columns)
    out = {tuple(r) for r in C.merged(df).collect()}
    assert {tuple(r) for r in C.merged(again(C.merged(df))).collect()} == out
    a, b = (spark.createDataFrame([entry(*r) for r in part], INDEX) for part in (rows[:cut], rows[cut:]))
    assert {tuple(r) for r in C.merged(again(C.merged(a)).unionByName(again(C.merged(b)))).collect()} == out


def test_verify_and_compaction(spark):
    rows = [entry("a", 1, pack="p1", offset=90, packed=10), entry("b", 1, pack="p1", offset=91, packed=10), entry("c", 1, pack="no"), entry("d", 1, True), entry("e", 1, pack="pnull", offset=5), entry("f", 9, True)]
    m = C.merged(spark.createDataFrame(rows, INDEX))
    blobs = spark.createDataFrame([("p1", 100), ("pnull", None)], "blob_id string, blob_length bigint")
    assert {r.content_id: r.state for r in C.verify(m, blobs).collect()} == {"a": "ok", "b": "truncated", "c": "missing", "e": "ok"}
    kept = C.compacted(spark.createDataFrame(rows, INDEX), m.filter("content_id = 'a'"), 5)
    assert {r.content_id for r in kept.collect()} == {"b", "c", "e", "f"}


def test_write_path(spark):
    index = C.merged(spark.createDataFrame([entry("a", 10), entry("b", 10, True), entry("c", 99, True)], INDEX))
    batch = C.merged(spark.createDataFrame([entry("a", 20), entry("b", 20), entry("c", 20), entry("d", 20)], INDEX))
    assert {(r.content_id, r.timestamp_seconds) for r in C.deduplicated_writes(index, batch).collect()} == {("b", 20), ("c", 100), ("d", 20)}
    dead = C.tombstones(index, spark.createDataFrame([("a",), ("b",)], "content_id string"), 5)
    assert [(r.content_id, r.timestamp_seconds, r.live) for r in dead.collect()] == [("a", 11, False)]


# -- blobs --------------------------------------------------------------------------------------
BLOBS = "blob_id string, blob_length bigint, ts bigint"


def test_point_in_time(spark):
    rows = [("a", T0, False), ("a", T0 + dt.timedelta(1), True), ("b", T0 + dt.timedelta(2), False), (None, T0, False)]
    df = spark.createDataFrame(rows, "blob_id string, ts timestamp_ntz, deleted boolean")
    at = lambda d: {r.blob_id for r in B.as_of(df, "blob_id", "ts", F.lit(T0 + dt.timedelta(d)).cast("timestamp_ntz")).collect()}
    assert at(-1) == set() and at(0) == {"a"} and at(1) == set() and at(2) == {"b"}


def test_prefix_scans_repeat_for_overlaps(spark):
    df = spark.createDataFrame([("pa",), ("pb",), ("q",)], "blob_id string")
    assert sorted((r.blob_id, r.scanned) for r in B.prefix_scans(df, ["p", "pa"]).collect()) == [("pa", "p"), ("pa", "pa"), ("pb", "p")]


def test_complete_sets(spark):
    ids = ["a-s0-c2", "malformed", "b-s0-c2", "x-s1-c2", "c-s2-c1", "d-s2-c1"]
    got = {tuple(r.members) for r in B.complete_sets(spark.createDataFrame([(i,) for i in ids], "blob_id string")).collect()}
    assert got == {("malformed",), ("a-s0-c2", "b-s0-c2"), ("c-s2-c1", "d-s2-c1")}


def test_pack_garbage_classes(spark):
    rows = [("p1", 1, 1002), ("p2", 1, 1001), ("p3", 1, 901), ("p4-s1-c", 1, 100), ("p5-s2-c", 1, 100), ("p6", 1, 902)]
    sessions = spark.createDataFrame([("s1", 992), ("s2", 991)], "session_id string, checkpoint bigint")
    got = {r.blob_id: r.fate for r in B.pack_garbage(spark.createDataFrame(rows, BLOBS), sessions, 1000, 100, 10).collect()}
    assert got == {"p1": "after cutoff", "p2": "too young", "p3": "unreferenced", "p4-s1-c": "active session", "p5-s2-c": "unreferenced", "p6": "too young"}


@pytest.mark.parametrize("seed", range(3))
def test_budget_cleanup_and_sweep_against_loops(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"b{i}", rnd.randint(0, 50), rnd.randint(0, 5) * 40_000 + rnd.randint(0, 3)) for i in range(60)]
    df = spark.createDataFrame(rows, BLOBS)
    size, count, gone = 0, 0, False
    want = set()
    for b, n, ts in sorted(rows, key=lambda r: (-r[2], r[0])):
        size, count = size + n, count + 1
        gone = gone or size > 700 or count > 40 or 300_000 - ts > 250_000
        want |= {b} if gone else set()
    assert {r.blob_id for r in B.cleanup_by_budget(df, 700, 40, 250_000, 300_000).collect()} == want
    left, want = sum(r[1] for r in rows), set()
    for b, n, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if left <= 400 or 300_000 - ts < 130_000 and left <= 900:
            break
        left -= n
        want.add(b)
    assert {r.blob_id for r in B.lru_sweep(df, 400, 900, 130_000, 300_000).collect()} == want


def test_sync(spark):
    kind = "blob_id string, blob_length bigint, blob_ts bigint"
    a, b = spark.createDataFrame([("x", 1, 5), ("y", 1, 5), ("n", 1, 1)], kind), spark.createDataFrame([("y", 1, 4), ("z", 1, 1), ("n", 1, 1)], kind)
    act = lambda **k: {r.blob_id: r.action for r in B.sync_plan(a, b, **k).collect()}
    assert act(update=True, delete=True) == {"x": "copy", "y": "copy", "z": "delete", "n": "in-sync"}
    assert act(update=False, delete=False) == {"x": "copy", "y": "in-sync", "z": "keep", "n": "in-sync"}


# -- snapshots ----------------------------------------------------------------------------------
SNAP = "manifest_id string, host_name string, user_name string, source_path string, start_time timestamp_ntz, end_time timestamp_ntz, complete boolean, root_oid string, pins array<string>"


def months_before(t, n):
    m = t.year * 12 + t.month - 1 - n
    return dt.datetime(m // 12, m % 12 + 1, 1) + (t - dt.datetime(t.year, t.month, 1))


PERIODS = {
    "annual": (lambda t: f"{t:%Y}", lambda t, n: months_before(t, 12 * n)),
    "monthly": (lambda t: f"{t:%Y-%m}", months_before),
    "weekly": (lambda t: "%04d-%02d" % t.isocalendar()[:2], lambda t, n: t - dt.timedelta(weeks=n)),
    "daily": (lambda t: f"{t:%Y-%m-%d}", lambda t, n: t - dt.timedelta(days=n)),
    "hourly": (lambda t: f"{t:%Y-%m-%d %H}", lambda t, n: t - dt.timedelta(hours=n)),
}


def model(rows, keep):
    """The rules as sets: per kind the newest snapshot of each period since the cut-off, numbered
    from the newest; a week named like a kept month is left out; incomplete ones that lead."""
    key = lambda r: (r[4], r[5], r[0])
    done = sorted((r for r in rows if r[6]), key=key)
    first_n = lambda rs, n: [r[0] for r in sorted(rs, key=key, reverse=True)[:n]]
    latest = keep.get("latest") if any(keep.values()) else len(rows)
    got = {"latest": first_n(done, latest or 0)}
    months = set()
    for kind, (name, cut) in PERIODS.items():
        if keep.get(kind) is None or not done:
            continue
        newest_of = {name(r[4]): r for r in done if r[4] >= cut(max(x[4] for x in done), keep[kind])}
        if kind == "weekly":
            newest_of = {p: r for p, r in newest_of.items() if p not in months}
        got[kind] = first_n(newest_of.values(), keep[kind])
        if kind == "monthly":
            months = {p for p, r in newest_of.items() if r[0] in got[kind]}
    lead = [r for r in rows if not r[6] and all(key(r) > key(d) for d in done)]
    top, few = max(r[4] for r in rows), set(first_n(lead, 3))
    out = {(m, f"{kind}-{i}") for kind, ms in got.items() for i, m in enumerate(ms, 1)}
    return out | {(r[0], "incomplete") for r in lead if r[0] in few or top - r[4] < dt.timedelta(hours=4)}


@pytest.mark.parametrize("seed", range(6))
def test_retention_against_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], set()
    keep = {k: rnd.choice([None, 0, 1, 3, 6]) for k in S.KINDS} if seed else dict.fromkeys(S.KINDS)
    for s in range(4):
        base = dt.datetime(2024, 1, rnd.randint(1, 31), 12) + dt.timedelta(days=rnd.choice([0, 60, 365]))
        own = []
        for i in range(40):
            start = base - dt.timedelta(minutes=rnd.choice([rnd.randint(0, 600), rnd.randint(0, 60 * 24 * 40), rnd.randint(0, 60 * 24 * 900)]))
            own.append((f"{s}-{i:02d}", None if s == 3 else "h", "u", f"/{s}", start, start, rnd.random() < 0.8, "r", []))
        if seed % 2:
            last = max(r[4] for r in own)
            own += [(f"{s}-x{i}", own[0][1], "u", f"/{s}", last + dt.timedelta(hours=i), last, False, "r", []) for i in range(1, 8)]
        rows += own
        want |= model(own, keep)
    got = [tuple(r) for r in S.retention_reasons(spark.createDataFrame(rows, SNAP), keep).collect()]
    assert set(got) == want and len(got) == len(want)


def test_tags_and_pins(spark):
    rows = [("a", t) for t in ("hourly-4", "hourly-5", "weekly-9", "by hand", "hourly-6", "weekly-1", "two-words")]
    got = {r.tag for r in S.compact_tags(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {"hourly-4..6", "weekly-1", "weekly-9", "by hand", "two-words"}
    assert column(spark, [["keep", "audit", "keep", "2024"], None], "array<string>", S.compact_pins) == [["2024", "audit", "keep"], None]
    assert column(spark, [["b"], None], "array<string>", lambda c: S.updated_pins(c, ["a"], ["b"])) == [["a"], ["a"]]


def test_runs_previous_and_unique(spark):
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(f"m{i}", "h", None, "/p", t(i), t(i), c, r, ["x"]) for i, (r, c) in enumerate([("a", True), ("a", True), ("b", True), ("a", True), (None, False), (None, False)])]
    df = spark.createDataFrame(rows, SNAP)
    assert sorted((r.root_oid or "", r.n, r.pins) for r in S.identical_runs(df).collect()) == [("", 2, ["x"]), ("a", 1, ["x"]), ("a", 2, ["x"]), ("b", 1, ["x"])]
    assert {r.manifest_id for r in S.previous_manifests(df).collect()} == {"m3", "m4", "m5"}
    assert {r.manifest_id: r.previous_id for r in S.with_previous(df).collect()}["m2"] == "m1"
    assert {r.root_oid: (r.manifest_id, r.n) for r in S.unique_roots(df).collect()} == {"a": ("m0", 3), "b": ("m2", 1), None: ("m4", 2)}


# -- epochs -------------------------------------------------------------------------------------
def test_chains():
    assert E.longest_chain([(0, 9), (0, 29), (10, 19), (30, 39)]) == [(0, 29), (30, 39)]
    assert E.longest_chain([(0, 9), (20, 29), (50, 59)]) == [(0, 9)]
    assert E.longest_chain([(0, 9), (10, 29), (0, 29)]) == [(0, 29)]
    assert E.longest_chain([(1, 2)]) == [] and E.longest_chain([]) == []


@pytest.mark.parametrize("candidate,want", [(2, 2), (3, 4), (4, 4), (5, 7), (6, 7), (7, 7), (8, 9), (9, 9)])
def test_oldest_uncompacted(spark, candidate, want):
    df = spark.createDataFrame([(3,), (5,), (6,), (8,)], "epoch bigint")
    assert E.oldest_uncompacted(df, candidate).first()[0] == want


def test_advance_and_drop_time(spark):
    kind = "epoch int, ts bigint, blob_length bigint"
    day = 86_400
    df = spark.createDataFrame([(1, 0, 6), (1, day, 6), (2, 0, 6), (2, day - 1, 6), (3, 0, 1), (3, day, 1), (4, 0, 0), (4, 5, 0), (4, day, 0)], kind)
    assert {r.epoch for r in E.advancing(df, day, 3, 10).collect()} == {1, 4}
    h = 3600
    run = lambda *r: E.safe_drop_time(spark.createDataFrame(list(r), "start bigint, end bigint, success boolean"), 4 * h, h).first()[0]
    assert run((7 * h, 7 * h, True), (13 * h, 13 * h, True)) == 6 * h
    assert run((7 * h, 7 * h, True), (9 * h, 9 * h, True)) is None
    assert run((7 * h, 7 * h, False), (13 * h, 13 * h, True)) is None


# -- metrics ------------------------------------------------------------------------------------
def test_series(spark):
    kind = "g string, s timestamp_ntz, e timestamp_ntz, v bigint"
    rows = [("a", dt.datetime(2021, 1, 1, 12, 45), dt.datetime(2021, 1, 1, 14, 45), 200), ("a", T0, T0, 5), ("a", T0, None, 5)]
    got = M.counter_series(spark.createDataFrame(rows, kind), ["g"], "s", "e", "v", "hour").orderBy("point").collect()
    assert [(r.point.hour, r.value) for r in got] == [(12, 25), (13, 100), (14, 75)]
    rows = [("a", dt.datetime(2021, 1, 1), dt.datetime(2021, 4, 1), 300)]
    got = M.counter_series(spark.createDataFrame(rows, kind), ["g"], "s", "e", "v", "month").orderBy("point").collect()
    assert [r.value for r in got] == [103, 93, 103]


def test_buckets_and_merge(spark):
    assert column(spark, [100, 101, 500_000_001, None], "bigint", lambda c: X.bucket(c, X.SIZE_THRESHOLDS)) == [0, 1, 21, None]
    df = spark.createDataFrame([("a", i % 3, v) for i, v in enumerate([1, 50, 120, 251, None, 10_000])], "g string, h int, v bigint")
    whole = M.distribution(df, ["g"], "v", [100, 250]).first()
    parts = M.merged_distributions(M.distribution(df, ["g", "h"], "v", [100, 250]), ["g"]).first()
    assert list(whole.buckets) == [2, 1, 2] == list(parts.buckets)
    assert (whole.least, whole.most, whole.total, whole.n) == (1, 10_000, 10_422, 5) == (parts.least, parts.most, parts.total, parts.n)


# -- scalar functions ---------------------------------------------------------------------------
def test_units(spark):
    assert column(spark, [0, 899, 900, 1_500, 899_999, 2_250_000, 10**19 // 10], "bigint", X.unit_string) == ["0 B", "899 B", "0.9 KB", "1.5 KB", "900 KB", "2.2 MB", "1 EB"]
    assert column(spark, [921, 922], "bigint", lambda c: X.unit_string(c, base=1024)) == ["921 B", "0.9 KiB"]
    assert column(spark, [0.0, 0.15, 0.25, 0.35, 0.95, 62.25, 62.75, 99.96], "double", X.one_decimal) == [f"{v:.1f}" for v in (0.0, 0.15, 0.25, 0.35, 0.95, 62.25, 62.75, 99.96)]


def test_sources_and_paths(spark):
    got = column(spark, ["user@host:/path", "@host", "u@h", "(global)", "nothing", "u@h:C:\\x"], "string", X.parsed_source)
    assert [tuple(g) if g else None for g in got] == [("host", "user", "/path"), ("host", "", ""), ("h", "u", ""), ("", "", ""), None, ("h", "u", "C:\\x")]
    paths = ["/", "/a", "/a/b", "/a/b/", "C:\\", "C:\\x", "C:\\x\\y", "C:/x", "name", None]
    assert column(spark, paths, "string", P.parent_path) == ["/", "/", "/a", "/a", "C:\\", "C:\\", "C:\\x", "C:/", "name", None]
    assert column(spark, ["/a/b/c"], "string", P.ancestors) == [["/a/b/c", "/a/b", "/a", "/"]]
    assert column(spark, ["/", "/a/b", "C:\\x\\", "c:/"], "string", X.mount_name) == ["__root", "a_b", "C_x", "c"]


def test_ids(spark):
    assert column(spark, ["xn12_ab", "x7", "xa_1", "x_", "n5b_1"], "string", X.epoch_number) == [12, 7, None, None, None]
    assert [tuple(x) if x else None for x in column(spark, ["xr1_22_z", "xr1_z"], "string", X.epoch_range)] == [(1, 22), None]
    assert column(spark, ["aabb", "xaabb", "aab", "gg", "A1", ""], "string", X.content_prefix) == ["", "x", None, None, None, None]
    assert [tuple(x) for x in column(spark, ["IIxab", "Zab", "ab"], "string", X.object_parts)] == [(2, False, "xab"), (0, True, "ab"), (0, False, "ab")]
    assert column(spark, ["0644", "0o755", "777"], "string", X.mode_bits) == [0o644, 0o755, 0o777]
    assert column(spark, ["p-x-s1-c2", "p-c1", "s1-c", None], "string", B.session_of) == ["s1", None, None, None]


def test_cron():
    at = dt.datetime(2024, 1, 31, 23, 59)
    assert X.cron_next("*/15 9-17 * * 1-5", at) == dt.datetime(2024, 2, 1, 9, 0)
    assert X.cron_next("0 0 29 2 * # leap", at) == dt.datetime(2024, 2, 29)
    assert X.cron_next("5 4 1 * 0", dt.datetime(2024, 3, 2)) == dt.datetime(2024, 3, 3, 4, 5)
    assert X.cron_next("0 0 31 2 *", at) is None
    for bad in ("* * *", "61 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            X.cron_next(bad, at)


def test_next_run_of_a_schedule():
    day = lambda d, h=0, m=0: dt.datetime(2024, 5, d, h, m)
    assert X.next_run(day(1), day(1, 3), interval=3_600, manual=True) is None
    assert X.next_run(day(1), day(1, 3)) is None and X.next_run(None, day(1, 3), cron=["bad line"]) is None
    assert X.next_run(day(1, 2, 30), day(1, 3), interval=3_600) == day(1, 3)  # 03:00 is now
    assert X.next_run(day(1, 2, 30), day(1, 2, 40), interval=3_600) == day(1, 3)
    assert X.next_run(None, day(1, 3), interval=3_600) == day(1, 3)
    assert X.next_run(day(1), day(1, 9), times=[8 * 60, 20 * 60]) == day(1, 20)
    assert X.next_run(day(1), day(1, 21), times=[8 * 60, 20 * 60]) == day(2, 8)
    assert X.next_run(day(1), day(1, 9), times=[20 * 60], cron=["30 9 * * *"]) == day(1, 9, 30)
    # 08:00 was missed and 20:00 is far: run now; not if the next run is near, nor if nothing was missed.
    assert X.next_run(day(1, 7), day(1, 9), times=[8 * 60, 20 * 60], run_missed=True) == day(1, 9)
    assert X.next_run(day(1, 7), day(1, 19, 45), times=[8 * 60, 20 * 60], run_missed=True) == day(1, 20)
    assert X.next_run(day(1, 8), day(1, 9), times=[8 * 60, 20 * 60], run_missed=True) == day(1, 20)


def test_names_and_hashes(spark):
    assert column(spark, ["a", "", "foobar", None], "string", X.fnv32a) == [0xE40C292C, 0x811C9DC5, 0xBF9CF968, None]
    assert column(spark, ["xw17", "xw", "xe17", None], "string", X.watermark_time) == [17, None, None, None]
    rel = lambda base: column(spark, ["/a/b/c", "/a/bc", "/a/b", None], "string", lambda c: X.relative_path(F.lit(base), c))
    assert rel("/a/b") == rel("/a/b/") == ["c", None, ".", None] and rel("/") == ["a/b/c", "a/bc", "a/b", None]


def test_reasons_by_root(spark):
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(f"m{i}", "h", "u", "/p", t(i), t(i), True, r, None) for i, r in enumerate(["a", "a", None, "b", None])]
    why = [("m1", "latest-1"), ("m0", "latest-2"), ("m0", "daily-1"), ("m1", "daily-1"), ("m4", "hourly-1"), ("zz", "x")]
    got = S.reasons_by_root(spark.createDataFrame(rows, SNAP), spark.createDataFrame(why, "manifest_id string, reason string")).collect()
    assert {r.root_oid: (r.first_id, r.n, r.reasons) for r in got} == {"a": ("m0", 2, ["daily-1", "latest-1", "latest-2"]), "b": ("m3", 1, []), None: ("m2", 2, ["hourly-1"])}


# -- wildcards ----------------------------------------------------------------------------------
WILDCARDS = {
    "*.iso": "/disk.iso /img/deep/disk.iso | /disk.iso.part /iso",
    "/logs": "/logs | /srv/logs /logs2",
    "srv/*.db": "/srv/main.db | /x/srv/main.db /srv/a/main.db",
    "**/cache": "/cache /a/cache /a/b/cache | /a/mycache",
    "srv/**/tmp": "/srv/tmp /srv/x/tmp /srv/x/y/tmp | /srv/xtmp /srvx/tmp",
    "home/**": "/home/ann /home/ann/notes | /home /homes/x",
    "snap-??.log": "/snap-07.log /a/snap-xy.log | /snap-7.log /snap-/7.log",
    "pack**9": "/pack9 /packs-19 | /pack/9",
    "[k-m]x": "/lx /a/kx | /nx /x",
    "part[!0-4]": "/part7 /part- | /part3 /part/",
    "[[:upper:][:digit:]]z": "/Qz /4z | /qz /z",
    "[]-]end": "/]end /-end | /end",
    "a\\*b": "/a*b | /axb",
    "[\\]q]s": "/]s /qs | /rs",
    "v1.2": "/v1.2 | /v1x2",
    "keep\\ ": "/keep\u00a0".replace("\u00a0", "_") + " | /keep",
    "!old": "/new /a/older | /old /a/old",
    "**": "/x /x/y | ",
    "": " | /x",
}


def test_wildcards(spark):
    rows = [(p, path, side == 0) for p, both in WILDCARDS.items() for side, part in enumerate(both.split("|")) for path in part.split() if p != "keep\\ "]
    rows += [("keep\\ ", "/keep ", True), ("keep\\ ", "/keep", False), ("  trim  ", "/trim", True)]
    df = spark.createDataFrame(rows, "p string, path string, want boolean")
    hit = F.coalesce(*[F.when(F.col("p") == p, W.compiled(p).matches(F.col("path"), F.lit(True))) for p in {r[0] for r in rows}])
    assert [tuple(r) for r in df.filter(hit != F.col("want")).collect()] == [] and df.filter(hit.isNull()).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.text("ab/*?!\\[]-.", max_size=8))
def test_any_pattern_is_a_rule_or_an_error(spark, text):
    try:
        rule = W.compiled(text)
    except ValueError:
        return
    assert column(spark, ["/a/b"], "string", lambda c: rule.matches(c, F.lit(True)))[0] in (True, False)


def test_wildcard_options(spark):
    assert column(spark, ["/Foo"], "string", lambda c: W.compiled("foo", ignore_case=True).matches(c, F.lit(False))) == [True]
    assert column(spark, ["/a"], "string", lambda c: W.compiled("a/").matches(c, F.lit(False))) == [False]
    assert column(spark, ["/base/x/a", "/a"], "string", lambda c: W.compiled("a", base="/base").matches(c, F.lit(False))) == [True, False]
    for bad in ("[a", "a\\", "[[:none:]]"):
        with pytest.raises(ValueError):
            W.compiled(bad)
    rules = [W.compiled("*.o"), W.compiled("!keep.o"), W.compiled("tmp/")]
    paths = ["/a.o", "/keep.o", "/tmp/x", "/src/a.c", None]
    assert column(spark, paths, "string", lambda c: W.pruned(rules, c, F.lit(False))) == [True, False, True, False, None]


# -- listings -----------------------------------------------------------------------------------
def test_ignore_files_of_folders(spark):
    from moraine.operators import listing as L

    kind = "tree string, path string, is_folder boolean, size int"
    paths = ["/a.log", "/keep.log", "/build", "/build/x", "/src", "/src/a.log", "/src/new", "/src/new/a.log", "/src/new/b.tmp", "/src/new/old/c.tmp", "/Build/x"]
    folders = {"/build", "/src", "/src/new", "/src/new/old", "/Build"}
    e = spark.createDataFrame([(t, p, p in folders, 1) for t in ("t", "u") for p in paths] + [(None, "/a.log", False, 1), ("t", None, None, 1)], kind)
    lines = [("t", "", 0, "# logs\n*.log\n\n!keep.log\nbuild/\n[bad"), ("t", "/src/new", 0, "*.tmp\n!a.log"), ("u", "/src/new", 1, "*")]
    rules = L.folder_rules(spark.createDataFrame(lines, "tree string, folder string, place int, line string"))
    left = lambda tree, **k: sorted(r.path for r in L.without_ignored(e, rules, **k).collect() if r.tree == tree and r.path)
    assert left("t") == sorted(["/keep.log", "/src", "/src/new", "/src/new/a.log", "/Build/x"])
    assert left("u") == sorted(p for p in paths if not p.startswith("/src/new/"))
    assert L.without_ignored(e, rules).filter("tree is null or path is null").count() == 2
    reset = spark.createDataFrame([("t", "/src/new")], "tree string, folder string")
    own = L.folder_rules(spark.createDataFrame([("t", "", 0, "*.log"), ("t", "/src/new", 0, "*.tmp")], "tree string, folder string, place int, line string"))
    got = {r.path for r in L.without_ignored(e, own, reset).filter("tree = 't'").collect() if r.path}
    assert "/src/new/a.log" in got and "/src/a.log" not in got and "/src/new/b.tmp" not in got
    assert L.without_ignored(e.limit(0), rules).count() == 0 and L.without_ignored(e, rules.limit(0)).count() == e.count()


def test_cache_folders_devices_and_sizes(spark):
    from moraine.operators import listing as L

    e = spark.createDataFrame([("t", p, f, d, s) for p, f, d, s in [("/c", True, 1, 0), ("/c/x", False, 1, 5), ("/m", True, 2, 0), ("/m/y", False, 2, 5), ("/z", False, 1, 50), ("/w", False, None, None)]] + [(None, "/q", False, 9, 9)], "tree string, path string, is_folder boolean, device int, file_size bigint")
    marks = L.cache_folders(spark.createDataFrame([("t", "/c/CACHEDIR.TAG", b"Signature: 8a477f597d28d172789f06886806bc55\n# x"), ("t", "/m/CACHEDIR.TAG", b"none"), ("t", "/z", None)], "tree string, path string, content binary"))
    assert [tuple(r) for r in marks.collect()] == [("t", "/c")]
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(L.without_below(e, marks)) == {"/c", "/m", "/m/y", "/z", "/w", "/q"}
    assert paths(L.on_root_device(e, spark.createDataFrame([("t", 1)], "tree string, root_device int"))) == {"/c", "/c/x", "/z", "/w", "/q"}
    assert paths(L.within_size(e, 10)) == {"/c", "/c/x", "/m", "/m/y", "/w", "/q"} and L.within_size(e, 0).count() == e.count()


# -- trees and policies -------------------------------------------------------------------------
def test_walk_shares_folders_and_ends_on_cycles(spark):
    edge = spark.createDataFrame([("r", "d", "a"), ("r", "f", "c1"), ("a", "d", "b"), ("b", "d", "a"), ("b", "f", "c2"), ("z", "f", "c3"), ("a", "d", None)], "dir_oid string, entry_type string, key string")
    found = trees.reachable_folders(spark.createDataFrame([("r",), ("r",), (None,)], "key string"), edge)
    assert sorted(r.key for r in found.collect()) == ["a", "b", "r"]
    assert {r.key for r in trees.reachable_contents(found, edge).collect()} == {"c1", "c2"}


def test_diff_counts(spark):
    kind = "p string, entry_type string, key string, file_size bigint, file_mode string, mod_time bigint, user_id bigint, group_id bigint"
    a = spark.createDataFrame([("1", "f", "k", 1, "644", 1, 0, 0), ("2", "f", "k", 1, "644", 1, 0, 0), ("3", "f", "k", 1, None, 1, 0, 0), ("4", "f", "k", 1, "644", 1, 0, 0), ("5", "f", "k", 1, "644", 1, 0, 0)], kind)
    b = spark.createDataFrame([("2", "f", "x", 1, "644", 1, 0, 0), ("3", "f", "y", 1, "644", 1, 0, 0), ("4", "f", "k", 1, "644", 1, 0, 5), ("5", "f", "k", 1, "644", 1, 0, 0), ("6", "f", "k", 1, "644", 1, 0, 0), ("7", "f", None, 1, "644", 1, 0, 0)], kind)
    r = trees.diff_stats(trees.diff(a, b, ["p"]), []).first()
    assert (r.added, r.removed, r.modified, r.same_content_touched) == (2, 1, 3, 1)


def test_policy_resolution(spark):
    src = "host_name string, user_name string, source_path string"
    sources = spark.createDataFrame([("h", "u", "/a/b"), ("g", "u", "/a"), ("h", None, None)], src)
    rows = [("pab", "h", "u", "/a/b"), ("pa", "h", "u", "/a"), ("pu", "h", "u", None), ("ph", "h", None, None), ("pg", None, None, None), ("po", "h", "v", "/a")]
    pol = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "policy_id string, " + src)
    h = P.hierarchy(sources, pol)
    chain = lambda host: [r.policy_id for r in h.filter(h.host_name == host).filter("user_name = 'u'").orderBy("place").collect()]
    assert chain("h") == ["pab", "pa", "pu", "ph", "pg"] and chain("g") == ["pg"]
    values = spark.createDataFrame([("pab", None, None, 1), ("pa", 3, True, None), ("pg", 9, None, 8), ("ph", 5, None, 5), ("pu", None, None, None), ("po", 1, None, 1)], "policy_id string, x int, no_parent boolean, y int")
    got = {(r.host_name, r.user_name): (r.x, r.x_from, r.y, r.z) for r in P.effective(h, values.withColumn("z", F.lit(None).cast("int")), ["x", "y", "z"], {"z": 7}).collect()}
    assert got[("h", "u")] == (3, "pa", 1, None)
    assert got[("g", "u")] == (9, "pg", 8, 7)


def test_access(spark):
    users = spark.createDataFrame([("a@h",), ("b@h",), ("a@g",), ("c@x",)], "user_at_host string")
    rules = spark.createDataFrame([("a@h", 3), ("*@h", 1), ("a@*", 2), ("a@*", 1)], "pattern string, access int")
    assert {tuple(r) for r in P.effective_access(users, rules).collect()} == {("a@h", 3), ("b@h", 1), ("a@g", 2)}
    assert P.effective_access(users, rules.limit(0)).count() == 0


# -- chunks -------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from(["buzhash", "rabinkarp"]))
def test_cut_points_cover_the_text(raw, kind):
    ends = K.cut_points(raw, 256, kind)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(raw) and all(s <= 512 for s in sizes) and all(s >= 128 for s in sizes[:-1])
    assert sum(sizes) == len(raw) and (len(raw) == 0) == (sizes == [0])


def test_cut_points_move_with_the_content():
    rnd = random.Random(5)
    raw = rnd.randbytes(200_000)
    a, b = K.cut_points(raw, 1024), K.cut_points(b"some bytes in front" + raw, 1024)
    shifted = {x - 19 for x in b}
    assert len(set(a) & shifted) > 0.9 * len(a) and 1100 < len(raw) / len(a) < 1500


def test_chunks_hashes_and_round_trip(spark):
    texts = ["", "x", "backup " * 400, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    fixed = K.fixed_chunks(df, "text", 1000).select("doc_id", "chunk_no", "start", "length", "chunk").collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in fixed if r.doc_id == i), key=lambda r: r.chunk_no)
        assert "".join(r.chunk for r in own) == (t or "") and (len(own) >= 1) == (t is not None)
    cdc = K.content_defined_chunks(df, "doc_id", "text", 256).collect()
    assert sum(r.length for r in cdc) == 2801 and {r.doc_id for r in cdc} == {0, 1, 2}
    for name in K.HASHES:
        h = [r.h for r in K.hashed(df, "text", "h", name, b"k").orderBy("doc_id").collect()]
        assert h[3] is None and len(set(h)) == 4 and len(h[0]) in (32, 56, 64)
    for name in K.COMPRESSORS:
        rows = K.decompressed(K.compressed(df, "text", "c", name), "c", "d", name).orderBy("doc_id").collect()
        assert [None if r.d is None else bytes(r.d).decode() for r in rows] == [None, None, texts[2], None]


def test_archives(spark, tmp_path):
    import tarfile
    import zipfile

    from moraine.sources import sinks

    df = spark.createDataFrame([(f"d{i}/f", f"text {i}") for i in range(20)] + [(None, "x"), ("y", None)], "p string, t string")
    for kind in ("tar", "zip"):
        rows = sinks.write_archives(df, "p", "t", str(tmp_path / kind), kind, 3).collect()
        found = {}
        for r in rows:
            at = tmp_path / kind / r.archive
            if kind == "tar":
                with tarfile.open(at) as f:
                    found |= {m.name: f.extractfile(m).read() for m in f.getmembers()}
            else:
                with zipfile.ZipFile(at) as f:
                    found |= {n: f.read(n) for n in f.namelist()}
        assert found == {f"d{i}/f": f"text {i}".encode() for i in range(20)} and sum(r.files for r in rows) == 20
    assert sinks.address("s3", "b", "x") == "s3a://b/x"
    with pytest.raises(ValueError):
        sinks.address("rclone", "b")


def test_token_bucket():
    from moraine.sources.throttle import TokenBucket

    b = TokenBucket(10, 1.0)
    assert b.wait(0, 10) == 0 and b.wait(0, 5) == 0.5
    assert b.wait(1.0, 5) == 0 and b.wait(100, 10) == 0 and b.wait(100, 10) == 1.0
