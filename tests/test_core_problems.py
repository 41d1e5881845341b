"""The core problems' operators on small tables with nulls, ties, repeats, clashes and no rows."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.functions.bitmaps import Bitmap
from moraine.operators import cow, history, orphans, ranking
from moraine.session import scratch_path

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


MANIFESTS = "manifest_id string, host_name string, user_name string, source_path string, start_time timestamp_ntz, end_time timestamp_ntz, incomplete_reason string, root_entry struct<object_id:string>, modified_at timestamp_ntz, deleted boolean, idx int, h string"
ENTRIES = "manifest_id string, entry_path string, entry_type string, file_mode string, file_size bigint, mod_time timestamp_ntz, user_id bigint, group_id bigint, object_id string, listed_at timestamp_ntz, idx int, next_id string"


def manifest(i, start, host="h", reason=None, deleted=False, modified=0, end=0):
    return (i, host, None, "/p", at(start), at(end), reason, ("kroot",), at(modified), deleted, 7, "x")


def entry(m, path, mode="0644", size=1, oid="o", listed=0):
    return (m, path, "f", mode, size, None, 1, None, oid, at(listed), 9, "y")


def test_snapshot_changes(spark):
    ms = [manifest("a", 1), manifest("b", 2), manifest("c", 3), manifest("d", 4, reason="canceled"), manifest("n", None), manifest("e", 5, modified=1), manifest("e", 6, deleted=True, modified=2), manifest("z", 1, host=None), manifest("empty", 2.5), manifest("a", 1)]
    es = [entry("a", "x"), entry("a", "x"), entry("a", "y"), entry("a", "m"), entry("b", "x", mode="644"), entry("b", "m", size=None), entry("c", "x", oid=None), entry("c", "y"), entry("c", "m", size=None), entry("d", "x"), entry("z", "x"), entry(None, "x"), entry("c", None), entry("a", "y", listed=1)]
    m, e = spark.createDataFrame(ms, MANIFESTS), spark.createDataFrame(es, ENTRIES)
    want = {("b", "y", "removed"), ("b", "m", "changed"), ("c", "x", "changed"), ("c", "y", "added")}
    for heavy in (100, 1):
        got = history.snapshot_changes(m, e, heavy=heavy).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = history.snapshot_changes(m.limit(0), e.limit(0))
    assert none.columns == ["manifest_id", "entry_path", "diff_kind"] and none.count() == 0
    assert history.snapshot_changes(m, e.limit(0)).count() == 0
    counts = {(r.manifest_id, r.diff_kind): r.file_entries for r in history.change_counts(history.snapshot_changes(m, e)).collect()}
    assert counts == {("b", "removed"): 1, ("b", "changed"): 1, ("c", "changed"): 1, ("c", "added"): 1}


def test_modes(spark):
    df = spark.createDataFrame([("0644",), ("0o644",), ("644",), ("000",), ("",), (None,), ("0o0",)], "m string")
    assert [r[0] for r in df.select(history.canonical_mode(df.m)).collect()] == ["644", "644", "644", "0", "", None, "0"]


@pytest.mark.parametrize("descending", [False, True])
def test_rank_within_splits_heavy_groups(spark, descending):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice([None, "b", "c"]), rnd.choice([None, *range(40)]), i, 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, k int, _n int")
    got = {r.k: r["rank"] for r in ranking.rank_within(df, ["g"], ["v", "k"], descending=descending, heavy=100).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=descending)
        want |= {r[2]: i for i, r in enumerate(part, 1)}
    assert got == want


def feed(rows):
    return [(c, t, d, p, "z") for c, t, d, p in rows]


FEED = "content_id string, timestamp_seconds bigint, deleted boolean, pack_blob_id string, live string"


def winners(rows):
    best = {}
    for c, t, d, p in rows:
        if c is not None and t is not None:
            k = (t, not d, p is not None, p or "")
            if c not in best or k > best[c][0]:
                best[c] = (k, p)
    return {(c, p) for c, (k, p) in best.items() if k[1]}


@pytest.mark.parametrize("cuts", [(), (0.5,), (0.2, 0.2, 0.9)])
def test_feed_in_any_parts_gives_the_same_table(spark, cuts):
    rnd = random.Random(len(cuts))
    rows = [(rnd.choice([None, "hot", "hot", *map(str, range(30))]), rnd.choice([None, *range(12)]), rnd.choice([True, False, None]), rnd.choice([None, "p1", "p2"])) for _ in range(400)]
    t = cow.BucketedTable(spark, scratch_path(spark, "t"), "content_id", cow.CONTENT_ORDER, buckets=5)
    marks = [0, *(int(c * len(rows)) for c in cuts), len(rows)]
    for a, b in zip(marks, marks[1:], strict=False):
        t.apply(cow.content_feed(spark.createDataFrame(feed(rows[a:b]), FEED)))
    got = [tuple(r) for r in cow.alive_contents(t).collect()]
    assert set(got) == winners(rows) and len(got) == len(set(got))
    assert len(t.versions()) == len(marks) - 1


def test_only_touched_buckets_are_rewritten(spark):
    path = scratch_path(spark, "t")
    t = cow.BucketedTable(spark, path, "content_id", cow.CONTENT_ORDER, buckets=8)
    t.apply(cow.content_feed(spark.createDataFrame(feed([(str(i), 1, False, "p") for i in range(100)]), FEED)))
    before = t._manifest()["folders"]
    t.apply(cow.content_feed(spark.createDataFrame(feed([("5", 2, True, None)]), FEED)))
    after = t._manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.content_id for r in t.read(1).filter("live").collect()} - {r.content_id for r in cow.alive_contents(t).collect()} == {"5"}
    again = cow.BucketedTable(spark, path, "content_id", cow.CONTENT_ORDER, buckets=3)
    assert again.buckets == 8
    again.apply(cow.content_feed(spark.createDataFrame(feed([("5", 1, False, "old"), (None, 9, False, "p")]), FEED)))
    assert again.read().count() == 100 and "5" not in {r.content_id for r in cow.alive_contents(again).collect()}
    with pytest.raises(RuntimeError):
        again._commit(2, {})


def test_empty_feed(spark):
    t = cow.BucketedTable(spark, scratch_path(spark, "t"), "content_id", cow.CONTENT_ORDER)
    t.apply(cow.content_feed(spark.createDataFrame([], FEED)))
    assert cow.alive_contents(t).count() == 0
    t.apply(cow.content_feed(spark.createDataFrame(feed([("a", 1, False, "p")]), FEED)))
    t.apply(cow.content_feed(spark.createDataFrame([], FEED)))
    assert [tuple(r) for r in cow.alive_contents(t).collect()] == [("a", "p")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200_000), max_size=300), st.lists(st.integers(0, 200_000), max_size=300), st.booleans())
def test_bitmaps(a, b, dense):
    if dense:
        a = a + list(range(1000, 9000))
        b = b + list(range(500, 8800))
    x, y = Bitmap.of(np.array(a, np.int64), 200_001), Bitmap.of(np.array(b, np.int64), 200_001)
    assert x.decode().tolist() == sorted(set(a)) and len(x) == len(set(a))
    assert x.and_not(y).decode().tolist() == sorted(set(a) - set(b))
    assert (x | y).decode().tolist() == sorted(set(a) | set(b))


def test_orphans(spark):
    sec = int(T0.replace(tzinfo=dt.UTC).timestamp())
    h = 3600
    contents = [("c1", sec, False, "p1"), ("c1", sec - 40 * 24 * h, False, "p0"), ("c2", sec + h, False, "gone"), ("c3", sec, True, None), ("c4", sec + 5 * h, False, "pdel"), ("c5", None, False, "p1"), (None, sec, False, "p1"), ("c6", sec, False, None), ("c7", sec - h, False, "plate"), ("c1", sec, False, "p1")]
    packs = [("p1", 1, at(-1), False), ("pdel", 1, at(-2), False), ("pdel", None, at(2), True), ("plate", 1, at(0), False), ("p0", 1, None, False)]
    e = lambda oid, kind="f": ("n", kind, oid)
    dirs = [("kroot", [e("c1"), e("Ic2"), e("Zc3"), e("IIZc4"), e("c5"), e("kroot", "d"), e("kno", "d"), e(None), e("c1"), e("x9", "s"), e("c1", "q")], at(2), False), ("kroot", None, at(1), False), ("kdead", [e("zzz")], at(1), False), ("kdead", None, at(2), True)]
    ms = [manifest("m1", 1, end=1), manifest("m2", 1, end=0.5), manifest("m3", 1, deleted=True), ("m4", "h", None, "/p", at(1), None, None, ("kdead",), at(0), False, 1, "x"), ("m5", "h", None, "/p", at(1), None, None, None, at(0), False, 1, "x"), ("m6", "h", None, "/p", at(1), None, None, ("kroot",), at(0), False, 1, "x")]
    m = spark.createDataFrame(ms, MANIFESTS)
    d = spark.createDataFrame(dirs, "dir_oid string, entries array<struct<entry_name:string,entry_type:string,object_id:string>>, written_at timestamp_ntz, deleted boolean")
    p = spark.createDataFrame(packs, "blob_id string, blob_length bigint, blob_ts timestamp_ntz, deleted boolean")
    c = spark.createDataFrame(contents, "content_id string, timestamp_seconds bigint, deleted boolean, pack_blob_id string")
    want = {
        ("content_entries", "c2", "gone", "missing", "2024-01"), ("content_entries", "c4", "pdel", "deleted", "2024-01"), ("content_entries", "c7", "plate", "late", "2023-12"),
        ("dir_manifests", "kroot", "c3", "deleted", "2024-01"), ("dir_manifests", "kroot", "c4", "late", "2024-01"), ("dir_manifests", "kroot", "c5", "missing", "2024-01"),
        ("dir_manifests", "kroot", "kno", "missing", "2024-01"), ("dir_manifests", "kroot", "x9", "missing", "2024-01"),
        ("manifests", "m4", "kdead", "deleted", None), ("manifests", "m2", "kroot", "late", "2024-01"),
    }
    got = orphans.orphan_references(m, d, p, c, ranges=3).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    hot = orphans.orphan_references(m, d, p, c, heavy=0).collect()
    assert {tuple(r) for r in hot} == want and len(hot) == len(want)
    none = orphans.orphan_references(m, d.limit(0), p.limit(0), c.limit(0))
    assert {tuple(r)[:4] for r in none.collect()} == {("manifests", i, k, "missing") for i, k in (("m1", "kroot"), ("m2", "kroot"), ("m4", "kdead"), ("m6", "kroot"))}
    assert orphans.orphan_references(m.limit(0), d.limit(0), p.limit(0), c.limit(0)).count() == 0


@pytest.mark.parametrize("heavy", [100, 100_000])
@pytest.mark.parametrize("before", [False, True])
def test_running_values_and_neighbours(spark, heavy, before):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice([None, "b"]), rnd.choice([None, *range(30)]), i, rnd.choice([None, 1, 2, 5]), 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, t int, k int, v int, s int")
    got = {r.k: (r.s, r.last) for r in ranking.running_within(df, ["g"], ["t", "k"], sums={"s": "v"}, lasts={"last": "v"}, before=before, heavy=heavy).collect()}
    near = {r.k: r.p for r in ranking.neighbour(df, ["g"], ["t", "k"], {"p": "k"}, heavy=heavy).collect()}
    for g in {r[0] for r in rows}:
        total, last, prev = 0, None, None
        for _, _, k, v, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            now = (total + (v or 0), last if v is None else v)
            assert got[k] == ((total, last) if before else now) and near[k] == prev
            (total, last), prev = now, k
    assert ranking.running_within(df.limit(0), ["g"], ["t"], sums={"x": "v"}).count() == 0


def test_as_of_join_and_names(spark):
    from moraine.operators.joins import as_of_join, disambiguated

    left = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 5, 3), (None, 9, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 6, "z"), ("a", 5, None), (None, 1, "n")], "k string, t int, v string")
    assert {r.id: r.v for r in as_of_join(left, right, "k", "t", "v").collect()} == {1: "x", 2: "y", 3: None, 4: "n"}
    names = spark.createDataFrame([("1", "a"), ("2", "A"), ("3", "a (2)"), ("4", "b")], "name string, safe string")
    out = {r.name: r.safe for r in disambiguated(names, "name", "safe").collect()}
    assert out["1"] == "a" and len({v.lower() for v in out.values()}) == 4


def files_of(path):
    import pathlib

    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path.removeprefix("file://")).rglob("*.parquet")}


def test_untouched_buckets_keep_their_files_and_old_ones_go(spark):
    path = scratch_path(spark, "t")
    t = cow.BucketedTable(spark, path, "content_id", cow.CONTENT_ORDER, buckets=8)
    t.apply(cow.content_feed(spark.createDataFrame(feed([(str(i), 1, False, "p") for i in range(100)]), FEED)))
    before = files_of(path)
    t.apply(cow.content_feed(spark.createDataFrame(feed([("5", 2, False, "q")]), FEED)))
    after = files_of(path)
    assert before.items() <= after.items() and len({p.rsplit("/", 2)[1] for p in after.keys() - before.keys()}) == 1
    t.vacuum()
    kept = files_of(path)
    assert len(kept) < len(after) and t.versions() == [2] and t.read().count() == 100


def test_two_writers_cannot_both_commit(spark, monkeypatch):
    path = scratch_path(spark, "t")
    rows = cow.content_feed(spark.createDataFrame(feed([("a", 1, False, "p")]), FEED))
    cow.BucketedTable(spark, path, "content_id", cow.CONTENT_ORDER, buckets=2).apply(rows)
    files = files_of(path)
    late = cow.BucketedTable(spark, path, "content_id", cow.CONTENT_ORDER, buckets=2)
    monkeypatch.setattr(late, "versions", list)
    with pytest.raises(RuntimeError, match="another writer"):
        late.apply(rows)
    assert files_of(path) == files


def test_deliveries_are_merged(spark):
    t = cow.BucketedTable(spark, scratch_path(spark, "t"), "content_id", cow.CONTENT_ORDER)
    rows = feed([(str(i % 50), i % 7, i % 3 == 0, f"p{i % 4}") for i in range(400)])
    df = spark.createDataFrame(rows, FEED).withColumn("at", F.pmod(F.xxhash64("content_id", "timestamp_seconds"), F.lit(100))).withColumn("at", F.when(F.col("at") > 5, F.col("at")))
    assert t.apply_deliveries(cow.content_feed(df), "at") == 3
    one = cow.BucketedTable(spark, scratch_path(spark, "t"), "content_id", cow.CONTENT_ORDER)
    one.apply(cow.content_feed(df))
    assert sorted(t.read().collect()) == sorted(one.read().collect())
    assert cow.BucketedTable(spark, scratch_path(spark, "t"), "content_id", cow.CONTENT_ORDER).apply_deliveries(cow.content_feed(df.limit(0)), "at") == 1


def test_hot_keys_are_salted_on_both_sides(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(900)] + [(None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int")
    hot = ranking.HotKeys(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], heavy=100)
    left = df.withColumn("salt", hot.salt("v"))
    assert left.filter("k = 'hot'").select("salt").distinct().count() == ranking.SALTS
    assert left.filter("k <> 'hot'").agg(F.max("salt")).first()[0] == 0
    other = df.select("k").distinct().withColumn("salt", F.explode(hot.copies()))
    assert left.join(other, ["k", "salt"]).count() == 900


def test_slices_with_many_bounds(spark):
    df = spark.range(5_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000)).alias("t"), F.col("id").alias("k"))
    got = ranking.rank_within(df, ["g"], ["t", "k"], heavy=3).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (r.t, r.k))] == list(range(1, 5_001))
