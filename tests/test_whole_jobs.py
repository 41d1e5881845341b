"""Queries do the whole of their job: small literal tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from moraine.plans import registry
from tests.test_operators import INDEX, entry


def run(spark, base, name, **tables):
    for t, df in tables.items():
        df.write.parquet(f"{base}/{t}.parquet")
    return registry.queries()[name](spark, str(base)).collect()


def test_bins_are_filled_per_pack_kind(spark, tmp_path):
    rows = [entry(i, 1, packed=15 << 20) for i in ("0a", "1b", "2c", "x0", "y1")]
    got = {r.content_id: (r.kind, r.bin) for r in run(spark, tmp_path, "ix13_kind_bins", content_entries=spark.createDataFrame(rows, INDEX))}
    assert got == {"0a": ("p", 0), "1b": ("p", 0), "2c": ("p", 1), "x0": ("q", 0), "y1": ("q", 0)}


def listings(spark):
    """Three listings of one source: b goes; c comes; a folder turns into a file, which goes."""
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    m = [(f"m{n}", day(n), False, "h", "u", "/s", day(n), day(n), None) for n in (1, 2, 3)]
    e = [("m1", "a", "f", "k1"), ("m1", "b", "f", "k2"), ("m1", "d", "d", "k4"), ("m2", "a", "f", "k1"), ("m2", "d", "f", "k5"), ("m3", "a", "f", "k9"), ("m3", "c", "f", "k3")]
    manifests = spark.createDataFrame(m, "manifest_id string, modified_at timestamp_ntz, deleted boolean, host_name string, user_name string, source_path string, start_time timestamp_ntz, end_time timestamp_ntz, incomplete_reason string")
    entries = spark.createDataFrame([(*r, 1, "0644", day(1), 1, 1) for r in e], "manifest_id string, entry_path string, entry_type string, object_id string, file_size bigint, file_mode string, mod_time timestamp_ntz, user_id bigint, group_id bigint")
    return {"manifests": manifests, "snapshot_entries": entries}


def test_every_listing_is_held_against_the_one_before(spark, tmp_path):
    rows = run(spark, tmp_path, "jn07_all_diffs", **listings(spark))
    assert {r.pair: (r.added, r.removed, r.modified) for r in rows} == {"m2": (0, 1, 2), "m3": (1, 1, 1)}
    assert {r.pair: (r.n, r.cached) for r in run(spark, tmp_path, "jn09_all_cache_hits")} == {"m2": (2, 2), "m3": (2, 1)}
    assert {r.path for r in run(spark, tmp_path, "jn12_all_extra")} == {"m2:b", "m2:d", "m3:d"}


def test_small_indexes_become_one(spark):
    from moraine.operators import contents as C

    named = lambda i, *r: (*entry(*r)[:-1], i)
    large = [named("big", f"c{k}", 1) for k in range(100)]
    small = [*[named("s1", "c1", 5)] * 100, named("s1", "z", 1), named("s2", "z", 2, True)]
    got = C.combined_indexes(spark.createDataFrame(large + small, INDEX)).collect()
    assert sum(r.in_index == "big" for r in got) == 100
    assert {(r.content_id, r.timestamp_seconds, r.live) for r in got if r.in_index != "big"} == {("c1", 5, True), ("z", 2, False)}
    assert {r.in_index for r in C.combined_indexes(spark.createDataFrame(large + small[:101], INDEX)).collect()} == {"big", "s1"}


def test_manifests_are_compacted_from_16_contents_on(spark):
    from moraine.operators.state import compacted_manifests

    rows = [(f"k{i}", "a", i, False) for i in range(14)] + [("k14", "b", 1, True)]
    df = lambda r: spark.createDataFrame(r, "content string, manifest_id string, modified_at int, deleted boolean")
    assert {tuple(r) for r in compacted_manifests(df(rows)).collect()} == set(rows)
    got = [tuple(r) for r in compacted_manifests(df([*rows, ("k15", "c", 1, None)])).collect()]
    assert sorted(got) == [("compacted", "a", 13, False), ("compacted", "c", 1, False)]


def test_a_removed_link_changes_every_folder_above(spark):
    from moraine.operators import trees

    rows = [("kr", [("a", "d", "ka", 0), ("b", "d", "kb", 0), ("x", "d", "kx", 0)]), ("ka", [("c", "d", "Ikc", 0)]), ("kb", [("f", "f", "1", 5)]), ("kc", [("l", "s", "2", 1), ("f", "f", "3", 7)]), ("ke", [])]
    d = spark.createDataFrame(rows, "dir_oid string, entries array<struct<entry_name string, entry_type string, object_id string, file_size bigint>>")
    got = {r.dir_oid: r for r in trees.rewritten(d, F.col("entry_type") == "s").collect()}
    assert {k for k, r in got.items() if r.new_oid == k} == {"kb", "ke"} and len(got) == 5
    assert {k: (r.files, r.bytes, r.folders) for k, r in got.items()} == {"kr": (2, 12, 4), "ka": (1, 7, 2), "kb": (1, 5, 1), "kc": (1, 7, 1), "ke": (0, 0, 1)}
    text = '{"entries":[{"entry_name":"c","entry_type":"d","object_id":"%s","file_size":0}]}' % got["kc"].new_oid
    assert got["ka"].fingerprint == hashlib.sha256(text.encode()).hexdigest()
    loop = spark.createDataFrame([("k1", [("a", "d", "k2", 0)]), ("k2", [("a", "d", "k1", 0)])], d.schema)
    with pytest.raises(ValueError):
        trees.rewritten(loop, F.col("entry_type") == "s")


def test_deep_paths_keep_the_policies_of_all_folders_above(spark):
    from moraine.operators import policies as P

    kind = "host_name string, user_name string, source_path string"
    s = spark.createDataFrame([("h", "u", "/a" * 80), ("h", "u", "/a"), ("h", "u", None)], kind)
    pol = spark.createDataFrame([("root", "h", "u", "/"), ("user", "h", "u", None), ("all", None, None, None)], f"policy_id string, {kind}")
    got = {(r.source_path, r.policy_id): r.place for r in P.hierarchy(s, pol).collect()}
    assert got == {("/a" * 80, "root"): 80, ("/a" * 80, "user"): 82, ("/a" * 80, "all"): 84, ("/a", "root"): 1, ("/a", "user"): 65, ("/a", "all"): 67, (None, "user"): 65, (None, "all"): 67}


def test_a_folder_in_itself_is_listed_but_not_entered(spark):
    from moraine.operators import trees

    edge = spark.createDataFrame([("a", "x", "d", "b", 0), ("b", "y", "d", "a", 0), ("b", "f", "f", "c", 3)], "dir_oid string, entry_name string, entry_type string, key string, file_size bigint")
    got = trees.paths_below(spark.createDataFrame([("a",)], "key string"), edge).collect()
    assert {(r.path, r.depth) for r in got} == {("/x", 1), ("/x/y", 2), ("/x/f", 2)}


def test_paths_are_resolved_name_by_name(spark):
    from moraine.operators import trees

    edge = spark.createDataFrame([("r", "a", "d", "ka", 0), ("ka", "b", "d", "kb", 0), ("kb", "c", "f", "c1", 3), ("r", "a", "f", "c2", 3)], "dir_oid string, entry_name string, entry_type string, key string, file_size bigint")
    asked = spark.createDataFrame([("r", "a/b/c"), ("r", "/a/"), ("r", ""), ("r", "a/c"), ("r", "a/b/c/d"), (None, "a"), ("r", None), ("z", "a")], "root string, path string")
    got = {(r.path, r.entry_type, r.key) for r in trees.resolved(asked, edge).collect()}
    assert got == {("a/b/c", "f", "c1"), ("/a/", "d", "ka"), ("/a/", "f", "c2"), ("", "d", "r")}


def test_indirect_objects_of_several_levels(spark):
    from moraine.operators import chunks as K
    from moraine.operators import trees

    sizes = {"one": 1, "two": 2, "nine": 9, "ten": 10, "many": 100}
    rows = [(k, i, i * 5, 5, f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    objects, links = K.seek_trees(spark.createDataFrame(rows, "key string, chunk_no int, start int, length int, content_id string"), "key", 3)
    o = {r.key: r for r in objects.collect()}
    assert {k: (r.depth, r.length) for k, r in o.items()} == {"one": (0, 5), "two": (1, 10), "nine": (2, 45), "ten": (3, 50), "many": (5, 500)}
    assert o["one"].object_id == "one0" and o["many"].object_id.startswith("IIIIIx")
    start = spark.createDataFrame([(o["many"].object_id.lstrip("I"),), ("one0",)], "key string")
    behind = {r.key for r in trees.backing_contents(start, links).collect()}
    assert {k for k in behind if not k.startswith("x")} == {f"many{i}" for i in range(100)} | {"one0"}
    index = spark.createDataFrame([(k, k != "many99", "p" if k != "many5" else "gone") for k in behind - {"one0"}], "content_id string, live boolean, pack_blob_id string")
    state = lambda df: {r.object_id: r.state for r in trees.verified(objects, links, df, spark.createDataFrame([("p",)], "blob_id string")).filter(F.col("object_id") == o["many"].object_id).collect()}
    assert state(index) == {o["many"].object_id: "deleted content"}
    assert state(index.filter("content_id != 'many99'")) == {o["many"].object_id: "no content"}
    assert state(index.withColumn("live", F.lit(True))) == {o["many"].object_id: "no pack"}
    # Files of a folder: what lies behind an indirect one is in use.
    edge = spark.createDataFrame([("r", "f", "f", o["nine"].object_id.lstrip("I"), 45)], "dir_oid string, entry_name string, entry_type string, key string, file_size bigint")
    used = trees.reachable_contents(spark.createDataFrame([("r",)], "key string"), edge, links)
    assert {f"nine{i}" for i in range(9)} < {r.key for r in used.collect()}
    assert K.seek_trees(spark.createDataFrame([], "key string, chunk_no int, start int, length int, content_id string"), "key")[0].count() == 0


def test_restored_files_stay_below_their_folder(spark, tmp_path):
    from moraine.sources import sinks

    df = spark.createDataFrame([("a/x", b"1"), ("a/b/c/y", b"22"), (None, b"3"), ("z", None)], "p string, c binary")
    got = {(r.path, r.bytes, r.placeholder) for r in sinks.restore(df, "p", "c", f"file://{tmp_path}/out", depth=1).collect()}
    assert got == {("a/x", 1, False), ("a/b/c/y", 2, True)}
    assert (tmp_path / "out/a/x").read_bytes() == b"1" and "size" in (tmp_path / "out/a/b/c/y.placeholder").read_text()
    for bad in ("../x", "a/../../x", "/"):
        with pytest.raises(ValueError):
            sinks._below(bad)


def test_scratch_is_removed(spark):
    import pathlib

    from moraine.session import materialise, remove_scratch

    path = materialise(spark.range(3), "t").inputFiles()[0].removeprefix("file://")
    assert pathlib.Path(path).exists()
    remove_scratch(spark)
    assert not pathlib.Path(path).exists()
