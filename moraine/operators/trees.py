"""Directory trees: walks, roll-ups, diffs, reachability, garbage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.wildcards import folders_above
from moraine.operators.orphans import object_key
from moraine.operators.ranking import rank_within
from moraine.session import materialise, scratch_path

#: Entries hashed together in a fingerprint.
HASH_RUN = 4_096


def edges(directories: DataFrame) -> DataFrame:
    """``dir_oid, entry_name, entry_type, object_id, key, file_size`` of every entry (SC18)."""
    e = directories.select("dir_oid", F.explode("entries").alias("e"))
    return e.select("dir_oid", "e.entry_name", "e.entry_type", "e.object_id", object_key(F.col("e.object_id")).alias("key"), "e.file_size", "e.file_mode", "e.mod_time", "e.user_id", "e.group_id")


def walked(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct ``key`` reachable from ``starts`` (``key``) over ``steps`` (``source, target``), the
    starts included.

    Level by level: the new keys of a level are those not seen before, written below the shared
    folder so that the lineage stays short. Each key is expanded once, and cycles end by
    themselves. ``steps`` is read once per level: pass a written table.
    """
    front = materialise(starts.select("key").filter("key is not null").distinct(), "walk")
    seen, down = front, steps.filter("source is not null and target is not null")
    while True:
        nxt = front.join(down, front["key"] == down["source"]).select(F.col("target").alias("key")).distinct().join(seen, "key", "left_anti")
        front = materialise(nxt, "walk")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def reachable_folders(roots: DataFrame, edge: DataFrame) -> DataFrame:
    """Distinct folder keys below the roots, the roots included (GR01, JN04)."""
    down = edge.filter("entry_type = 'd' and key is not null").select(F.col("dir_oid").alias("source"), F.col("key").alias("target")).distinct()
    return walked(roots, materialise(down, "folders"))


def backing_contents(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct content keys behind objects (GR04): of an indirect one its seek tables of all levels
    and the chunks they list, of any other itself. ``objects`` has ``key``, ``links`` the entries
    of seek tables (``node, child``). A content without entries in ``links`` has nothing behind it."""
    steps = links.select(F.col("node").alias("source"), object_key(F.col("child")).alias("target")).distinct()
    return walked(objects, materialise(steps, "links"))


def reachable_contents(folders: DataFrame, edge: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Distinct content keys of the files and links in the folders (JN04), with all that lies behind
    indirect objects where their seek tables are given."""
    files = edge.filter("entry_type in ('f', 's') and key is not null")
    keys = files.join(folders.select(F.col("key").alias("dir_oid")), "dir_oid", "left_semi").select("key").distinct()
    return keys if links is None else backing_contents(keys, links)


def verified(objects: DataFrame, links: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """State of each object by its worst content (JN06): ``no content``, ``deleted content``, ``no
    pack`` or ``ok``. ``objects`` has ``object_id``; every content behind it is looked up, seek
    tables included. ``index`` has ``content_id, live, pack_blob_id``, ``packs`` ``blob_id``."""
    start = objects.select("object_id", object_key(F.col("object_id")).alias("key")).filter("key is not null").distinct()
    steps = materialise(links.select("node", object_key(F.col("child")).alias("child")).distinct(), "links")
    level = materialise(start, "verify")
    every = level
    while True:
        nxt = level.join(steps, level["key"] == steps["node"]).select("object_id", F.col("child").alias("key")).distinct().join(every, ["object_id", "key"], "left_anti")
        level = materialise(nxt, "verify")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    c = index.select(F.col("content_id").alias("key"), "live", F.col("pack_blob_id").alias("blob_id"), F.lit(True).alias("_c"))
    b = packs.select("blob_id", F.lit(True).alias("_b")).distinct()
    looked = every.select("key").distinct().join(c, "key", "left").join(b, "blob_id", "left")
    bad = looked.select("key", F.when(F.col("_c").isNull(), 3).when(~F.col("live"), 2).when(F.col("_b").isNull(), 1).otherwise(0).alias("_s"))
    worst = every.join(bad, "key").groupBy("object_id").agg(F.max("_s").alias("_s"))
    names = F.array(*[F.lit(x) for x in ("ok", "no pack", "deleted content", "no content")])
    return worst.select("object_id", F.get(names, F.col("_s")).alias("state"))


def resolved(paths: DataFrame, edge: DataFrame) -> DataFrame:
    """What each path of names below a root stands for (GR02): ``root, path, entry_type, key``.
    ``paths`` has ``root`` (a folder key) and ``path`` (names joined with slashes; empty names are
    skipped, no name is the root itself). One join on folder and name per level, for the paths
    asked for only; a path that isn't there has no row, one whose name is there twice has two."""
    names = F.filter(F.split("path", "/"), lambda x: x != "")
    level = materialise(paths.filter("root is not null and path is not null").distinct().select("root", "path", names.alias("_names"), F.lit("d").alias("entry_type"), F.col("root").alias("key")), "resolve")
    deepest = level.agg(F.max(F.size("_names"))).first()[0] or 0
    done = level.filter("size(_names) = 0")
    for i in range(deepest):
        at = level.filter((F.size("_names") > i) & (F.col("entry_type") == "d")).select("root", "path", "_names", F.col("key").alias("dir_oid"), F.get("_names", F.lit(i)).alias("entry_name"))
        level = materialise(at.join(edge.select("dir_oid", "entry_name", "entry_type", "key").distinct(), ["dir_oid", "entry_name"]).select("root", "path", "_names", "entry_type", "key"), "resolve")
        done = done.unionByName(level.filter(F.size("_names") == i + 1))
    return done.drop("_names")


def paths_below(roots: DataFrame, edge: DataFrame) -> DataFrame:
    """``root, path, entry_type, key, file_size, depth`` of every entry below each root (GR02,
    GR05): a root is listed once however many snapshots have it. A folder that lies in itself is
    listed but not entered again, so every listing ends. ``edge`` is read once per level: pass a
    written table."""
    level = roots.select(F.col("key").alias("root"), F.col("key").alias("at"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.array("key").alias("_on")).filter("root is not null").distinct()
    out = None
    while True:
        rows = level.join(edge, level["at"] == edge["dir_oid"]).select("root", F.concat("path", F.lit("/"), "entry_name").alias("path"), "entry_type", "key", "file_size", (F.col("depth") + 1).alias("depth"), "_on")
        rows = materialise(rows, "paths")
        if rows.isEmpty():
            return (rows if out is None else out).drop("_on")
        out = rows if out is None else out.unionByName(rows)
        level = rows.filter((F.col("entry_type") == "d") & F.col("key").isNotNull() & ~F.array_contains("_on", F.col("key"))).select("root", F.col("key").alias("at"), "path", "depth", F.array_append("_on", F.col("key")).alias("_on"))


def rolled_up(files: DataFrame, keys: Sequence[str], path: str, size: str) -> DataFrame:
    """Files and bytes below every folder of every path (AG07): each file is counted for all
    folders above it, without recursion."""
    p = F.concat(F.lit("/"), F.regexp_replace(F.col(path), "^/", ""))
    folders = F.array_union(F.array(F.lit("/")), folders_above(p))
    return files.select(*keys, F.explode(folders).alias("folder"), F.col(size).alias("_s"), "entry_type", "mod_time").groupBy(*keys, "folder").agg(F.sum("_s").alias("bytes"), F.count(F.when(F.col("entry_type") == "f", 1)).alias("files"), F.count(F.when(F.col("entry_type") == "s", 1)).alias("links"), F.max("mod_time").alias("last_change"))


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of two trees side by side (JN07): ``status`` is added, removed, changed (another
    content), touched (same content, other metadata) or same, with a flag per kind of metadata.
    ``keys`` end with the path. Entries need ``entry_type, key, file_size, file_mode, mod_time,
    user_id, group_id``; a null equals a null."""
    cols = ["entry_type", "key", "file_size", "file_mode", "mod_time", "user_id", "group_id"]
    a = left.select(*keys, F.struct(*cols).alias("a"))
    b = right.select(*keys, F.struct(*cols).alias("b"))
    both = a.join(b, list(keys), "full_outer")
    other = lambda *cs: ~_all_equal(cs)
    flags = {"other_mode": other("file_mode"), "other_time": other("mod_time"), "other_size": other("file_size"), "other_owner": other("user_id", "group_id"), "other_type": other("entry_type")}
    both = both.withColumns({k: F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), v) for k, v in flags.items()})
    meta = F.col("other_mode") | F.col("other_time") | F.col("other_size") | F.col("other_owner") | F.col("other_type")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(other("key"), "changed").when(meta, "touched").otherwise("same")
    return both.withColumn("status", status).withColumn("touched", F.coalesce(meta, F.lit(False)))


def _all_equal(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def diff_stats(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of a diff (JN07). A file with other content and other metadata counts twice as
    modified, one with other content only once, one with other metadata only as touched."""
    s = F.col("status")
    twice = F.when(s == "changed", F.lit(1) + F.col("touched").cast("int")).otherwise(0)
    return rows.groupBy(*group).agg(F.count(F.when(s == "added", 1)).alias("added"), F.count(F.when(s == "removed", 1)).alias("removed"), F.sum(twice).alias("modified"), F.count(F.when(s == "touched", 1)).alias("same_content_touched"))


def gc_classes(index: DataFrame, used: DataFrame, now: int, min_age: int, system_prefix: str = "m") -> DataFrame:
    """Fate of every content, tombstones included (JN03): ``system``, ``in use`` (``undelete`` if
    it is deleted), ``too recent`` or ``unused``. ``used`` has the content keys in use."""
    flag = used.select(F.col("key").alias("content_id"), F.lit(True).alias("_u")).distinct()
    u = F.coalesce("_u", F.lit(False))
    fate = F.when(F.col("content_id").startswith(system_prefix), "system").when(u & F.col("live"), "in use").when(u, "undelete").when(F.lit(now) - F.col("timestamp_seconds") < min_age, "too recent").otherwise("unused")
    return index.join(flag, "content_id", "left").withColumn("fate", fate).drop("_u")


def storage_stats(listed: DataFrame, contents: DataFrame, source: Sequence[str], seq: str) -> DataFrame:
    """New objects, contents and bytes of each snapshot in its source's order (AG09): an object or
    content belongs to the first snapshot that has it. ``listed`` has source, seq, key, file_size."""
    first = listed.filter("key is not null").groupBy(*source, "key").agg(F.min(F.struct(F.col(seq), "file_size")).alias("_f"))
    rows = first.select(*source, F.col(f"_f.{seq}").alias(seq), F.col("_f.file_size").alias("file_size"), "key")
    sized = rows.join(contents.select(F.col("content_id").alias("key"), "original_length", "packed_length"), "key", "left")
    return sized.groupBy(*source, seq).agg(F.count(F.lit(1)).alias("new_objects"), F.sum("file_size").alias("object_bytes"), F.count("original_length").alias("new_contents"), F.sum("original_length").alias("original_bytes"), F.sum("packed_length").alias("packed_bytes"))


def cache_hits(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries whose path and metadata equal those of a previous listing (JN09); of several
    previous listings (``previous_no``, lowest first) the first match wins."""
    prev = previous.select(*keys, F.col("key").alias("_k"), "previous_no").groupBy(*keys).agg(F.min(F.struct("previous_no", "_k")).alias("_b"))
    hit = current.join(prev, list(keys), "left")
    return hit.withColumn("cached_key", F.col("_b._k")).drop("_b")


def extra_locals(local: DataFrame, wanted: DataFrame) -> DataFrame:
    """Local entries a restore would delete (JN12): not in the snapshot, or there as the other of
    folder and non-folder. Columns ``path, entry_type``."""
    w = wanted.select("path", (F.col("entry_type") == "d").alias("_d")).distinct()
    rows = local.withColumn("_d", F.col("entry_type") == "d").join(w, ["path", "_d"], "left_anti")
    return rows.drop("_d")


def fingerprints(rows: DataFrame, keys: Sequence[str], path: str, value: Column) -> DataFrame:
    """SHA-256 of each tree over its entries in path order (GR09): entries are hashed, then runs of
    ``HASH_RUN`` entries, then the runs, so that no row has to hold a whole tree."""
    lines = rows.select(*keys, F.col(path).alias("_path"), F.sha2(F.concat_ws("|", F.col(path), value), 256).alias("_h"))
    ranked = rank_within(lines, keys, ["_path", "_h"], name="_i").withColumn("_run", F.floor((F.col("_i") - 1) / HASH_RUN))
    joined = lambda place: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "_h"))), lambda x: x["_h"]), ""), 256)
    return ranked.groupBy(*keys, "_run").agg(joined("_i").alias("_h")).groupBy(*keys).agg(joined("_run").alias("fingerprint"))


def without_entries(directories: DataFrame, drop: Column) -> DataFrame:
    """Directories with the entries for which ``drop`` holds removed (GR06, GR07), their ids
    unchanged. ``drop`` is over ``entry_name, entry_type, object_id, file_size``."""
    e = directories.select("dir_oid", F.posexplode_outer("entries").alias("_p", "e")).select("dir_oid", "_p", "e.*")
    kept = e.filter(F.col("entry_name").isNotNull() & ~F.coalesce(drop, F.lit(False)))
    have = kept.groupBy("dir_oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "entry_name", "entry_type", "object_id", "file_size"))), lambda x: x.dropFields("_p")).alias("entries"))
    return directories.select("dir_oid").join(have, "dir_oid", "left")


def heights(directories: DataFrame) -> DataFrame:
    """``dir_oid, height`` of every folder: 0 without known folders in it, else one more than the
    highest of them. Folders that contain themselves are an error."""
    todo = materialise(directories.select("dir_oid").distinct(), "heights")
    e = directories.select("dir_oid", F.explode("entries").alias("e")).filter("e.entry_type = 'd' and e.object_id is not null")
    down = e.select("dir_oid", object_key(F.col("e.object_id")).alias("key")).distinct()
    down = materialise(down.join(todo.select(F.col("dir_oid").alias("key")), "key", "left_semi"), "heights")
    out = None
    h = 0
    while True:
        blocked = down.join(todo.select(F.col("dir_oid").alias("key")), "key", "left_semi").select("dir_oid").distinct()
        ready = materialise(todo.join(blocked, "dir_oid", "left_anti").withColumn("height", F.lit(h)), "heights")
        if ready.isEmpty():
            if not todo.isEmpty():
                raise ValueError("folders that contain themselves")
            return ready if out is None else out
        out = ready if out is None else out.unionByName(ready)
        todo = materialise(todo.join(ready, "dir_oid", "left_anti"), "heights")
        h += 1


def rewritten(directories: DataFrame, drop: Column) -> DataFrame:
    """Trees without the entries for which ``drop`` holds, from the leaves up (GR06): a folder gets
    the new ids of its folders before it is hashed itself.

    ``dir_oid, new_oid, fingerprint`` (SHA-256 of what is left) with files, bytes and folders
    below. A folder with nothing changed in or below it keeps its id; so does a child that isn't
    in the table. ``drop`` is over the fields of an entry."""
    spark, path = directories.sparkSession, scratch_path(directories.sparkSession, "rewrite")
    height = materialise(heights(directories), "rewrite")
    directories.select("dir_oid", "entries").join(height, "dir_oid").write.partitionBy("height").parquet(path)
    fields = directories.schema["entries"].dataType.elementType.names
    top, out = height.agg(F.max("height")).first()[0], None
    if top is None:
        return directories.select("dir_oid", F.col("dir_oid").alias("new_oid"), F.lit("").alias("fingerprint"), *[F.lit(0).cast("bigint").alias(c) for c in ("files", "bytes", "folders")])
    for h in range(top + 1):
        level = spark.read.schema("dir_oid string, " + f"entries {directories.schema['entries'].dataType.simpleString()}").parquet(f"{path}/height={h}")
        e = level.select("dir_oid", F.posexplode_outer("entries").alias("_p", "e")).select("dir_oid", "_p", "e.*")
        e = e.withColumn("_gone", F.col("_p").isNotNull() & F.coalesce(drop, F.lit(False)))
        if out is None:
            e = e.withColumns({"_new": F.lit(None).cast("string"), "_files": F.lit(0).cast("bigint"), "_bytes": F.lit(0).cast("bigint"), "_folders": F.lit(0).cast("bigint")})
        else:
            below = out.select(F.col("dir_oid").alias("_child"), F.when(F.col("new_oid") != F.col("dir_oid"), F.col("new_oid")).alias("_new"), F.col("files").alias("_files"), F.col("bytes").alias("_bytes"), F.col("folders").alias("_folders"))
            e = e.join(below, (F.col("entry_type") == "d") & (object_key(F.col("object_id")) == F.col("_child")), "left")
        e = e.withColumn("object_id", F.coalesce("_new", "object_id"))
        left, file = F.col("_p").isNotNull() & ~F.col("_gone"), F.col("entry_type") == "f"
        per = e.groupBy("dir_oid").agg(
            F.array_sort(F.collect_list(F.when(left, F.struct("_p", *fields)))).alias("_e"),
            F.max(F.col("_gone") | F.col("_new").isNotNull()).alias("_changed"),
            F.coalesce(F.sum(F.when(left, F.when(file, 1).otherwise(F.coalesce("_files", F.lit(0))))), F.lit(0)).cast("bigint").alias("files"),
            F.coalesce(F.sum(F.when(left, F.when(file, F.col("file_size")).otherwise(F.coalesce("_bytes", F.lit(0))))), F.lit(0)).cast("bigint").alias("bytes"),
            (F.coalesce(F.sum(F.when(left, F.coalesce("_folders", F.lit(0)))), F.lit(0)) + 1).cast("bigint").alias("folders"),
        )
        per = per.withColumn("fingerprint", F.sha2(F.to_json(F.struct(F.transform("_e", lambda x: x.dropFields("_p")).alias("entries"))), 256))
        new = F.when(F.col("_changed"), F.concat(F.lit("k"), F.substring("fingerprint", 1, 32))).otherwise(F.col("dir_oid"))
        rows = materialise(per.select("dir_oid", new.alias("new_oid"), "fingerprint", "files", "bytes", "folders"), "rewrite")
        out = rows if out is None else out.unionByName(rows)
    return out


def summaries(roots: DataFrame, edge: DataFrame) -> DataFrame:
    """``root`` with what lies below it (AG07): files, links, folders (itself counted), bytes of files,
    latest change, entries without an object, folders without entries. Shared folders count as often
    as paths lead to them. A root that isn't there is an empty folder."""
    start = roots.select(F.col("key").alias("root")).filter("root is not null").distinct()
    rows = paths_below(roots, edge)
    is_ = lambda t: F.col("entry_type") == t
    has = edge.select(F.col("dir_oid").alias("key"), F.lit(True).alias("_has")).distinct()
    per = rows.join(has, "key", "left").groupBy("root").agg(F.count(F.when(is_("f"), 1)).alias("files"), F.count(F.when(is_("s"), 1)).alias("links"), F.count(F.when(is_("d"), 1)).alias("_dirs"), F.sum(F.when(is_("f"), F.col("file_size"))).alias("bytes"), F.count(F.when(F.col("key").isNull(), 1)).alias("failed"), F.count(F.when(is_("d") & F.col("_has").isNull(), 1)).alias("empty_folders"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c if isinstance(c, str) else "x")
    empty = F.when(F.col("_dirs").isNull(), 1).otherwise(F.col("empty_folders")).cast("bigint").alias("empty_folders")
    return start.join(per, "root", "left").select("root", z("files"), z("links"), (F.coalesce("_dirs", F.lit(0)) + 1).cast("bigint").alias("folders"), z("bytes"), z("failed"), empty)


def transfer_counters(listed: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters of an upload (AG10, AG22) per ``pair``: files whose metadata equal those of the
    previous listing are cached, others are hashed. Rows need ``entry_type, key, file_size`` and
    ``keys``; entries without an object failed."""
    hits = cache_hits(listed, previous.withColumn("previous_no", F.lit(1)), keys)
    file, got = F.col("entry_type") == "f", F.col("cached_key").isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("file_size"))), F.lit(0)).cast("bigint")
    n = lambda cond: F.count(F.when(cond, 1))
    return hits.groupBy("pair").agg(n(file & got).alias("cached_files"), total(file & got).alias("cached_bytes"), n(file & ~got).alias("hashed_files"), total(file & ~got).alias("hashed_bytes"), n(F.col("entry_type") == "d").alias("folders"), n(F.col("entry_type") == "s").alias("links"), n(F.col("key").isNull()).alias("failed"))


def restore_counters(wanted: DataFrame, local: DataFrame) -> DataFrame:
    """Counters of restoring ``wanted`` over ``local`` (AG22) per ``pair``: files restored, their
    bytes, files skipped because one of their size and time is there, links, and local entries that
    are extra. Rows have ``pair, entry_path, entry_type, file_size, mod_time``."""
    cols = F.struct("entry_type", "file_size", "mod_time")
    a = wanted.groupBy("pair", "entry_path").agg(F.max(cols).alias("a"))
    b = local.groupBy("pair", "entry_path").agg(F.max(cols).alias("b"))
    both = a.join(b, ["pair", "entry_path"], "full_outer")
    file = F.col("a.entry_type") == "f"
    same = file & (F.col("b.entry_type") == "f") & F.col("a.file_size").eqNullSafe(F.col("b.file_size")) & F.col("a.mod_time").eqNullSafe(F.col("b.mod_time"))
    n = lambda cond: F.count(F.when(cond, 1))
    put = file & ~F.coalesce(same, F.lit(False))
    return both.groupBy("pair").agg(n(put).alias("restored_files"), F.coalesce(F.sum(F.when(put, F.col("a.file_size"))), F.lit(0)).alias("restored_bytes"), n(same).alias("skipped_files"), n(F.col("a.entry_type") == "s").alias("restored_links"), n(F.col("a").isNull()).alias("extra_entries"))
