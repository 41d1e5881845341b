"""Blob listings: prefix scans, point-in-time views, garbage, cleanup, synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import rank_within, running_within


def with_prefix(df: DataFrame, prefix: str, column: str = "blob_id") -> DataFrame:
    """Blobs of one id prefix; the condition reaches the scan (SC01, SC02)."""
    return df.filter(F.col(column).startswith(prefix))


def prefix_scans(df: DataFrame, prefixes: Sequence[str], column: str = "blob_id") -> DataFrame:
    """Union of the scans of several prefixes in one pass (SC03): a blob comes out once for every
    prefix it has, with the prefix as ``scanned``."""
    hits = F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.col(column).startswith(p))
    return df.withColumn("scanned", F.explode(hits))


def byte_range(data: Column, offset: int, length: int) -> Column:
    """``length`` bytes from ``offset``, all of the rest if ``length`` is negative (SC05); null if
    the range lies outside the data."""
    rest = F.octet_length(data) - offset
    take = rest if length < 0 else F.lit(length)
    return F.when((rest >= 0) & (take <= rest), F.substring(data, F.lit(offset + 1), take.cast("int")))


def as_of(versions: DataFrame, key: str, at: str, moment: Column, deleted: str = "deleted") -> DataFrame:
    """Newest version of each key at a moment, inclusive; gone if that version is a delete marker
    (SC10). Tombstones are dropped after choosing."""
    rest = [c for c in versions.columns if c not in (key, at, deleted)]
    live = ~F.coalesce(deleted, F.lit(False))
    best = versions.filter((F.col(at) <= moment) & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at), live.alias("_live"), *rest)).alias("_b"))
    return best.filter("_b._live").select(key, f"_b.{at}", *[f"_b.{c}" for c in rest])


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``gone`` (SC07, MS13): deletion by rewriting."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


#: Id prefixes of blobs that hold no data: indexes, epochs, logs.
NOT_DATA = ["n", "x", "_log_"]


def listed(df: DataFrame, *, data_only: bool = False, not_data: Sequence[str] = NOT_DATA, min_size: int = 0, max_size: int = 0, exclude: Sequence[str] = ()) -> DataFrame:
    """Blob list predicates (FI06); a size of 0 is no bound, a null length passes no bound."""
    cond = F.lit(True)
    if data_only:
        for p in not_data:
            cond &= ~F.col("blob_id").startswith(p)
    if min_size:
        cond &= F.col("blob_length") >= min_size
    if max_size:
        cond &= F.col("blob_length") <= max_size
    for p in exclude:
        cond &= ~F.col("blob_id").startswith(p)
    return df.filter(cond)


def unreferenced(blobs: DataFrame, entries: DataFrame, prefixes: Sequence[str] = ("p", "q", "s")) -> DataFrame:
    """Pack blobs no index entry names; deleted entries count as use (JN01)."""
    some = F.lit(False)
    for p in prefixes:
        some |= F.col("blob_id").startswith(p)
    used = entries.filter("pack_blob_id is not null").select(F.col("pack_blob_id").alias("blob_id")).distinct()
    return blobs.filter(some).join(used, "blob_id", "left_anti")


def session_of(blob_id: Column) -> Column:
    """Session in a blob id (SF06): the first part after the first dash that starts with ``s``."""
    parts = F.filter(F.split(blob_id, "-"), lambda x, i: (i > 0) & x.startswith("s"))
    return F.get(parts, F.lit(0))


def pack_garbage(orphaned: DataFrame, sessions: DataFrame, cutoff_seconds: int, min_age: int, session_age: int) -> DataFrame:
    """What becomes of unreferenced packs (JN02). With the cutoff moved on by a second: ``after
    cutoff`` if strictly newer, ``too young`` if younger than ``min_age``, ``active session`` if
    its session's checkpoint is younger than ``session_age``, else ``unreferenced``. ``orphaned``
    has ``blob_id, blob_length, ts``, ``sessions`` ``session_id, checkpoint`` (Unix seconds)."""
    cut = F.lit(cutoff_seconds + 1)
    rows = orphaned.withColumn("session_id", session_of(F.col("blob_id"))).join(sessions.select("session_id", "checkpoint"), "session_id", "left")
    fate = F.when(F.col("ts") > cut, "after cutoff").when(cut - F.col("ts") < min_age, "too young").when(cut - F.col("checkpoint") < session_age, "active session").otherwise("unreferenced")
    return rows.withColumn("fate", fate)


def cleanup_by_budget(logs: DataFrame, max_bytes: int, max_count: int, max_age: int, now: int) -> DataFrame:
    """Logs to delete (WN09): newest first, from the first row at which total size, count or age
    goes over its bound everything is deleted. Columns ``blob_id, blob_length, ts``. Running sums
    are taken in slices of time, so no task holds all logs, nor those of a busy day."""
    rows = logs.withColumns({"_all": F.lit(1), "_new": -F.col("ts"), "_one": F.lit(1)})
    run = running_within(rows, ["_all"], ["_new", "blob_id"], sums={"_rs": "blob_length", "_rc": "_one"})
    over = (F.col("_rs") > max_bytes) | (F.col("_rc") > max_count) | (F.lit(now) - F.col("ts") > max_age)
    # Size and count only grow and time only falls along the order: once over is always over.
    return run.filter(over).select(*logs.columns)


def lru_sweep(items: DataFrame, soft: int, hard: int, min_age: int, now: int) -> DataFrame:
    """Cache items to delete, oldest first, until the rest is within the soft limit; an item
    younger than ``min_age`` ends the sweep unless the rest is over the hard limit (WN10).
    Columns ``blob_id, blob_length, ts``."""
    rows = items.withColumns({"_all": F.lit(1), "_new": -F.col("ts")})
    ranked = rank_within(rows, ["_all"], ["ts", "blob_id"], descending=True, name="_i")
    run = running_within(ranked, ["_all"], ["_i"], sums={"_left": "blob_length"})
    return run.filter((F.col("_left") > soft) & ((F.lit(now) - F.col("ts") >= min_age) | (F.col("_left") > hard))).select(*items.columns)


def sync_plan(src: DataFrame, dst: DataFrame, update: bool, delete: bool) -> DataFrame:
    """Action per blob to make ``dst`` follow ``src`` (JN08): copy, delete, keep or in-sync."""
    a = src.select("blob_id", F.col("blob_length").alias("src_length"), F.col("blob_ts").alias("src_ts"), F.lit(True).alias("_a"))
    b = dst.select("blob_id", F.col("blob_length").alias("dst_length"), F.col("blob_ts").alias("dst_ts"), F.lit(True).alias("_b"))
    both = a.join(b, "blob_id", "full_outer")
    act = F.when(F.col("_b").isNull(), "copy").when(F.col("_a").isNull(), "delete" if delete else "keep")
    if update:
        act = act.when(F.col("src_ts") > F.col("dst_ts"), "copy")
    return both.select("blob_id", "src_length", "dst_length", act.otherwise("in-sync").alias("action"))


def resharded_path(blob_id: Column, widths: Sequence[int]) -> Column:
    """Path of a blob in a layout that cuts prefixes of the given widths into folders (SC09,
    MS11); an id too short for a cut stays whole."""
    out, at = [], 0
    for w in widths:
        out.append(F.when(F.length(blob_id) > at + w, F.concat(F.substring(blob_id, at + 1, w), F.lit("/"))).otherwise(F.lit("")))
        at += w
    rest = F.lit(None).cast("string")
    total = 0
    used = F.lit(0)
    for w in widths:
        used = F.when(F.length(blob_id) > total + w, F.lit(total + w)).otherwise(used)
        total += w
    rest = F.substring(blob_id, used + 1, F.length(blob_id))
    return F.concat(*out, rest, F.lit(".f"))


def usage_by_folder(df: DataFrame, path: str, size: str) -> DataFrame:
    """Files and bytes of each folder (AG24)."""
    folder = F.regexp_replace(F.col(path), "/?[^/]*$", "")
    return df.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def complete_sets(ids: DataFrame, column: str = "blob_id") -> DataFrame:
    """Complete sets of blobs named ``...-s<set>-c<count>`` (IX15): a set is complete once it has
    at least its count of members; a name of no set is a complete set of its own. Columns ``set_id,
    members`` (sorted)."""
    named = r"^.*-s([^-]+)-c(\d+)$"
    c = F.col(column)
    is_set = c.rlike(named)
    key = F.when(is_set, F.regexp_extract(c, named, 1)).otherwise(c)
    need = F.when(is_set, F.regexp_extract(c, named, 2)).otherwise(F.lit("1")).cast("int")
    groups = ids.select(key.alias("set_id"), is_set.alias("_s"), need.alias("_n"), c.alias("_m")).distinct().groupBy("set_id", "_s", "_n").agg(F.sort_array(F.collect_list("_m")).alias("members"))
    return groups.filter(F.size("members") >= F.col("_n")).select("set_id", "members")


def log_sessions(blobs: DataFrame) -> DataFrame:
    """Log sessions from ids of 8 or more ``_`` parts (AG13): parts 3 and 4 name the session, 5
    and 6 are its start and end in Unix seconds; other ids are skipped."""
    p = F.split("blob_id", "_")
    rows = blobs.filter(F.size(p) >= 8).select(F.concat_ws("_", F.get(p, F.lit(2)), F.get(p, F.lit(3))).alias("session_id"), F.expr("try_cast(get(split(blob_id, '_'), 4) as bigint)").alias("s"), F.expr("try_cast(get(split(blob_id, '_'), 5) as bigint)").alias("e"), "blob_id", "blob_length", "blob_ts")
    good = rows.filter("s is not null and e is not null")
    return good.groupBy("session_id").agg(F.min("s").alias("started"), F.max("e").alias("ended"), F.sum("blob_length").alias("bytes"), F.count(F.lit(1)).alias("segments"))


def put(df: DataFrame, new: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Blobs after ``new`` ones are put (SC07): they replace those of their key, or give way to them.
    ``new`` has the same columns; of repeated keys in it the greatest row is put."""
    rest = [c for c in df.columns if c != key]
    one = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    if overwrite:
        return df.join(one.select(key), key, "left_anti").select(df.columns).unionByName(one)
    return df.unionByName(one.join(df.select(key).distinct(), key, "left_anti").select(df.columns))


def extended_locks(blobs: DataFrame, prefixes: Sequence[str], until: Column, now: Column) -> DataFrame:
    """Retention locks after extension (FI14): blobs with one of the prefixes that are locked still,
    or never were, are locked ``until`` a time, but never shorter than they are; a lock that has
    ended stays ended. Columns ``blob_id, locked_until``."""
    mine = F.lit(False)
    for p in prefixes:
        mine |= F.col("blob_id").startswith(p)
    held = F.col("locked_until").isNull() | (F.col("locked_until") >= now)
    return blobs.withColumn("locked_until", F.when(mine & held, F.greatest("locked_until", until)).otherwise(F.col("locked_until")))


def selected_sessions(sessions: DataFrame, now: int, younger: int | None = None, older: int | None = None, latest: int | None = None) -> DataFrame:
    """Log sessions by age in seconds since their start, then the newest few (FI16)."""
    age = F.lit(now) - F.col("started")
    out = sessions
    if younger is not None:
        out = out.filter(age < younger)
    if older is not None:
        out = out.filter(age > older)
    return out if latest is None else out.orderBy(F.desc("started"), F.desc("session_id")).limit(latest)


def active_indexes(blobs: DataFrame, compactions: DataFrame) -> DataFrame:
    """Index blobs that are in use (IX09): all but the inputs of compactions whose outputs are all
    there. ``blobs`` has ``blob_id``, ``compactions`` ``log_id, role`` (``input`` or ``output``) and
    ``blob_id``. An output of such a compaction that is an input of another one goes as well."""
    there = blobs.select("blob_id", F.lit(True).alias("_t")).distinct()
    outputs = compactions.filter("role = 'output'").join(there, "blob_id", "left").groupBy("log_id").agg(F.min(F.coalesce("_t", F.lit(False))).alias("_all"))
    gone = compactions.filter("role = 'input'").join(outputs.filter("_all"), "log_id", "left_semi").select("blob_id").distinct()
    return blobs.join(gone, "blob_id", "left_anti")
