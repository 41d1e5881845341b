"""Queries that go into the details of operators: pending writes, locks, ages, counters, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.functions import scalars as X
from moraine.operators import blobs as B
from moraine.operators import epochs as E
from moraine.operators import nested
from moraine.operators import policies as P
from moraine.operators import ranking as R
from moraine.operators import snapshots as S
from moraine.operators import trees
from moraine.operators.history import SOURCE
from moraine.operators.state import shadowed
from moraine.plans import function_queries as FU
from moraine.plans import snapshot_queries as SQ
from moraine.plans import store_queries as ST
from moraine.plans import tree_queries as T
from moraine.plans.base import BL, CW, DI, EN, LV, PO, SN, Registry, sql

q = Registry()
QUERIES, ORACLE = q.QUERIES, q.ORACLE

SRC = "host_name, user_name, source_path"
ORD = "start_time NULLS FIRST, end_time NULLS FIRST, manifest_id"
CUT = "timestamp '2024-06-01'"
NOW = 1_717_200_000  # 2024-06-01


def cut():
    return F.lit("2024-06-01").cast("timestamp_ntz")


# -- pending writes and puts --------------------------------------------------------------------
_NEWEST = "SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC NULLS LAST, coalesce(deleted, false)) rn FROM manifests WHERE manifest_id IS NOT NULL"


@q(f"WITH p AS (SELECT * FROM ({_NEWEST} AND modified_at > {CUT}) WHERE rn = 1), c AS (SELECT * FROM ({_NEWEST} AND (modified_at <= {CUT} OR modified_at IS NULL)) WHERE rn = 1 AND manifest_id NOT IN (SELECT manifest_id FROM p)) SELECT manifest_id, modified_at FROM (SELECT manifest_id, modified_at, deleted, user_name FROM p UNION ALL SELECT manifest_id, modified_at, deleted, user_name FROM c) WHERE NOT coalesce(deleted, false) AND user_name = 'root'")
def fi02_pending_manifests(t):
    """A user's manifests while all writes after a time are pending."""
    late = F.coalesce(F.col("modified_at") > cut(), F.lit(False))
    rows = shadowed(t.manifests.filter(~late), t.manifests.filter(late), "manifest_id", "modified_at", ["user_name"])
    return rows.filter("user_name = 'root'").select("manifest_id", "modified_at").orderBy("modified_at", "manifest_id")


@q("SELECT index_blob_id, content_id, timestamp_seconds, coalesce(deleted, false) deleted, pack_blob_id, count(*) n FROM content_entries WHERE content_id IN (SELECT content_id FROM content_entries WHERE deleted) GROUP BY ALL")
def fi08_index_entries(t):
    """Entries of every index blob for a list of content ids: those that were ever deleted."""
    ids = t.content_entries.filter("deleted and content_id is not null").select("content_id").distinct()
    rows = t.content_entries.join(ids, "content_id", "left_semi")
    return rows.groupBy("index_blob_id", "content_id", "timestamp_seconds", F.coalesce("deleted", F.lit(False)).alias("deleted"), "pack_blob_id").agg(F.count(F.lit(1)).alias("n"))


_PUT = "nw AS (SELECT DISTINCT pack_blob_id blob_id, 7::BIGINT blob_length FROM content_entries WHERE pack_blob_id IS NOT NULL)"


@q(sql(BL, _PUT, "SELECT blob_id, blob_length FROM bl WHERE NOT deleted AND blob_id NOT IN (SELECT blob_id FROM nw) UNION ALL SELECT blob_id, blob_length FROM nw"))
def sc07_put(t):
    """Every pack that an entry names is put, over the one that may be there."""
    new = t.content_entries.select(F.col("pack_blob_id").alias("blob_id"), F.lit(7).cast("bigint").alias("blob_length"))
    return B.put(t.live_blobs.select("blob_id", "blob_length"), new, "blob_id")


@q(sql(BL, _PUT, "SELECT blob_id, blob_length FROM bl WHERE NOT deleted UNION ALL SELECT blob_id, blob_length FROM nw WHERE blob_id NOT IN (SELECT blob_id FROM bl WHERE NOT deleted)"))
def sc07_put_new(t):
    """The same without overwriting."""
    new = t.content_entries.select(F.col("pack_blob_id").alias("blob_id"), F.lit(7).cast("bigint").alias("blob_length"))
    return B.put(t.live_blobs.select("blob_id", "blob_length"), new, "blob_id", overwrite=False)


@q(sql(BL, f"lk AS (SELECT blob_id, blob_ts + INTERVAL 300 DAY locked_until FROM bl WHERE NOT deleted)", f"SELECT blob_id, CASE WHEN blob_id[1:1] IN ('p', 'x') AND (locked_until IS NULL OR locked_until >= {CUT}) THEN greatest(locked_until, {CUT} + INTERVAL 90 DAY) ELSE locked_until END locked_until FROM lk"))
def fi14_extended_locks(t):
    """Locks of 300 days, extended to 90 days from a time for two prefixes."""
    held = t.live_blobs.select("blob_id", (F.col("blob_ts") + F.expr("interval 300 days")).alias("locked_until"))
    return B.extended_locks(held, ["p", "x"], cut() + F.expr("interval 90 days"), cut())


@q("SELECT 's' || user_id session_id, min(epoch_us(ts) // 1000000) started FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING 1704672000 - min(epoch_us(ts) // 1000000) < 500000 AND 1704672000 - min(epoch_us(ts) // 1000000) > 3600")
def fi16_sessions_by_age(t):
    rows = t.events.filter("user_id is not null").groupBy(F.concat(F.lit("s"), "user_id").alias("session_id")).agg(F.min(F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)")).alias("started"))
    return B.selected_sessions(rows, 1_704_672_000, younger=500_000, older=3_600)


_LOGS = "ix AS (SELECT DISTINCT index_blob_id blob_id FROM content_entries WHERE index_blob_id IS NOT NULL), cp AS (SELECT 'c' || blob_id[1:9] log_id, blob_id, row_number() OVER (PARTITION BY blob_id[1:9] ORDER BY blob_id DESC) r, count(*) OVER (PARTITION BY blob_id[1:9]) n FROM ix)"


@q(f"WITH {_LOGS} SELECT blob_id FROM ix WHERE blob_id NOT IN (SELECT blob_id FROM cp WHERE n > 2 AND r > 1)")
def ix09_active_set(t):
    """Index blobs in use when those that share the first nine characters of their ids were compacted
    into the last of them, and pairs into one that is missing."""
    ids = t.content_entries.filter("index_blob_id is not null").select(F.col("index_blob_id").alias("blob_id")).distinct()
    named = ids.withColumn("log_id", F.concat(F.lit("c"), F.substring("blob_id", 1, 9)))
    last = named.groupBy("log_id").agg(F.max("blob_id").alias("_m"), F.count(F.lit(1)).alias("_n"))
    inputs = named.join(last, "log_id").filter("blob_id <> _m").select("log_id", F.lit("input").alias("role"), "blob_id")
    outputs = last.select("log_id", F.lit("output").alias("role"), F.when(F.col("_n") > 2, F.col("_m")).otherwise(F.lit("none")).alias("blob_id"))
    return B.active_indexes(ids, inputs.unionByName(outputs))


# -- names and hashes ---------------------------------------------------------------------------
@q("SELECT DISTINCT timestamp_seconds, CASE WHEN deleted THEN timestamp_seconds END watermark FROM content_entries WHERE timestamp_seconds >= 0")
def sf05_watermark_ids(t):
    """Times in ids of deletion watermarks; ids of other kinds have none."""
    kind = F.when(F.coalesce("deleted", F.lit(False)), "xw").otherwise("xn")
    rows = t.content_entries.filter("timestamp_seconds >= 0").select("timestamp_seconds", F.concat(kind, "timestamp_seconds", F.lit("-ab")).alias("id"))
    return rows.select("timestamp_seconds", X.watermark_time(F.col("id")).alias("watermark")).distinct()


@q("SELECT DISTINCT entry_path, CASE WHEN contains(entry_path, '/') THEN substr(entry_path, strpos(entry_path, '/') + 1) ELSE '.' END below FROM snapshot_entries WHERE entry_path IS NOT NULL")
def sf09_relative_path(t):
    """Each path relative to its first folder."""
    rows = t.snapshot_entries.filter("entry_path is not null").select("entry_path").distinct()
    return rows.select("entry_path", X.relative_path(F.substring_index("entry_path", "/", 1), F.col("entry_path")).alias("below"))


@q(sql(CW, "SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(content_id, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 8 AS shard, count(*) n FROM cw WHERE content_id <> '' GROUP BY 1"))
def sf16_fnv_shards(t):
    return t.contents.filter("content_id <> ''").groupBy((X.fnv32a(F.col("content_id")) % 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _gate(text, percent):
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(100)) < percent


@q(sql(CW, "SELECT content_id FROM cw WHERE ('0x' || md5(content_id)[1:8])::BIGINT % 100 < 10"))
def fi17_hash_sample(t):
    """About one content in ten, by a hash: the same rows on every run."""
    return t.contents.filter(_gate(F.col("content_id"), 10)).select("content_id")


@q("SELECT DISTINCT index_blob_id FROM content_entries WHERE ('0x' || md5(index_blob_id || '2025-01-01')[1:8])::BIGINT % 100 < 10")
def ms10_daily_gate(t):
    """Index blobs that a percentage gate checks on a day."""
    ids = t.content_entries.filter("index_blob_id is not null").select("index_blob_id").distinct()
    return ids.filter(_gate(F.concat("index_blob_id", F.lit("2025-01-01")), 10))


# -- trees --------------------------------------------------------------------------------------
_CHANGED = "dn(root, node) AS (SELECT dir_oid, dir_oid FROM di UNION ALL SELECT root, di.dir_oid FROM dn JOIN en ON en.dir_oid = node JOIN di ON di.dir_oid = " + T.KEY.format("en.object_id") + " WHERE en.entry_type = 'd'{kept}), ow AS (SELECT di.dir_oid, bool_or(coalesce({gone}, false)) gone, count(*) FILTER (WHERE entry_type = 'f' AND NOT coalesce({gone}, false)) files, sum(file_size) FILTER (WHERE entry_type = 'f' AND NOT coalesce({gone}, false)) bytes FROM di LEFT JOIN en ON en.dir_oid = di.dir_oid GROUP BY 1)"
_ROLLED = "SELECT root AS dir_oid, bool_or(gone) changed, sum(files)::BIGINT files, coalesce(sum(bytes), 0)::BIGINT bytes, count(*) folders FROM dn JOIN ow ON ow.dir_oid = node GROUP BY 1"


def _rewritten(t, drop):
    rows = trees.rewritten(t.directories, drop)
    return rows.select("dir_oid", (F.col("new_oid") != F.col("dir_oid")).alias("changed"), "files", "bytes", "folders")


@q(T.rec(DI, EN, _CHANGED.format(gone="entry_type = 's'", kept=""), _ROLLED))
def gr06_changed_folders(t):
    """Folders that get a new id when links are removed, in or below them, with what is left."""
    return _rewritten(t, F.col("entry_type") == "s")


@q(T.rec(DI, EN, _CHANGED.format(gone="regexp_matches(entry_name, '\\.(raw|mkv)$')", kept=" AND NOT regexp_matches(coalesce(entry_name, ''), '\\.(raw|mkv)$')"), _ROLLED))
def gr07_changed_folders(t):
    """The same when entries are removed by name."""
    return _rewritten(t, F.col("entry_name").rlike(r"\.(raw|mkv)$"))


_SUM = "ps AS (SELECT root, count(*) FILTER (WHERE entry_type = 'f') files, count(*) FILTER (WHERE entry_type = 's') links, count(*) FILTER (WHERE entry_type = 'd') dirs, sum(file_size) FILTER (WHERE entry_type = 'f') bytes, count(*) FILTER (WHERE key IS NULL) failed, count(*) FILTER (WHERE entry_type = 'd' AND (key IS NULL OR key NOT IN (SELECT dir_oid FROM en))) empty_folders FROM pt WHERE depth > 0 GROUP BY 1)"


@q(T.rec(SN, DI, EN, T._PATHS, _SUM, f"rt AS (SELECT DISTINCT {T.KEY.format('root_oid')} root FROM sn WHERE root_oid IS NOT NULL)", "SELECT root, coalesce(files, 0) files, coalesce(links, 0) links, coalesce(dirs, 0) + 1 AS folders, coalesce(bytes, 0)::BIGINT bytes, coalesce(failed, 0) failed, coalesce(empty_folders, 1) empty_folders FROM rt LEFT JOIN ps USING (root)"))
def ag07_summaries(t):
    """Summary of every root folder: files, links, folders, bytes, failures, empty folders."""
    return trees.summaries(T._roots(t), T._edges(t))


@q(sql(SN, T.ENTRY, T.EVERY, "SELECT pair, count(*) FILTER (WHERE n.entry_type = 'f' AND o.k IS NOT NULL) cached_files, coalesce(sum(n.file_size) FILTER (WHERE n.entry_type = 'f' AND o.k IS NOT NULL), 0)::BIGINT cached_bytes, count(*) FILTER (WHERE n.entry_type = 'f' AND o.k IS NULL) hashed_files, coalesce(sum(n.file_size) FILTER (WHERE n.entry_type = 'f' AND o.k IS NULL), 0)::BIGINT hashed_bytes, count(*) FILTER (WHERE n.entry_type = 'd') folders, count(*) FILTER (WHERE n.entry_type = 's') links, count(*) FILTER (WHERE n.k IS NULL) failed FROM (SELECT pair, e.* FROM en1 e JOIN pr ON pair = manifest_id) n LEFT JOIN (SELECT pair op, entry_path, file_size, file_mode, mod_time, user_id, group_id, min(k) k FROM (SELECT pair, e.* FROM en1 e JOIN pr ON older = manifest_id) GROUP BY ALL) o ON op = pair AND o.entry_path = n.entry_path AND o.file_size = n.file_size AND o.file_mode = n.file_mode AND o.mod_time = n.mod_time AND o.user_id = n.user_id AND o.group_id = n.group_id GROUP BY 1"))
def ag22_upload_counters(t):
    """Cached and hashed files and bytes of every listing against the one before."""
    keys = ["pair", "entry_path", *T.META]
    old, new = T._all_sides(t, ["entry_type", "key", *T.META], keys)
    return trees.transfer_counters(new, old, keys)


@q(sql(SN, T.ENTRY, T.EVERY, "SELECT pair, kind, status, count(*) n FROM (SELECT coalesce(a.pair, b.pair) pair, CASE WHEN coalesce(b.entry_type, a.entry_type) = 's' THEN 'link' ELSE 'file' END kind, CASE WHEN a.pair IS NULL THEN 'added' WHEN b.pair IS NULL THEN 'removed' WHEN a.entry_type IS DISTINCT FROM b.entry_type THEN 'other type' WHEN a.k IS DISTINCT FROM b.k THEN 'changed' WHEN (a.file_size, a.file_mode, a.mod_time, a.user_id, a.group_id) IS DISTINCT FROM (b.file_size, b.file_mode, b.mod_time, b.user_id, b.group_id) THEN 'touched' ELSE 'same' END status FROM (SELECT pair, e.* FROM en1 e JOIN pr ON older = manifest_id) a FULL JOIN (SELECT pair, e.* FROM en1 e JOIN pr ON pair = manifest_id) b ON a.pair = b.pair AND a.entry_path = b.entry_path) GROUP BY ALL"))
def jn07_diffs_by_kind(t):
    """Every listing against the one before, by kind of entry; a path that changed its type is apart."""
    keys = ["pair", "entry_path"]
    old, new = T._all_sides(t, ["entry_type", "key", *T.META], keys)
    rows = trees.diff(old, new, keys)
    kind = F.when(F.coalesce("b.entry_type", "a.entry_type") == "s", "link").otherwise("file")
    status = F.when(F.col("other_type"), "other type").otherwise(F.col("status"))
    return rows.groupBy("pair", kind.alias("kind"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# -- snapshots ----------------------------------------------------------------------------------
@q(sql(SN, f"SELECT manifest_id FROM (SELECT *, row_number() OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r FROM sn WHERE complete AND start_time IS NOT NULL) a WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.host_name = 'relay-hub' AND b.start_time = a.start_time)"))
def jn11_migrate_latest(t):
    """Only the newest complete snapshot of each source, if its start time isn't there yet."""
    sn = t.snapshots
    have = sn.filter("host_name = 'relay-hub' and start_time is not null").select("start_time").distinct()
    newest = sn.filter("complete and start_time is not null").groupBy(*SOURCE).agg(F.max(F.struct("start_time", "end_time", "manifest_id")).alias("_b"))
    return newest.select("_b.*").join(have, "start_time", "left_anti").select("manifest_id")


_BEST = f"b AS (SELECT {SRC}, max(start_time) last_start, max_by(manifest_id, (coalesce(start_time, timestamp '0001-01-01'), coalesce(end_time, timestamp '0001-01-01'), manifest_id)) FILTER (WHERE complete) complete_id FROM sn GROUP BY ALL), w AS (SELECT *, count(*) FILTER (WHERE complete) OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) nc FROM sn)"


@q(sql(SN, _BEST, f"SELECT b.host_name, b.user_name, b.source_path, complete_id, last_start, coalesce(list(w.manifest_id ORDER BY {ORD.replace('start_time', 'w.start_time').replace('end_time', 'w.end_time').replace('manifest_id', 'w.manifest_id')}) FILTER (WHERE w.manifest_id IS NOT NULL), []) since FROM b LEFT JOIN w ON nc = 0 AND NOT w.complete AND w.host_name IS NOT DISTINCT FROM b.host_name AND w.user_name IS NOT DISTINCT FROM b.user_name AND w.source_path IS NOT DISTINCT FROM b.source_path GROUP BY ALL"))
def jn16_since_complete(t):
    """Latest complete snapshot of each source and the incomplete ones since."""
    return S.history_since_complete(t.snapshots)


@q(sql(SN, f"SELECT manifest_id, r::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r FROM sn) WHERE r <= 4"))
def wn12_kept_runs(t):
    """The last four runs of each source, kept."""
    ranked = R.rank_within(t.snapshots, SOURCE, ["start_time", "end_time", "manifest_id"], descending=True, name="place")
    return ranked.filter("place <= 4").select("manifest_id", "place")


@q(sql(SN, f"l AS (SELECT {SRC}, max(end_time) FILTER (WHERE complete) e FROM sn GROUP BY ALL)", f"SELECT {SRC}, coalesce({CUT} - e >= INTERVAL 24 HOUR, true) may_rewrite, coalesce({CUT} - e >= INTERVAL 48 HOUR, false) may_delete FROM l"))
def wn13_gates(t):
    """After the last success of each source: rewriting may go on after a day or if there was none,
    deleting only two days after one."""
    last = t.snapshots.groupBy(*SOURCE).agg(F.max(F.when(F.col("complete"), F.col("end_time"))).alias("e"))
    age = cut() - F.col("e")
    return last.select(*SOURCE, F.coalesce(age >= F.expr("interval 24 hours"), F.lit(True)).alias("may_rewrite"), F.coalesce(age >= F.expr("interval 48 hours"), F.lit(False)).alias("may_delete"))


@q(sql(SN, "rt AS (SELECT root_oid, min(total_size) IS NOT DISTINCT FROM max(total_size) consistent, count(*) n FROM sn WHERE root_oid IS NOT NULL GROUP BY 1)", "ak AS (SELECT DISTINCT manifest_id asked FROM manifests WHERE manifest_id IS NOT NULL UNION SELECT root_entry.object_id FROM manifests WHERE root_entry.object_id IS NOT NULL)", "SELECT asked, rt.root_oid, consistent, n FROM ak LEFT JOIN sn ON sn.manifest_id = asked JOIN rt ON rt.root_oid = coalesce(sn.root_oid, asked)"))
def gr03_resolved_roots(t):
    """Ids of manifests and of roots resolved to roots."""
    m = t.manifests
    asked = m.select(F.col("manifest_id").alias("asked")).unionByName(m.select(F.col("root_entry.object_id").alias("asked")))
    return S.resolved_roots(asked, t.snapshots)


@q(sql(SN, "SELECT manifest_id FROM sn WHERE NOT (host_name = 'relay-hub' AND user_name IS NOT NULL) AND manifest_id NOT IN (SELECT manifest_id FROM snapshot_entries WHERE manifest_id IS NOT NULL AND entry_type = 's')"))
def ms13_delete_by_id_and_source(t):
    """Snapshots left after those of a host's users and those that list a link are deleted."""
    sn = t.snapshots
    ids = t.snapshot_entries.filter("entry_type = 's' and manifest_id is not null").select("manifest_id")
    source = F.coalesce((F.col("host_name") == "relay-hub") & F.col("user_name").isNotNull(), F.lit(False))
    return B.without(sn.filter(~source), ids, "manifest_id").select("manifest_id")


# -- restores, tasks, epochs, policies ----------------------------------------------------------
_SIDE = "(SELECT pair, entry_path, max((entry_type, file_size, mod_time)) v FROM (SELECT pair, e.* FROM en1 e JOIN pr ON {} = manifest_id) GROUP BY ALL)"


@q(sql(SN, T.ENTRY, T.EVERY, f"jo AS (SELECT coalesce(a.pair, b.pair) pair, a.v[1] t, a.v[2] z, a.v IS NULL extra, a.v IS NOT DISTINCT FROM b.v AND a.v[1] = 'f' same FROM {_SIDE.format('pair')} a FULL JOIN {_SIDE.format('older')} b ON a.pair = b.pair AND a.entry_path = b.entry_path)", "SELECT pair, count(*) FILTER (WHERE t = 'f' AND NOT same) restored_files, coalesce(sum(z) FILTER (WHERE t = 'f' AND NOT same), 0)::BIGINT restored_bytes, count(*) FILTER (WHERE same) skipped_files, count(*) FILTER (WHERE t = 's') restored_links, count(*) FILTER (WHERE extra) extra_entries FROM jo GROUP BY 1").replace("max((entry_type, file_size, mod_time)) v", "max_by(row(entry_type, file_size, mod_time), (entry_type IS NOT NULL, coalesce(entry_type, ''), file_size IS NOT NULL, coalesce(file_size, 0), mod_time IS NOT NULL, coalesce(mod_time, timestamp '0001-01-01'))) v"))
def ag22_restore_counters(t):
    """Every listing restored over the one before it."""
    old, new = T._all_sides(t, ["entry_type", "file_size", "mod_time"], ["pair", "entry_path"])
    return trees.restore_counters(new, old)


_TASKS = {"collect contents": ("jn03_snapshot_gc", "fate"), "collect packs": ("jn02_session_garbage", "fate"), "verify contents": ("jn06_verify_objects", "state"), "sets of epochs": ("ep05_index_set", "kind")}


@q(" UNION ALL ".join(f"SELECT '{task}' task, {col} AS counter, n::BIGINT AS value FROM ({T.ORACLE.get(name) or ST.ORACLE.get(name) or FU.ORACLE[name]})" for task, (name, col) in _TASKS.items()) + f" UNION ALL SELECT 'clean up logs', 'deleted', count(*) FROM ({ST.ORACLE['wn09_log_cleanup']}) UNION ALL SELECT 'rewrite packs', 'short packs', count(*) FROM ({ST.ORACLE['wn16_short_packs']}) UNION ALL SELECT 'expire snapshots', 'expired', count(*) FROM ({SQ.ORACLE['wn03_expired']})")
def ag23_task_records(t):
    """Counters of seven maintenance tasks, one row each."""
    run = lambda name: next(m.QUERIES[name] for m in (T, ST, FU, SQ) if name in m.QUERIES)(t.spark, t.base)
    out = None
    for task, (name, col) in _TASKS.items():
        part = run(name).select(F.lit(task).alias("task"), F.col(col).alias("counter"), F.col("n").cast("bigint").alias("value"))
        out = part if out is None else out.unionByName(part)
    for task, name, counter in (("clean up logs", "wn09_log_cleanup", "deleted"), ("rewrite packs", "wn16_short_packs", "short packs"), ("expire snapshots", "wn03_expired", "expired")):
        out = out.unionByName(run(name).agg(F.count(F.lit(1)).alias("value")).select(F.lit(task).alias("task"), F.lit(counter).alias("counter"), "value"))
    return out


@q(f"WITH {FU._EP}, eb AS (SELECT epoch, min(s) began FROM ep WHERE epoch IS NOT NULL GROUP BY 1), wr AS (SELECT event_id, epoch_us(ts) // 1000000 a, epoch_us(ts) // 1000000 + (event_id % 100 + 1) * 900 b FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL), fs AS (SELECT wr.*, eb.epoch e1 FROM wr ASOF LEFT JOIN eb ON wr.a >= eb.began), ls AS (SELECT fs.*, eb.epoch e2 FROM fs ASOF LEFT JOIN eb ON fs.b >= eb.began) SELECT event_id write_id, e1 AS epoch, CASE WHEN e1 IS NULL THEN 'no epoch' WHEN e2 >= e1 + 2 THEN 'too slow' ELSE 'kept' END outcome FROM ls")
def ep08_slow_writes(t):
    """Writes judged by the epochs current when they start and end: purchases stand for writes."""
    epochs = FU._epochs(t).groupBy("epoch").agg(F.min("ts").alias("began"))
    at = F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)")
    w = t.events.filter("event_type = 'purchase' and ts is not null").select(F.col("event_id").alias("write_id"), at.alias("started"), (at + (F.col("event_id") % 100 + 1) * 900).alias("ended"))
    return E.judged_writes(w, epochs)


_ZIP = """c1 AS (SELECT policy_id, json_extract(p, '$.compression') v FROM p1 WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
c2 AS (SELECT policy_id, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END v FROM c1 WHERE v IS NOT NULL),
c3 AS (SELECT policy_id, nullif(v->>'compressorName', '') name, CASE WHEN json_type(v->'neverCompress') = 'ARRAY' THEN list_transform((v->'neverCompress')::VARCHAR[], lambda x: ltrim(x, '*')) ELSE [] END nv FROM c2),
pk AS (SELECT host_name, user_name, source_path, min(policy_id) policy_id FROM po GROUP BY ALL),
ent AS (SELECT DISTINCT manifest_id, entry_path, file_size, regexp_extract(entry_path, '(\\.[^./]*)$', 1) ext FROM snapshot_entries WHERE manifest_id IS NOT NULL AND entry_path IS NOT NULL AND file_size IS NOT NULL),
jo AS (SELECT e.*, c3.name, c3.nv FROM ent e JOIN sn USING (manifest_id) JOIN pk ON sn.host_name IS NOT DISTINCT FROM pk.host_name AND sn.user_name IS NOT DISTINCT FROM pk.user_name AND sn.source_path IS NOT DISTINCT FROM pk.source_path LEFT JOIN c3 ON c3.policy_id = pk.policy_id)"""


@q(sql(SN, PO, LV, _ZIP, "SELECT chosen, count(*) n FROM (SELECT CASE WHEN name IS NULL OR name = 'none' THEN '' WHEN file_size > 1000000000 THEN '' WHEN list_contains(coalesce(nv, []), ext) THEN '' ELSE name END chosen FROM jo) GROUP BY 1"))
def fi13_policy_compressor(t):
    """Compressor of every listed file by its source's own policy, up to a gigabyte."""
    live = T._policies(t)
    own = live.groupBy(*SOURCE).agg(F.min("policy_id").alias("policy_id"))
    leaves = nested.policy_leaves(nested.nested_nodes(live.filter("payload is not null"), "policy_id", "payload", ("compression",), ("neverCompress",)))
    name = F.max(F.when(F.col("field_path") == "compression.compressorName", F.col("leaf_text"))).alias("name")
    never = F.collect_set(F.when(F.col("field_path") == "compression.neverCompress", F.regexp_replace("leaf_text", "^[*]+", ""))).alias("never")
    at = R.null_safe(t.snapshots.select("manifest_id", *SOURCE), own.join(leaves.groupBy("policy_id").agg(name, never), "policy_id", "left"), SOURCE, "inner")
    e = t.snapshot_entries.filter("manifest_id is not null and entry_path is not null and file_size is not null").select("manifest_id", "entry_path", "file_size").distinct()
    zero, none = F.lit(0), F.array().cast("array<string>")
    chosen = P.compressor(F.col("name"), F.regexp_extract("entry_path", r"(\.[^./]*)$", 1), F.col("file_size"), zero, F.lit(1_000_000_000), none, F.col("never"))
    return e.join(at.select("manifest_id", "name", "never"), "manifest_id").groupBy(chosen.alias("chosen")).agg(F.count(F.lit(1)).alias("n"))


@q(sql(SN, f"l AS (SELECT host_name, max(end_time) FILTER (WHERE complete) f, max(end_time) k, bool_or(user_name = 'root') o FROM sn GROUP BY 1)", f"SELECT host_name, CASE WHEN NOT coalesce(o, false) THEN 'none' WHEN f IS NULL OR {CUT} - f >= INTERVAL 24 HOUR THEN 'full' WHEN k IS NULL OR {CUT} - k >= INTERVAL 1 HOUR THEN 'quick' ELSE 'none' END AS mode FROM l"))
def ms09_modes(t):
    """Maintenance due on each host: full a day after the last complete run, quick an hour after any;
    hosts of the user root own theirs."""
    last = t.snapshots.groupBy("host_name").agg(F.max(F.when(F.col("complete"), F.col("end_time"))).alias("f"), F.max("end_time").alias("k"), F.max(F.col("user_name") == "root").alias("o"))
    due = lambda c, hours: F.col(c).isNull() | (cut() - F.col(c) >= F.expr(f"interval {hours} hours"))
    return last.select("host_name", P.maintenance_mode(F.col("o"), due("f", 24), due("k", 1)).alias("mode"))
