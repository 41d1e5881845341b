"""Queries over the blob store and the content index (SC, FI, IX, parts of JN, AG, WN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import blobs as B
from moraine.operators import contents as C
from moraine.operators import packindex
from moraine.plans.base import BL, CW, Registry, sql
from moraine.session import scratch_path

q = Registry()
QUERIES, ORACLE = q.QUERIES, q.ORACLE

CUT = "timestamp '2024-06-01'"
SECONDS = 1_717_200_000  # 2024-06-01


def moment():
    return F.expr("timestamp_ntz'2024-06-01 00:00:00'")


def seconds(c):
    return F.expr(f"cast(unix_micros(cast({c} as timestamp)) div 1000000 as bigint)")


# -- scans --------------------------------------------------------------------------------------
@q(sql(BL, "SELECT blob_id, blob_length FROM bl WHERE NOT deleted AND blob_id LIKE 'p%'"))
def sc01_list_prefix(t):
    return B.with_prefix(t.live_blobs, "p").select("blob_id", "blob_length")


@q("SELECT count(*) n, count(blob_length) n_sized, sum(blob_length)::BIGINT bytes FROM pack_blobs")
def sc02_list_all(t):
    return t.pack_blobs.agg(F.count(F.lit(1)).alias("n"), F.count("blob_length").alias("n_sized"), F.sum("blob_length").alias("bytes"))


@q(sql(BL, "SELECT p scanned, count(*) n FROM bl JOIN (VALUES ('p'), ('q'), ('p3')) v(p) ON starts_with(blob_id, p) WHERE NOT deleted GROUP BY p"))
def sc03_prefix_scans(t):
    return B.prefix_scans(t.live_blobs, ["p", "q", "p3"]).groupBy("scanned").agg(F.count(F.lit(1)).alias("n"))


@q(sql(BL, "SELECT blob_id, blob_length, deleted FROM bl"))
def sc04_blob_map(t):
    return t.blobs.select("blob_id", "blob_length", "deleted")


@q("SELECT doc_id, CASE WHEN strlen(text) >= 24 THEN md5(encode(text)[9:24]) END part FROM documents WHERE text IS NOT NULL")
def sc05_byte_range(t):
    data = F.col("text").cast("binary")
    return t.documents.filter("text is not null").select("doc_id", F.md5(B.byte_range(data, 8, 16)).alias("part"))


@q("SELECT doc_id, n_chars, source FROM documents WHERE doc_id = 17")
def sc06_point_metadata(t):
    return t.documents.filter("doc_id = 17").select("doc_id", "n_chars", "source")


@q("SELECT blob_id, count(*) n FROM pack_blobs WHERE blob_id IS NOT NULL AND blob_id NOT IN (SELECT blob_id FROM pack_blobs WHERE deleted AND blob_id IS NOT NULL) GROUP BY blob_id")
def sc07_delete_many(t):
    gone = t.pack_blobs.filter("deleted and blob_id is not null")
    return B.without(t.pack_blobs.filter("blob_id is not null"), gone, "blob_id").groupBy("blob_id").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT blob_id, CASE WHEN length(blob_id) > 4 THEN blob_id[1:1] || '/' || blob_id[2:4] || '/' || blob_id[5:] WHEN length(blob_id) > 1 THEN blob_id[1:1] || '/' || blob_id[2:] ELSE blob_id END || '.f' path FROM (SELECT DISTINCT blob_id FROM pack_blobs WHERE blob_id IS NOT NULL)")
def sc09_sharded_path(t):
    return t.pack_blobs.filter("blob_id is not null").select("blob_id").distinct().select("blob_id", B.resharded_path(F.col("blob_id"), [1, 3]).alias("path"))


@q(f"SELECT blob_id, blob_ts, blob_length FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY blob_ts DESC, coalesce(deleted, false), blob_length DESC NULLS LAST) r FROM pack_blobs WHERE blob_id IS NOT NULL AND blob_ts <= {CUT}) WHERE r = 1 AND NOT coalesce(deleted, false)")
def sc10_as_of(t):
    return B.as_of(t.pack_blobs, "blob_id", "blob_ts", moment())


@q("SELECT index_blob_id, count(*) n_entries, count(DISTINCT content_id) n_contents FROM content_entries GROUP BY index_blob_id")
def sc11_index_rows(t):
    return t.content_entries.groupBy("index_blob_id").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("content_id").alias("n_contents"))


@q(sql(CW, "SELECT content_id, packed_length FROM cw WHERE content_id >= '4' AND content_id < '5'"))
def sc12_range_scan(t):
    return C.merged(C.id_range(t.content_entries, "4", "5")).select("content_id", "packed_length")


@q("SELECT content_id, timestamp_seconds, deleted FROM content_entries WHERE content_id = (SELECT min(content_id) FROM content_entries)")
def sc13_point_lookup(t):
    first = t.content_entries.agg(F.min("content_id")).first()[0]
    return t.content_entries.filter(F.col("content_id") == first).select("content_id", "timestamp_seconds", "deleted")


@q(sql(CW, "SELECT count(*) n, min(content_id) first_id, max(content_id) last_id FROM cw"))
def sc14_write_index(t):
    path = scratch_path(t.spark, "index")
    t.contents.repartitionByRange("content_id").sortWithinPartitions("content_id").write.parquet(path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min("content_id").alias("first_id"), F.max("content_id").alias("last_id"))


@q("SELECT pack_blob_id, count(*) n, sum(packed_length)::BIGINT bytes FROM (SELECT DISTINCT pack_blob_id, content_id, pack_offset, packed_length, original_length FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL AND NOT coalesce(deleted, false) AND pack_blob_id IS NOT NULL) GROUP BY 1")
def sc15_recover(t):
    return C.recovered(t.content_entries).groupBy("pack_blob_id").agg(F.count(F.lit(1)).alias("n"), F.sum("packed_length").alias("bytes"))


@q("SELECT content_id, to_json({'content_id': content_id, 'live': live, 'timestamp_seconds': timestamp_seconds}) line FROM cw".join(["WITH " + CW + " ", ""]))
def sc21_json_lines(t):
    return t.contents.select("content_id", F.to_json(F.struct("content_id", "live", "timestamp_seconds")).alias("line"))


# -- filters ------------------------------------------------------------------------------------
@q(sql(CW, "SELECT CASE WHEN content_id >= 'g' THEN 'prefixed' ELSE 'plain' END kind, count(*) n FROM cw GROUP BY 1"))
def fi03_id_ranges(t):
    a = C.id_range(t.contents, *C.PREFIXED).agg(F.count(F.lit(1)).alias("n")).select(F.lit("prefixed").alias("kind"), "n")
    return a.unionByName(C.id_range(t.contents, *C.UNPREFIXED).agg(F.count(F.lit(1)).alias("n")).select(F.lit("plain").alias("kind"), "n")).filter("n > 0")


_HALF = CW.replace("cw AS", "{0} AS").replace("timestamp_seconds IS NOT NULL)", "timestamp_seconds IS NOT NULL AND {1})")
_OLD, _NEW = _HALF.format("c0", f"timestamp_seconds < {SECONDS}"), _HALF.format("c1", f"timestamp_seconds >= {SECONDS}")


@q(sql(_OLD, _NEW, "SELECT c0.content_id, 'committed' origin, c0.timestamp_seconds FROM c0 LEFT JOIN c1 USING (content_id) WHERE coalesce(c1.live, c0.live) UNION ALL SELECT content_id, 'pending', timestamp_seconds FROM c1 WHERE live"))
def fi04_overlay(t):
    e = t.content_entries
    old, new = C.merged(e.filter(F.col("timestamp_seconds") < SECONDS)), C.merged(e.filter(F.col("timestamp_seconds") >= SECONDS))
    return C.overlaid(old, new).select("content_id", "origin", "timestamp_seconds")


@q(sql(CW, f"SELECT live, count(*) n FROM cw WHERE live OR timestamp_seconds > {SECONDS} GROUP BY live"))
def fi05_watermark(t):
    return C.above_watermark(t.contents, SECONDS).groupBy("live").agg(F.count(F.lit(1)).alias("n"))


@q(sql(BL, "SELECT blob_id, blob_length FROM bl WHERE NOT deleted AND NOT starts_with(blob_id, 'n') AND NOT starts_with(blob_id, 'x') AND NOT starts_with(blob_id, '_log_') AND blob_length >= 1000000 AND blob_length <= 30000000 AND NOT starts_with(blob_id, 'q')"))
def fi06_blob_list(t):
    return B.listed(t.live_blobs, data_only=True, min_size=1_000_000, max_size=30_000_000, exclude=["q"]).select("blob_id", "blob_length")


@q(sql(CW, "SELECT content_id, timestamp_seconds, packed_length, original_length FROM cw WHERE NOT live"))
def fi07_only_deleted(t):
    return t.contents.filter("not live").select("content_id", "timestamp_seconds", "packed_length", "original_length")


@q("SELECT index_blob_id, CASE WHEN coalesce(deleted, false) THEN 'deleted' ELSE 'created' END state, count(*) n, sum(packed_length)::BIGINT bytes FROM content_entries GROUP BY ALL")
def fi08_index_inspect(t):
    state = F.when(F.coalesce("deleted", F.lit(False)), "deleted").otherwise("created")
    return t.content_entries.groupBy("index_blob_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("packed_length").alias("bytes"))


@q(sql(BL, "SELECT blob_id[1:1] prefix, count(*) n, sum(blob_length)::BIGINT bytes FROM bl WHERE NOT deleted AND blob_id[1:1] IN ('p', 'q', 'n', 'x') GROUP BY 1"))
def fi14_lock_prefixes(t):
    hit = B.prefix_scans(t.live_blobs, ["p", "q", "n", "x"])
    return hit.groupBy(F.col("scanned").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("blob_length").alias("bytes"))


@q()
def fi17_sample(t):
    """A hash sample of about one content in ten: the same rows on every run."""
    return t.contents.filter(F.pmod(F.xxhash64("content_id"), F.lit(100)) < 10).select("content_id")


# -- index merge --------------------------------------------------------------------------------
@q(sql(CW, "SELECT content_id, pack_blob_id, timestamp_seconds, live FROM cw"))
def ix01_winner(t):
    return t.contents.select("content_id", "pack_blob_id", "timestamp_seconds", "live")


@q(sql(CW, "SELECT content_id, timestamp_seconds, live, pack_blob_id, original_length, packed_length, pack_offset FROM cw ORDER BY content_id"))
def ix02_merged_index(t):
    return t.contents.select("content_id", "timestamp_seconds", "live", "pack_blob_id", "original_length", "packed_length", "pack_offset").orderBy("content_id")


@q(sql(CW, "SELECT content_id, live, pack_blob_id FROM cw WHERE content_id = (SELECT min(content_id) FROM content_entries)"))
def ix03_point(t):
    first = t.content_entries.agg(F.min("content_id")).first()[0]
    return C.point_lookup(t.content_entries, first).select("content_id", "live", "pack_blob_id")


@q(sql(CW, "SELECT content_id, timestamp_seconds, live FROM cw"))
def ix04_builder_upsert(t):
    """Adding the later half to the merged earlier half gives the merged whole."""
    e = C.usable(t.content_entries)
    old = C.merged(e.filter(F.col("timestamp_seconds") < SECONDS)).withColumn("deleted", ~F.col("live")).drop("live")
    cols = old.columns
    return C.merged(old.unionByName(e.filter(F.col("timestamp_seconds") >= SECONDS).select(*cols))).select("content_id", "timestamp_seconds", "live")


@q("SELECT count(*) FILTER (WHERE n < 100) small_indexes, count(*) FILTER (WHERE n >= 100) large_indexes, sum(n) FILTER (WHERE n < 100)::BIGINT small_entries FROM (SELECT index_blob_id, count(*) n FROM content_entries GROUP BY 1)")
def ix05_small_indexes(t):
    n = t.content_entries.groupBy("index_blob_id").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < 100
    return n.agg(F.count(F.when(small, 1)).alias("small_indexes"), F.count(F.when(~small, 1)).alias("large_indexes"), F.sum(F.when(small, F.col("n"))).alias("small_entries"))


_PUT = "us AS (SELECT *, NOT coalesce(deleted, false) live FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL AND index_blob_id IS NOT NULL), sz AS (SELECT index_blob_id, count(DISTINCT content_id) < 100 small FROM us GROUP BY 1), pt AS (SELECT us.*, CASE WHEN small AND (SELECT count(*) FROM sz WHERE small) > 1 THEN 'combined' ELSE index_blob_id END in_index FROM us JOIN sz USING (index_blob_id))"


@q(sql(_PUT, "SELECT in_index, content_id, timestamp_seconds, live, pack_blob_id FROM (SELECT *, row_number() OVER (PARTITION BY in_index, content_id ORDER BY timestamp_seconds DESC, live DESC, pack_blob_id DESC NULLS LAST) rn FROM pt) WHERE rn = 1"))
def ix05_combined_indexes(t):
    """Index blobs below 100 ids merged into one, large ones kept."""
    return C.combined_indexes(t.content_entries).select("in_index", "content_id", "timestamp_seconds", "live", "pack_blob_id")


@q()
def ix06_shards(t):
    return C.sharded(t.contents, 16).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


_IXB = "ib AS (SELECT index_blob_id, count(*) * 60 len FROM content_entries WHERE index_blob_id IS NOT NULL GROUP BY 1), k AS (SELECT *, len < 24000 // 20 tiny FROM ib WHERE len <= 24000), c AS (SELECT count(*) n, count(*) FILTER (WHERE tiny) t FROM k)"


@q(f"WITH {_IXB} SELECT index_blob_id, len FROM k, c WHERE n >= 8 AND (NOT (t > n // 2 AND n - t + 1 < 8) OR tiny)")
def ix07_compaction_choice(t):
    """Index blobs to compact, at 60 bytes an entry: of those up to the pack size the very small
    ones if they are the majority and few others are left, else all; none below 8."""
    ib = t.content_entries.filter("index_blob_id is not null").groupBy("index_blob_id").agg((F.count(F.lit(1)) * 60).alias("len"))
    k = ib.filter("len <= 24000").withColumn("tiny", F.col("len") < 24000 // 20)
    c = k.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("tiny"), 1)).alias("t")).first()
    if c.n < 8:
        return k.filter("false").select("index_blob_id", "len")
    only = c.t > c.n // 2 and c.n - c.t + 1 < 8
    return (k.filter("tiny") if only else k).select("index_blob_id", "len")


@q(sql(CW, f"SELECT live, count(*) n, sum(timestamp_seconds)::BIGINT s FROM cw WHERE (live OR timestamp_seconds >= {SECONDS}) AND content_id NOT IN (SELECT content_id FROM content_entries WHERE content_id IS NOT NULL GROUP BY 1 HAVING count(*) > 20) GROUP BY live"))
def ix08_compaction(t):
    often = t.content_entries.filter("content_id is not null").groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 20")
    return C.compacted(t.content_entries, often, SECONDS).groupBy("live").agg(F.count(F.lit(1)).alias("n"), F.sum("timestamp_seconds").alias("s"))


@q("WITH a AS (SELECT index_blob_id, max(arrived_at) last FROM content_entries WHERE index_blob_id IS NOT NULL GROUP BY 1) SELECT index_blob_id FROM a WHERE last >= (SELECT max(last) FROM a) - INTERVAL 90 DAY")
def ix09_active_indexes(t):
    a = t.content_entries.filter("index_blob_id is not null").groupBy("index_blob_id").agg(F.max("arrived_at").alias("last"))
    top = a.agg(F.max("last")).first()[0]
    return a.filter(F.col("last") >= F.lit(top).cast("timestamp_ntz") - F.expr("interval 90 days")).select("index_blob_id")


@q("WITH a AS (SELECT index_blob_id, max(arrived_at) last FROM content_entries WHERE index_blob_id IS NOT NULL GROUP BY 1) SELECT index_blob_id FROM a WHERE last < (SELECT max(last) FROM a) - INTERVAL 90 DAY")
def ix10_delayed_cleanup(t):
    a = t.content_entries.filter("index_blob_id is not null").groupBy("index_blob_id").agg(F.max("arrived_at").alias("last"))
    top = a.agg(F.max("last")).first()[0]
    return a.filter(F.col("last") < F.lit(top).cast("timestamp_ntz") - F.expr("interval 90 days")).select("index_blob_id")


@q(sql(_OLD, _NEW, "SELECT c1.content_id, greatest(c1.timestamp_seconds, coalesce(c0.timestamp_seconds + 1, c1.timestamp_seconds)) timestamp_seconds FROM c1 LEFT JOIN c0 USING (content_id) WHERE NOT coalesce(c0.live, false)"))
def ix11_write_path(t):
    e = t.content_entries
    old, new = C.merged(e.filter(F.col("timestamp_seconds") < SECONDS)), C.merged(e.filter(F.col("timestamp_seconds") >= SECONDS))
    return C.deduplicated_writes(old, new).select("content_id", "timestamp_seconds")


@q(sql(CW, BL, f"SELECT content_id, greatest({SECONDS}, timestamp_seconds + 1) timestamp_seconds, false live FROM cw WHERE live AND pack_blob_id IN (SELECT blob_id FROM bl WHERE deleted)"))
def ix12_tombstones(t):
    gone = t.blobs.filter("deleted").select(F.col("blob_id").alias("pack_blob_id"))
    ids = t.contents.join(gone, "pack_blob_id", "left_semi")
    return C.tombstones(t.contents, ids, SECONDS).select("content_id", "timestamp_seconds", "live")


@q(sql(CW, "SELECT content_id, coalesce(sum(packed_length) OVER (PARTITION BY content_id[1:2] ORDER BY content_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 20971520 bin FROM cw WHERE live"))
def ix13_bins(t):
    live = t.contents.filter("live").withColumn("_p", F.substring("content_id", 1, 2))
    return C.packed_bins(live, "packed_length", ["content_id"], 20 << 20, ["_p"]).select("content_id", "bin")


@q(sql(CW, "SELECT content_id, kind, coalesce(sum(packed_length) OVER (PARTITION BY kind ORDER BY content_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 20971520 bin FROM (SELECT *, CASE WHEN regexp_matches(content_id, '^[g-z]') THEN 'q' ELSE 'p' END kind FROM cw WHERE live)"))
def ix13_kind_bins(t):
    """Packs of 20 MiB per pack kind; ``ix13_bins`` packs per first two characters of the id."""
    live = t.contents.filter("live").withColumn("kind", C.pack_kind(F.col("content_id")))
    return C.packed_bins(live, "packed_length", ["content_id"], 20 << 20, ["kind"]).select("content_id", "kind", "bin")


_SHORT = "pk AS (SELECT pack_blob_id, count(*) n_contents, sum(packed_length)::BIGINT packed_bytes, pack_blob_id[1:1] p FROM cw WHERE live AND pack_blob_id IS NOT NULL GROUP BY 1), sh AS (SELECT * FROM pk WHERE packed_bytes < 20971520 * 60 // 100 AND p IN (SELECT p FROM pk WHERE packed_bytes < 20971520 * 60 // 100 GROUP BY p HAVING count(*) >= 2))"


@q(sql(CW, _SHORT, f"SELECT count(*) n, coalesce(sum(packed_length), 0)::BIGINT bytes FROM cw WHERE live AND pack_blob_id IN (SELECT pack_blob_id FROM sh) AND timestamp_seconds < {SECONDS}"))
def ix14_rewrite(t):
    live = t.contents.filter("live")
    old = live.join(C.short_packs(live, 20 << 20).select("pack_blob_id"), "pack_blob_id", "left_semi").filter(F.col("timestamp_seconds") < SECONDS)
    return old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("packed_length"), F.lit(0)).alias("bytes"))


@q(sql(CW, _SHORT, "SELECT pack_blob_id, n_contents, packed_bytes FROM sh"))
def wn16_short_packs(t):
    return C.short_packs(t.contents.filter("live"), 20 << 20).select("pack_blob_id", "n_contents", "packed_bytes")


@q("WITH b AS (SELECT DISTINCT index_blob_id || '-s' || index_blob_id[1:10] || '-c' || (length(index_blob_id) % 3 + 1) id FROM content_entries WHERE index_blob_id IS NOT NULL), g AS (SELECT regexp_extract(id, '-s([^-]+)-c', 1) set_id, regexp_extract(id, '-c([0-9]+)$', 1)::INT n, list_sort(list(id)) members FROM b GROUP BY 1, 2) SELECT set_id, len(members)::INT n_members, members[1] first_member FROM g WHERE len(members) >= n")
def ix15_complete_sets(t):
    i = F.col("index_blob_id")
    named = t.content_entries.filter("index_blob_id is not null").select(F.concat(i, F.lit("-s"), F.substring(i, 1, 10), F.lit("-c"), (F.length(i) % 3 + 1).cast("string")).alias("blob_id"))
    return B.complete_sets(named).select("set_id", F.size("members").alias("n_members"), F.get("members", F.lit(0)).alias("first_member"))


@q(sql(CW, "SELECT pack_blob_id, count(*) n_contents, sum(packed_length)::BIGINT packed_bytes FROM cw WHERE live GROUP BY 1 HAVING count(*) >= 2 AND sum(packed_length) >= 5000000"))
def ix19_prefetch(t):
    return C.prefetch_packs(t.contents.filter("live"))


# -- aggregates ---------------------------------------------------------------------------------
@q(sql(CW, "SELECT count(*) n, sum(packed_length)::BIGINT total FROM cw"))
def ag01_count_sum(t):
    return t.contents.agg(F.count(F.lit(1)).alias("n"), F.sum("packed_length").alias("total"))


@q("SELECT format_version, count(*) n FROM content_entries GROUP BY 1")
def ag02_counters(t):
    return t.content_entries.groupBy("format_version").agg(F.count(F.lit(1)).alias("n"))


@q(sql(CW, "SELECT pack_blob_id, count(*) n_contents, sum(packed_length)::BIGINT packed_bytes, max(pack_offset + packed_length) extent FROM cw GROUP BY 1"))
def ag03_pack_usage(t):
    return C.pack_usage(t.contents)


@q(sql(CW, "SELECT compression_id, count(*) n, sum(original_length)::BIGINT original_bytes, sum(packed_length)::BIGINT packed_bytes, sum(packed_length)::BIGINT // count(*) average FROM cw GROUP BY 1"))
def ag04_content_stats(t):
    return C.content_stats(t.contents)


def _hist(column, src):
    k = "CASE " + " ".join(f"WHEN {column} < {10**i} THEN {i}" for i in range(1, 9)) + " END"
    return f"SELECT size_class, count(*) n, sum({column})::BIGINT bytes FROM (SELECT {k} size_class, {column} FROM {src}) WHERE size_class IS NOT NULL GROUP BY 1"


@q(sql(CW, _hist("packed_length", "cw")))
def ag04_size_histogram(t):
    return C.size_histogram(t.contents, "packed_length")


@q(sql(BL, _hist("blob_length", "bl WHERE NOT deleted")))
def ag05_blob_histogram(t):
    return C.size_histogram(t.live_blobs, "blob_length")


@q(sql(BL, "SELECT sum(blob_length)::BIGINT total, min(blob_ts) first_ts, max(blob_ts) last_ts FROM bl WHERE NOT deleted"))
def ag11_blob_extent(t):
    return t.live_blobs.agg(F.sum("blob_length").alias("total"), F.min("blob_ts").alias("first_ts"), F.max("blob_ts").alias("last_ts"))


@q("SELECT epoch, count(*) n, sum(sz)::BIGINT bytes, max(t) - min(t) span FROM (SELECT timestamp_seconds // 2592000 epoch, timestamp_seconds t, packed_length sz FROM content_entries WHERE timestamp_seconds IS NOT NULL) GROUP BY 1")
def ag12_epochs(t):
    e = t.content_entries.filter("timestamp_seconds is not null").withColumn("epoch", F.expr("timestamp_seconds div 2592000"))
    return e.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("packed_length").alias("bytes"), (F.max("timestamp_seconds") - F.min("timestamp_seconds")).alias("span"))


_LOGS = "lg AS (SELECT '_log_' || user_id || '_' || event_type || '_' || (epoch_us(ts) // 1000000) || '_' || ((epoch_us(ts) // 1000000) + event_id % 900) || '_' || event_id || '_x' blob_id, event_id % 5000 blob_length FROM events)"


def _logs(t):
    s = seconds("ts")
    e = t.events
    return e.select(F.concat_ws("_", F.lit("_log"), F.col("user_id"), F.col("event_type"), s, s + F.col("event_id") % 900, F.col("event_id"), F.lit("x")).alias("blob_id"), (F.col("event_id") % 5000).alias("blob_length"), F.col("ts").alias("blob_ts"), s.alias("ts"))


@q(f"WITH {_LOGS}, p AS (SELECT string_split(blob_id, '_') p, blob_length FROM lg) SELECT p[3] || '_' || p[4] session_id, min(p[5]::BIGINT) started, max(p[6]::BIGINT) ended, sum(blob_length)::BIGINT bytes, count(*) segments FROM p WHERE len(p) >= 8 GROUP BY 1")
def ag13_log_sessions(t):
    return B.log_sessions(_logs(t))


@q(f"WITH {_LOGS}, p AS (SELECT string_split(blob_id, '_') p FROM lg), s AS (SELECT p[3] || '_' || p[4] session_id, min(p[5]::BIGINT) started FROM p WHERE len(p) >= 8 GROUP BY 1) SELECT session_id, started FROM s ORDER BY started DESC, session_id DESC LIMIT 20")
def fi16_latest_sessions(t):
    return B.log_sessions(_logs(t)).select("session_id", "started").orderBy(F.desc("started"), F.desc("session_id")).limit(20)


@q("SELECT count(*) writes, count(DISTINCT content_id) distinct_contents, count(*) - count(DISTINCT content_id) deduplicated, (SELECT sum((n - 1) * o)::BIGINT FROM (SELECT count(*) n, max(original_length) o FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL AND NOT coalesce(deleted, false) GROUP BY content_id)) deduplicated_bytes, (SELECT sum(greatest(o - p, 0))::BIGINT FROM (SELECT max(original_length) o, max(packed_length) p FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL AND NOT coalesce(deleted, false) GROUP BY content_id)) compression_saved FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL AND NOT coalesce(deleted, false)")
def ag25_dedup(t):
    return C.dedup_counters(t.content_entries)


@q("SELECT regexp_replace(entry_path, '/?[^/]*$', '') folder, count(*) n, sum(file_size)::BIGINT bytes FROM snapshot_entries WHERE entry_path IS NOT NULL GROUP BY 1")
def ag24_folder_usage(t):
    return B.usage_by_folder(t.snapshot_entries.filter("entry_path is not null"), "entry_path", "file_size")


# -- joins --------------------------------------------------------------------------------------
_UNREF = "un AS (SELECT blob_id, blob_length, (epoch_us(blob_ts) // 1000000) ts FROM bl WHERE NOT deleted AND blob_id[1:1] IN ('p', 'q', 's') AND blob_id NOT IN (SELECT pack_blob_id FROM content_entries WHERE pack_blob_id IS NOT NULL))"


@q(sql(BL, _UNREF, "SELECT blob_id, blob_length FROM un"))
def jn01_unreferenced(t):
    return B.unreferenced(t.live_blobs, t.content_entries).select("blob_id", "blob_length")


@q(sql(BL, _UNREF, f"SELECT CASE WHEN ts > {SECONDS + 1} THEN 'after cutoff' WHEN {SECONDS + 1} - ts < 2592000 THEN 'too young' ELSE 'unreferenced' END fate, count(*) n, sum(blob_length)::BIGINT bytes FROM un GROUP BY 1"))
def jn02_pack_garbage(t):
    orphaned = B.unreferenced(t.live_blobs, t.content_entries).withColumn("ts", F.expr("cast(floor(unix_micros(cast(blob_ts as timestamp)) / 1000000) as bigint)"))
    none = t.spark.createDataFrame([], "session_id string, checkpoint bigint")
    return B.pack_garbage(orphaned, none, SECONDS, 2_592_000, 3_600).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.sum("blob_length").alias("bytes"))


@q(sql(BL, _UNREF, "nm AS (SELECT *, 's' || substr(blob_id, 2, 1) sid FROM un)", "ss AS (SELECT 's' || substr(blob_id, 2, 1) sid, max(epoch_us(blob_ts) // 1000000) cp FROM bl WHERE NOT deleted GROUP BY 1)", f"SELECT CASE WHEN ts > {SECONDS + 1} THEN 'after cutoff' WHEN {SECONDS + 1} - ts < 2592000 THEN 'too young' WHEN {SECONDS + 1} - cp < 3600 THEN 'active session' ELSE 'unreferenced' END fate, count(*) n, sum(blob_length)::BIGINT bytes FROM nm LEFT JOIN ss USING (sid) GROUP BY 1"))
def jn02_session_garbage(t):
    """Unreferenced packs with the sessions that wrote them: the second character of a blob's id
    stands for its session, whose checkpoint is its newest blob."""
    named = F.concat("blob_id", F.lit("-s"), F.substring("blob_id", 2, 1)).alias("blob_id")
    ts = F.expr("cast(floor(unix_micros(cast(blob_ts as timestamp)) / 1000000) as bigint)").alias("ts")
    orphaned = B.unreferenced(t.live_blobs, t.content_entries).select(named, "blob_length", ts)
    sessions = t.live_blobs.select(F.concat(F.lit("s"), F.substring("blob_id", 2, 1)).alias("session_id"), ts).groupBy("session_id").agg(F.max("ts").alias("checkpoint"))
    return B.pack_garbage(orphaned, sessions, SECONDS, 2_592_000, 3_600).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.sum("blob_length").alias("bytes"))


_VER = "ver AS (SELECT c.content_id, c.pack_blob_id, c.packed_length, CASE WHEN b.blob_id IS NULL THEN 'missing' WHEN (pack_offset + packed_length) % 4294967296 > blob_length THEN 'truncated' ELSE 'ok' END state FROM cw c LEFT JOIN bl b ON b.blob_id = c.pack_blob_id AND NOT b.deleted WHERE c.live)"


@q(sql(CW, BL, _VER, "SELECT state, pack_blob_id, count(*) n, sum(packed_length)::BIGINT bytes FROM ver GROUP BY ALL"))
def jn05_verify(t):
    return C.verify(t.contents, t.live_blobs).groupBy("state", "pack_blob_id").agg(F.count(F.lit(1)).alias("n"), F.sum("packed_length").alias("bytes"))


@q(sql(BL, f"SELECT coalesce(a.blob_id, b.blob_id) blob_id, CASE WHEN b.blob_id IS NULL THEN 'copy' WHEN a.blob_id IS NULL THEN 'delete' WHEN a.blob_ts > b.blob_ts THEN 'copy' ELSE 'in-sync' END AS action FROM (SELECT * FROM bl WHERE NOT deleted) a FULL JOIN (SELECT blob_id, max(blob_ts) blob_ts FROM pack_blobs WHERE blob_ts < {CUT} AND NOT coalesce(deleted, false) GROUP BY 1) b ON a.blob_id = b.blob_id"))
def jn08_sync(t):
    dst = t.pack_blobs.filter((F.col("blob_ts") < moment()) & ~F.coalesce("deleted", F.lit(False))).groupBy("blob_id").agg(F.max("blob_ts").alias("blob_ts")).withColumn("blob_length", F.lit(0).cast("bigint"))
    return B.sync_plan(t.live_blobs, dst, update=True, delete=True).select("blob_id", "action")


@q("WITH x AS (SELECT DISTINCT index_blob_id, pack_blob_id FROM content_entries WHERE index_blob_id IS NOT NULL AND pack_blob_id IS NOT NULL), l AS (SELECT DISTINCT blob_id FROM pack_blobs WHERE NOT coalesce(deleted, false) AND blob_id IS NOT NULL) SELECT index_blob_id FROM x LEFT JOIN l ON blob_id = pack_blob_id GROUP BY 1 HAVING bool_and(blob_id IS NOT NULL)")
def jn14_all_present(t):
    """Index blobs all of whose packs were ever stored (relational division)."""
    x = t.content_entries.filter("index_blob_id is not null and pack_blob_id is not null").select("index_blob_id", "pack_blob_id").distinct()
    held = t.pack_blobs.filter("not coalesce(deleted, false) and blob_id is not null").select(F.col("blob_id").alias("pack_blob_id")).distinct().withColumn("_h", F.lit(True))
    return x.join(held, "pack_blob_id", "left").groupBy("index_blob_id").agg(F.min(F.coalesce("_h", F.lit(False))).alias("all")).filter("all").select("index_blob_id")


# -- windows ------------------------------------------------------------------------------------
@q(f"WITH lg AS (SELECT 'l' || event_id blob_id, event_id % 5000 blob_length, (epoch_us(ts) // 1000000) ts FROM events), r AS (SELECT *, sum(blob_length) OVER w s, count(*) OVER w c FROM lg WINDOW w AS (ORDER BY ts DESC, blob_id ROWS UNBOUNDED PRECEDING)) SELECT blob_id FROM r WHERE s > 9000000 OR c > 4000 OR {1_706_400_000} - ts > 1000000")
def wn09_log_cleanup(t):
    logs = t.events.select(F.concat(F.lit("l"), F.col("event_id")).alias("blob_id"), (F.col("event_id") % 5000).alias("blob_length"), seconds("ts").alias("ts"))
    return B.cleanup_by_budget(logs, 9_000_000, 4_000, 1_000_000, 1_706_400_000).select("blob_id")


@q(f"WITH c AS (SELECT 'c' || event_id blob_id, event_id % 5000 blob_length, (epoch_us(ts) // 1000000) ts FROM events), r AS (SELECT *, sum(blob_length) OVER (ORDER BY ts DESC, blob_id DESC ROWS UNBOUNDED PRECEDING) l FROM c) SELECT blob_id FROM r WHERE l > 5000000 AND ({1_706_400_000} - ts >= 600000 OR l > 8000000)")
def wn10_lru_sweep(t):
    items = t.events.select(F.concat(F.lit("c"), F.col("event_id")).alias("blob_id"), (F.col("event_id") % 5000).alias("blob_length"), seconds("ts").alias("ts"))
    return B.lru_sweep(items, 5_000_000, 8_000_000, 600_000, 1_706_400_000).select("blob_id")


# -- sets and sorts -----------------------------------------------------------------------------
@q(sql(CW, "SELECT content_id, packed_length FROM cw ORDER BY content_id"))
def st03_contents_by_id(t):
    return t.contents.select("content_id", "packed_length").orderBy("content_id")


@q("SELECT index_blob_id, min(arrived_at) first_arrival, count(*) n FROM content_entries GROUP BY 1 ORDER BY first_arrival, n, index_blob_id")
def st04_indexes_by_time(t):
    return t.content_entries.groupBy("index_blob_id").agg(F.min("arrived_at").alias("first_arrival"), F.count(F.lit(1)).alias("n")).orderBy("first_arrival", "n", "index_blob_id")


@q("SELECT DISTINCT content_id FROM content_entries WHERE content_id IS NOT NULL")
def se01_distinct(t):
    return t.content_entries.filter("content_id is not null").select("content_id").distinct()


@q(sql(CW, _SHORT, "SELECT content_id, count(*) n FROM (SELECT content_id FROM cw WHERE live AND pack_blob_id IN (SELECT pack_blob_id FROM sh) UNION ALL SELECT content_id FROM content_entries WHERE format_version < 2 AND content_id IS NOT NULL) GROUP BY 1"))
def se04_bag_union(t):
    live = t.contents.filter("live")
    a = live.join(C.short_packs(live, 20 << 20).select("pack_blob_id"), "pack_blob_id", "left_semi").select("content_id")
    b = t.content_entries.filter("format_version < 2 and content_id is not null").select("content_id")
    return C.rewrite_candidates([a, b]).groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))


@q(sql(_OLD, _NEW, "SELECT content_id, 'both' AS side FROM c0 SEMI JOIN c1 USING (content_id) UNION ALL SELECT content_id, 'only old' FROM c0 ANTI JOIN c1 USING (content_id)"))
def se05_intersect_except(t):
    e = C.usable(t.content_entries)
    old, new = e.filter(F.col("timestamp_seconds") < SECONDS).select("content_id"), e.filter(F.col("timestamp_seconds") >= SECONDS).select("content_id")
    return old.intersect(new).withColumn("side", F.lit("both")).unionByName(old.distinct().exceptAll(new.distinct()).withColumn("side", F.lit("only old")))


# -- binary index blobs -------------------------------------------------------------------------
_HEX = "regexp_full_match(content_id, '[g-z]?([0-9a-f][0-9a-f])+') AND timestamp_seconds BETWEEN 0 AND 4000000000 AND coalesce(pack_offset, 0) BETWEEN 0 AND 1073741823 AND coalesce(original_length, 0) BETWEEN 0 AND 268435455 AND coalesce(packed_length, 0) BETWEEN 0 AND 268435455 AND coalesce(compression_id, 0) BETWEEN 0 AND 4294967295 AND coalesce(format_version, 0) BETWEEN 0 AND 255 AND coalesce(encryption_key_id, 0) BETWEEN 0 AND 255"
_FIELDS = "content_id, timestamp_seconds, coalesce(deleted, false) deleted, nullif(coalesce(pack_blob_id, ''), '') pack_blob_id, coalesce(pack_offset, 0) pack_offset, coalesce(original_length, 0) original_length, coalesce(packed_length, 0) packed_length, coalesce(compression_id, 0)::INT compression_id, coalesce(format_version, 0)::INT format_version, coalesce(encryption_key_id, 0)::INT encryption_key_id"


def _encodable(t):
    """Distinct feed rows that the binary form can hold."""
    c, z = F.col, F.lit(0)
    ok = c("content_id").rlike("^[g-z]?([0-9a-f][0-9a-f])+$") & c("timestamp_seconds").between(0, 4_000_000_000) & F.coalesce("pack_offset", z).between(0, (1 << 30) - 1)
    for n, top in (("original_length", (1 << 28) - 1), ("packed_length", (1 << 28) - 1), ("compression_id", (1 << 32) - 1), ("format_version", 255), ("encryption_key_id", 255)):
        ok &= F.coalesce(n, z).between(0, top)
    rows = t.content_entries.filter("index_blob_id is not null").filter(ok)
    num = lambda n, kind: F.coalesce(c(n), z).cast(kind).alias(n)
    return rows.select("index_blob_id", "content_id", "timestamp_seconds", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.nullif("pack_blob_id", F.lit("")).alias("pack_blob_id"), num("pack_offset", "bigint"), num("original_length", "bigint"), num("packed_length", "bigint"), num("compression_id", "int"), num("format_version", "int"), num("encryption_key_id", "int")).distinct()


@q(f"SELECT DISTINCT index_blob_id, {_FIELDS} FROM content_entries WHERE index_blob_id IS NOT NULL AND {_HEX}")
def sc11_parsed_indexes(t):
    """Index blobs written in binary form, version 2, and parsed again."""
    return packindex.parsed(packindex.written(_encodable(t), most=2_000))


@q(f"SELECT DISTINCT index_blob_id, content_id, timestamp_seconds, coalesce(deleted, false) deleted, nullif(coalesce(pack_blob_id, ''), '') pack_blob_id, coalesce(pack_offset, 0) pack_offset, coalesce(packed_length, 0) packed_length FROM content_entries WHERE index_blob_id IS NOT NULL AND {_HEX}")
def sc14_index_version_1(t):
    """The same in version 1, which has no original length and no compression."""
    cols = ["index_blob_id", "content_id", "timestamp_seconds", "deleted", "pack_blob_id", "pack_offset", "packed_length"]
    return packindex.parsed(packindex.written(_encodable(t), version=1)).select(*cols).distinct()


@q(f"WITH e AS (SELECT DISTINCT {_FIELDS} FROM content_entries WHERE NOT coalesce(deleted, false) AND coalesce(pack_blob_id, '') <> '' AND index_blob_id IS NOT NULL AND {_HEX} AND length(content_id) % 2 = 0) SELECT * FROM e WHERE pack_blob_id IN (SELECT blob_id FROM pack_blobs WHERE NOT coalesce(deleted, false))")
def sc15_recovered_packs(t):
    """Entries recovered from the packs' own records; packs that aren't in the store have lost their
    last byte."""
    there = t.pack_blobs.filter(~F.coalesce("deleted", F.lit(False)) & F.col("blob_id").isNotNull()).select(F.col("blob_id").alias("pack_blob_id"), F.lit(True).alias("_t")).distinct()
    rows = _encodable(t).drop("index_blob_id").distinct().filter(F.length("content_id") % 2 == 0).withColumn("body", F.col("pack_blob_id").cast("binary"))
    packs = packindex.packs_with_index(rows, most=2_000).join(there, "pack_blob_id", "left")
    whole = F.when(F.col("_t"), F.col("data")).otherwise(F.substring("data", F.lit(1), F.octet_length("data") - 1))
    return packindex.recovered_entries(packs.withColumn("data", whole))


@q("WITH e AS (SELECT DISTINCT content_id FROM content_entries WHERE content_id IS NOT NULL), n AS (SELECT greatest(1, (count(*) + 999) // 1000) n FROM e) SELECT shard, count(*) n FROM (SELECT ('0x' || md5(content_id)[1:8])::BIGINT % n AS shard FROM e, n) GROUP BY 1")
def ix06_sized_shards(t):
    """Index shards of about a thousand ids each."""
    ids = t.content_entries.filter("content_id is not null").select("content_id").distinct()
    return packindex.sized_shards(ids, 1_000).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
