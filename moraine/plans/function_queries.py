"""Queries over scalar functions, metrics, chunks, objects and epochs (SF, MT, CH, OB, EP, WN, GR, MS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.functions import scalars as X
from moraine.operators import chunks as K
from moraine.operators import epochs as E
from moraine.operators import metrics as M
from moraine.operators import snapshots as S
from moraine.operators import trees
from moraine.operators.joins import as_of_join
from moraine.operators.orphans import object_key
from moraine.operators.ranking import null_safe, running_within
from moraine.plans.base import BL, CW, SN, Registry, sql

q = Registry()
QUERIES, ORACLE = q.QUERIES, q.ORACLE


def _unit_sql(v, suffix, base, prefixes):
    out = "CASE "
    for i, p in enumerate(prefixes):
        text = f"regexp_replace(regexp_replace(printf('%.1f', ({v})::DOUBLE / {float(base**i)}), '0+$', ''), '\\.$', '') || ' {p}{suffix}'"
        out += f"ELSE {text} END" if i == len(prefixes) - 1 else f"WHEN ({v})::DOUBLE / {float(base**i)} < {0.9 * base} THEN {text} "
    return out


# -- scalar functions ---------------------------------------------------------------------------
@q(sql(BL, f"SELECT blob_id, {_unit_sql('blob_length', 'B', 1000, X.PREFIXES_10)} size, {_unit_sql('blob_length', 'B', 1024, X.PREFIXES_2)} size2 FROM bl WHERE blob_length IS NOT NULL"))
def sf01_bytes_string(t):
    v = F.col("blob_length")
    return t.blobs.filter("blob_length is not null").select("blob_id", X.unit_string(v).alias("size"), X.unit_string(v, base=1024).alias("size2"))


@q(f"SELECT event_id, {_unit_sql('event_id * event_id', '', 1000, X.PREFIXES_10)} n, {_unit_sql('event_id * 977', 'B/s', 1000, X.PREFIXES_10)} rate FROM events")
def sf02_counts(t):
    e = F.col("event_id")
    return t.events.select("event_id", X.unit_string(e * e, "").alias("n"), X.unit_string(e * 977, "B/s").alias("rate"))


@q(sql(CW, "SELECT content_id, CASE WHEN packed_length >= original_length OR original_length = 0 THEN '0%' ELSE printf('%.1f%%', 100.0::DOUBLE * (1.0::DOUBLE - packed_length::DOUBLE / original_length)) END saved FROM cw WHERE original_length IS NOT NULL AND packed_length IS NOT NULL"))
def sf03_compression_percent(t):
    rows = t.contents.filter("original_length is not null and packed_length is not null")
    return rows.select("content_id", X.compression_percent(F.col("original_length"), F.col("packed_length")).alias("saved"))


@q(sql(SN, "SELECT DISTINCT coalesce(user_name, '') u, host_name h, coalesce(source_path, '') p FROM sn WHERE host_name IS NOT NULL AND NOT contains(host_name, ':')"))
def sf04_parse_source(t):
    rows = t.snapshots.filter("host_name is not null and not contains(host_name, ':')").select(X.source_string(F.col("user_name"), F.col("host_name"), F.col("source_path")).alias("s")).distinct()
    x = X.parsed_source(F.col("s"))
    return rows.select(x["user"].alias("u"), x["host"].alias("h"), x["path"].alias("p")).distinct()


@q("SELECT event_id, event_id % 97 AS epoch, user_id lo, (user_id + event_id) AS hi FROM events")
def sf05_epoch_ids(t):
    ids = t.events.select("event_id", F.concat_ws("_", F.concat(F.lit("xn"), (F.col("event_id") % 97).cast("string")), F.lit("ab")).alias("a"), F.concat(F.lit("xr"), F.col("user_id"), F.lit("_"), F.col("user_id") + F.col("event_id"), F.lit("_z")).alias("b"))
    r = X.epoch_range(F.col("b"))
    return ids.select("event_id", X.epoch_number(F.col("a")).cast("bigint").alias("epoch"), r["lo"].cast("bigint").alias("lo"), r["hi"].cast("bigint").alias("hi"))


@q("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || user_id END session_id FROM events")
def sf06_session_ids(t):
    from moraine.operators.blobs import session_of

    name = F.concat_ws("-", F.lit("p00"), F.when(F.col("event_id") % 3 == 0, F.lit("c1")).otherwise(F.concat(F.lit("s"), F.col("user_id"))), F.lit("c1"))
    return t.events.select("event_id", session_of(name).alias("session_id"))


@q("SELECT c, CASE WHEN regexp_matches(c, '^[g-z]?([0-9a-f]{2}){1,32}$') THEN regexp_extract(c, '^([g-z]?)', 1) END prefix FROM (SELECT DISTINCT content_id c FROM content_entries WHERE content_id IS NOT NULL)")
def sf07_content_prefix(t):
    c = F.col("c")
    return t.content_entries.filter("content_id is not null").select(F.col("content_id").alias("c")).distinct().select("c", X.content_prefix(c).alias("prefix"))


@q("SELECT n, compressed, count(*) objects, count(DISTINCT k) distinct_contents FROM (SELECT length(regexp_extract(e.object_id, '^(I*)', 1)) n, regexp_matches(e.object_id, '^I*Z') compressed, regexp_replace(e.object_id, '^I*Z?D?', '') k FROM (SELECT unnest(entries) e FROM dir_manifests) WHERE e.object_id IS NOT NULL) GROUP BY ALL")
def ms06_object_parts(t):
    e = t.dir_manifests.select(F.explode("entries").alias("e")).filter("e.object_id is not null")
    p = X.object_parts(F.col("e.object_id"))
    rows = e.select(p["indirections"].cast("bigint").alias("n"), p["compressed"].alias("compressed"), p["content_id"].alias("k"))
    return rows.groupBy("n", "compressed").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("k").alias("distinct_contents"))


@q("SELECT m, count(*) n FROM (SELECT (SELECT sum(digit::INT * (8 ** (len(s) - i)))::INT FROM (SELECT unnest(string_split(s, '')) digit, unnest(range(1, len(s) + 1)) i)) m FROM (SELECT replace(file_mode, '0o', '') s FROM snapshot_entries WHERE file_mode IS NOT NULL)) GROUP BY 1")
def sf08_mode_bits(t):
    return t.snapshot_entries.filter("file_mode is not null").groupBy(X.mode_bits(F.col("file_mode")).alias("m")).agg(F.count(F.lit(1)).alias("n"))


@q(sql(SN, r"SELECT p, CASE WHEN NOT regexp_matches(b, '[/\\]') THEN p WHEN regexp_extract(b, '^(.*)[/\\][^/\\]*$', 1) = '' THEN d || b[1:1] ELSE d || regexp_extract(b, '^(.*)[/\\][^/\\]*$', 1) END up FROM (SELECT *, CASE WHEN length(rest) > 1 THEN regexp_replace(rest, '[/\\]$', '') ELSE rest END b FROM (SELECT *, p[length(d) + 1:] rest FROM (SELECT source_path p, CASE WHEN regexp_matches(source_path, '^[^/\\]:[/\\]') THEN source_path[1:2] ELSE '' END d FROM (SELECT DISTINCT source_path FROM sn WHERE source_path IS NOT NULL))))"))
def sf09_parent_path(t):
    from moraine.operators.policies import parent_path

    return t.snapshots.filter("source_path is not null").select(F.col("source_path").alias("p")).distinct().select("p", parent_path(F.col("p")).alias("up"))


_SAFE = r"CASE WHEN p = '/' THEN '__root' ELSE rtrim(rtrim(replace(replace(ltrim(replace(replace(p, ':/', '_'), ':\', '_'), '/'), '/', '_'), '\', '_'), '_'), ':') END"


@q(sql(SN, f"SELECT p, {_SAFE} AS name FROM (SELECT DISTINCT source_path p FROM sn WHERE source_path IS NOT NULL)"))
def sf10_mount_name(t):
    return t.snapshots.filter("source_path is not null").select(F.col("source_path").alias("p")).distinct().select("p", X.mount_name(F.col("p")).alias("name"))


@q("SELECT event_id, printf('%04d-%02d', isoyear(ts), week(ts)) weekly, strftime(ts, '%Y') annual, strftime(ts, '%Y-%m') monthly, strftime(ts, '%Y-%m-%d') daily, strftime(ts, '%Y-%m-%d %H') hourly FROM events")
def sf11_period_ids(t):
    return t.events.select("event_id", *[S.period_id(k, F.col("ts")).alias(k) for k in ("weekly", "annual", "monthly", "daily", "hourly")])


@q("SELECT event_id, date_trunc('hour', ts)::TIMESTAMP hour_, date_trunc('day', ts)::TIMESTAMP day_, (date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP sunday_, date_trunc('week', ts)::TIMESTAMP monday_, date_trunc('month', ts)::TIMESTAMP month_, date_trunc('quarter', ts)::TIMESTAMP quarter_, date_trunc('year', ts)::TIMESTAMP year_, (date_trunc('quarter', ts) + INTERVAL 3 MONTH)::TIMESTAMP next_quarter FROM events")
def sf12_period_starts(t):
    ts = F.col("ts")
    units = ["hour", "day", "sunday", "monday", "month", "quarter", "year"]
    return t.events.select("event_id", *[X.period_start(ts, u).alias(f"{u}_") for u in units], X.next_period(ts, "quarter").alias("next_quarter"))


_B = "(" + " + ".join(f"(v > {x})::INT" for x in X.SIZE_THRESHOLDS) + ")"


@q(f"SELECT event_id, {_B} b FROM (SELECT event_id, event_id * 37 v FROM events)")
def sf13_threshold_bucket(t):
    return t.events.select("event_id", X.bucket(F.col("event_id") * 37, X.SIZE_THRESHOLDS).alias("b"))


@q("SELECT event_id, greatest((s + 21600) // 21600 * 21600, s + 3000) next_interval, CASE WHEN s > d + 32400 THEN (CASE WHEN s > d + 64800 THEN d + 118800 ELSE d + 64800 END) ELSE d + 32400 END next_time FROM (SELECT event_id, s, s // 86400 * 86400 d FROM (SELECT event_id, epoch_us(ts) // 1000000 s FROM events))")
def sf14_next_run(t):
    s = F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)")
    return t.events.select("event_id", X.next_interval(s, s + 3_000, 21_600).cast("bigint").alias("next_interval"), X.next_time_of_day(s, [540, 1080]).cast("bigint").alias("next_time"))


@q("SELECT event_id, epoch_us(ts) mtime FROM events")
def sf15_timestamp_meta(t):
    m = F.create_map(F.lit("mtime"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    return t.events.withColumn("meta", m).select("event_id", F.col("meta")["mtime"].cast("bigint").alias("mtime"))


@q()
def sf16_shards(t):
    return t.contents.groupBy(F.pmod(F.xxhash64("content_id"), F.lit(8)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT event_id, CASE WHEN d > 0 THEN '+' || d WHEN d < 0 THEN d::VARCHAR ELSE '' END delta FROM (SELECT event_id, event_id % 7 - 3 d FROM events)")
def sf17_delta_string(t):
    d = F.col("event_id") % 7 - 3
    return t.events.select("event_id", F.when(d > 0, F.concat(F.lit("+"), d)).when(d < 0, d.cast("string")).otherwise("").alias("delta"))


@q("SELECT DISTINCT entry_path, regexp_extract(entry_path, '([^/]*)$', 1) base, lower(regexp_extract(entry_path, '(\\.[^./]*)$', 1)) ext FROM snapshot_entries WHERE entry_path IS NOT NULL")
def sf18_path_parts(t):
    return t.snapshot_entries.filter("entry_path is not null").select("entry_path").distinct().select("entry_path", F.substring_index("entry_path", "/", -1).alias("base"), F.lower(F.regexp_extract("entry_path", r"(\.[^./]*)$", 1)).alias("ext"))


@q("SELECT event_id, props->>'$.page' page, json_valid(props) ok FROM events")
def sf20_json_decode(t):
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.expr("case when props is not null then try_parse_json(props) is not null end").alias("ok"))


@q("SELECT event_id, event_type || '' AS tag_value, 'tag:' || user_id AS tag_key FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def ms02_tags(t):
    m = X.tags(F.array(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")))
    e = F.map_entries(m)
    return t.events.filter("user_id is not null and event_type is not null").select("event_id", e[0]["key"].alias("tag_key"), e[0]["value"].alias("tag_value"))


@q("SELECT event_id, c + greatest(3600, 600 + 2 * 1200) upgrade_at, 1704800000 >= c + greatest(3600, 600 + 2 * 1200) locked FROM (SELECT event_id, epoch_us(ts) // 1000000 c FROM events)")
def ms05_upgrade_lock(t):
    """When a format upgrade begins: after the notice, or after drift and twice the drain time."""
    c = F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)")
    at = c + max(3_600, 600 + 2 * 1_200)
    return t.events.select("event_id", at.alias("upgrade_at"), (F.lit(1_704_800_000) >= at).alias("locked"))


@q("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'none' WHEN 1704800000 >= s + 86400 THEN 'full' WHEN 1704800000 >= s + 3600 THEN 'quick' ELSE 'none' END AS mode FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 s FROM events)")
def ms09_maintenance_mode(t):
    """Kind of maintenance that is due: none for others than the owner, full before quick."""
    s = F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)")
    now = F.lit(1_704_800_000)
    mode = F.when(F.col("user_id") % 3 == 0, "none").when(now >= s + 86_400, "full").when(now >= s + 3_600, "quick").otherwise("none")
    return t.events.select("event_id", mode.alias("mode"))


@q(sql(BL, "SELECT blob_id, blob_id[1:2] || '/' || blob_id[3:] || '.f' path FROM bl WHERE length(blob_id) > 2"))
def ms11_reshard(t):
    from moraine.operators.blobs import resharded_path

    return t.blobs.filter("length(blob_id) > 2").select("blob_id", resharded_path(F.col("blob_id"), [2]).alias("path"))


@q("SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 5")
def ms15_show(t):
    return t.documents.filter("doc_id = 5").select("doc_id", "source", "n_chars")


@q(sql(CW, BL, "SELECT c.content_id, c.pack_blob_id, pack_offset, packed_length, b.blob_length FROM cw c LEFT JOIN bl b ON b.blob_id = c.pack_blob_id AND NOT b.deleted WHERE c.live AND (SELECT count(*) FROM cw d WHERE d.live AND d.timestamp_seconds > c.timestamp_seconds) < 5"))
def ms15_show_newest(t):
    """Where the newest contents lie: those that fewer than five are newer than."""
    live = t.contents.filter("live")
    edge = live.orderBy(F.col("timestamp_seconds").desc()).limit(5).agg(F.min("timestamp_seconds").alias("_t"))
    b = t.live_blobs.select(F.col("blob_id").alias("pack_blob_id"), "blob_length")
    return live.join(F.broadcast(edge)).filter(F.col("timestamp_seconds") >= F.col("_t")).join(b, "pack_blob_id", "left").select("content_id", "pack_blob_id", "pack_offset", "packed_length", "blob_length")


@q("SELECT count(*) FILTER (WHERE text IS NOT NULL) n, sum(strlen(text))::BIGINT bytes FROM documents")
def ms07_rough_estimate(t):
    return t.documents.agg(F.count("text").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


# -- metrics ------------------------------------------------------------------------------------
_EV = "ev AS (SELECT event_id, user_id, user_id % 10 host, ts s, ts + INTERVAL 1 HOUR * (event_id % 100 + 1) e, floor(value)::BIGINT v FROM events WHERE value IS NOT NULL)"


def _intervals(t):
    return t.events.filter("value is not null").select("event_id", "user_id", (F.col("user_id") % 10).alias("host"), F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 100 + 1).cast("int"))).alias("e"), F.floor("value").cast("bigint").alias("v"))


def _pieces(unit, step):
    return f"pc AS (SELECT *, date_diff('microsecond', greatest(p, s), least(p + INTERVAL {step}, e)) / 1e6 / (date_diff('microsecond', s, e) / 1e6) r FROM (SELECT *, unnest(generate_series(date_trunc('{unit}', s)::TIMESTAMP, date_trunc('{unit}', e)::TIMESTAMP, INTERVAL {step})) p FROM ev) WHERE p < e)"


@q("SELECT event_type, sum(floor(value)::BIGINT)::BIGINT total, count(*) n FROM events GROUP BY 1")
def mt01_counters(t):
    return t.events.groupBy("event_type").agg(F.sum(F.floor("value").cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n"))


_DIST = f"d AS (SELECT host, user_id, v, {_B} b FROM ev)"


@q(f"WITH {_EV}, {_DIST} SELECT host, min(v) least, max(v) most, sum(v)::BIGINT total, count(*) n, [" + ", ".join(f"count(*) FILTER (WHERE b = {i})" for i in range(22)) + "] buckets FROM d GROUP BY 1")
def mt02_distribution(t):
    return M.distribution(_intervals(t), ["host"], "v", X.SIZE_THRESHOLDS)


@q(f"WITH {_EV}, {_DIST} SELECT host, min(v) least, max(v) most, sum(v)::BIGINT total, count(*) n, [" + ", ".join(f"count(*) FILTER (WHERE b = {i})" for i in range(22)) + "] buckets FROM d GROUP BY 1")
def mt03_merged(t):
    return M.merged_distributions(M.distribution(_intervals(t), ["host", "user_id"], "v", X.SIZE_THRESHOLDS), ["host"])


@q(f"WITH {_EV} SELECT host, sum(v)::BIGINT // count(*) average FROM ev GROUP BY 1")
def mt04_mean(t):
    return _intervals(t).groupBy("host").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")).select("host", F.expr("total div n").alias("average"))


@q("SELECT user_id, sum(event_id)::BIGINT bytes, sum(event_id * 1000)::BIGINT nanos FROM events GROUP BY 1")
def mt05_throughput(t):
    return M.throughput(t.events.withColumn("ns", F.col("event_id") * 1000), ["user_id"], "event_id", "ns")


@q(f"WITH {_EV}, {_pieces('day', '1 DAY')} SELECT host, p AS point, sum(trunc(v * r)::BIGINT)::BIGINT AS value FROM pc GROUP BY ALL")
def mt06_series_by_day(t):
    return M.counter_series(_intervals(t), ["host"], "s", "e", "v", "day")


@q(f"WITH {_EV}, {_pieces('month', '1 MONTH')} SELECT user_id, p AS point, sum(trunc(v * r)::BIGINT)::BIGINT AS value FROM pc GROUP BY ALL")
def mt07_series_by_month(t):
    return M.counter_series(_intervals(t), ["user_id"], "s", "e", "v", "month")


@q(f"WITH {_EV}, {_pieces('day', '1 DAY')} SELECT host, p AS point, {_B} AS bucket, sum(floor(r)::BIGINT)::BIGINT scaled, sum(v)::BIGINT total, count(*) n, min(v) least, max(v) most FROM pc GROUP BY ALL")
def mt08_distribution_series(t):
    return M.distribution_series(_intervals(t), ["host"], "s", "e", "v", X.SIZE_THRESHOLDS, "day")


_DI = f"di AS (SELECT user_id, host, min(s) s, max(e) e, count(*) n, sum(v)::BIGINT total, min(v) least, max(v) most, [" + ", ".join(f"count(*) FILTER (WHERE b = {i})" for i in range(22)) + f"] buckets FROM (SELECT *, {_B} b FROM ev) GROUP BY ALL)"


@q(f"WITH {_EV}, {_DI}, {_pieces('day', '1 DAY').replace('FROM ev)', 'FROM di)')}, fl AS (SELECT host, p, i, sum(floor(buckets[i] * r)::BIGINT)::BIGINT c FROM (SELECT *, unnest(range(1, 23)) i FROM pc) GROUP BY ALL), bk AS (SELECT host, p, list(c ORDER BY i) buckets FROM fl GROUP BY ALL), sm AS (SELECT host, p, sum(total)::BIGINT total, sum(n)::BIGINT n, min(least) least, max(most) most FROM pc GROUP BY ALL) SELECT sm.host, sm.p AS point, total, n, least, most, buckets FROM sm JOIN bk ON sm.p = bk.p AND sm.host IS NOT DISTINCT FROM bk.host")
def mt08_spread_distributions(t):
    """Distributions of each user over their whole time, spread over its days."""
    v = _intervals(t)
    span = v.groupBy("host", "user_id").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    d = null_safe(M.distribution(v, ["host", "user_id"], "v", X.SIZE_THRESHOLDS), span, ["host", "user_id"], "inner")
    return M.spread_distributions(d, ["host"], "s", "e", "day")


# -- chunks and objects -------------------------------------------------------------------------
_CH = "ch AS (SELECT doc_id, i AS chunk_no, i * 1024 AS start_, text[i * 1024 + 1:(i + 1) * 1024] AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil(length(text) / 1024.0)::BIGINT, 1))) i FROM documents WHERE text IS NOT NULL)), cc AS (SELECT doc_id, chunk_no, start_, length(chunk) AS len, sha256(chunk) cid FROM ch)"


def _chunks(t):
    c = K.fixed_chunks(t.documents.select("doc_id", "text"), "text", 1024)
    return c.select("doc_id", "chunk_no", "start", "length", F.sha2("chunk", 256).alias("content_id"))


@q(f"WITH {_CH} SELECT doc_id, chunk_no, start_ AS start, len AS length, cid AS content_id FROM cc")
def ch01_fixed_chunks(t):
    return _chunks(t)


@q()
def ch02_content_defined(t):
    return K.content_defined_chunks(t.documents, "doc_id", "text", 1024)


@q()
def ch03_rabin_karp(t):
    return K.content_defined_chunks(t.documents, "doc_id", "text", 1024, "rabinkarp")


@q("SELECT doc_id, sha256(text) h FROM documents WHERE text IS NOT NULL")
def ch04_sha256(t):
    return t.documents.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))


@q()
def ch04_keyed_hash(t):
    return K.hashed(t.documents.filter("text is not null").select("doc_id", "text"), "text", "h", "BLAKE2B-256-128", b"secret").select("doc_id", "h")


@q()
def ch05_compressed(t):
    rows = K.compressed(t.documents.filter("text is not null").select("doc_id", "text"), "text", "c", "zstd-fastest")
    return rows.select("doc_id", F.octet_length("text").alias("original"), F.octet_length("c").alias("packed"))


@q("SELECT count(*) n, true ok FROM documents WHERE text IS NOT NULL")
def ch09_round_trip(t):
    """Texts compressed, encrypted, decrypted, expanded and compared."""
    rows = t.documents.filter("text is not null").select("doc_id", "text", F.lit(b"0" * 32).alias("key"), F.sha2("text", 256).cast("binary").alias("cid"))
    small = K.compressed(rows, "text", "c", "zstd")
    stored = small.withColumn("raw", F.coalesce("c", F.col("text").cast("binary"))).withColumn("secret", K.encrypted(F.col("raw"), F.col("key"), F.col("cid")))
    opened = stored.withColumn("open", K.decrypted(F.col("secret"), F.col("key"), F.col("cid")))
    back = K.decompressed(opened.withColumn("z", F.when(F.col("c").isNotNull(), F.col("open"))), "z", "plain", "zstd")
    same = F.coalesce("plain", "open") == F.col("text").cast("binary")
    return back.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(same), F.lit(True)).alias("ok"))


@q(f"WITH {_CH} SELECT doc_id, CASE WHEN count(*) = 1 THEN min(cid) ELSE 'Ix' || sha256(string_agg(cid, ',' ORDER BY chunk_no)) END object_id, sum(len)::BIGINT length, count(*) n_chunks FROM cc GROUP BY 1")
def ob01_objects(t):
    o = K.objects(_chunks(t), "doc_id")
    return o.select("doc_id", "object_id", "length", F.coalesce(F.size("entries"), F.lit(1)).cast("bigint").alias("n_chunks")).withColumn("n_chunks", F.greatest("n_chunks", F.lit(1)))


@q(f"WITH {_CH} SELECT doc_id, cid AS content_id FROM cc WHERE len = 0")
def ob02_empty_objects(t):
    return _chunks(t).filter("length = 0").select("doc_id", "content_id")


@q(f"WITH {_CH} SELECT doc_id, chunk_no, cid AS content_id FROM cc WHERE start_ <= 3000 AND 3000 < start_ + len")
def ob03_chunk_at(t):
    return K.chunk_at(_chunks(t), F.lit(3000)).select("doc_id", "chunk_no", "content_id")


@q("SELECT source, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def ob04_concatenate(t):
    rows = t.documents.filter("text is not null and source is not null").select("source", "doc_id", F.length("text").alias("len"))
    return K.concatenated(rows, ["source"], "doc_id", "len").select("source", "doc_id", "start")


@q("SELECT doc_id, unnest(range(0, length(text) // 4096 + 1)) * 4096 AS part_start FROM documents WHERE text IS NOT NULL")
def ob05_upload_parts(t):
    return t.documents.filter("text is not null").select("doc_id", F.explode(K.upload_parts(F.length("text"), 4096)).alias("part_start"))


@q(f"WITH {_CH} SELECT doc_id, cid AS content_id FROM cc")
def gr04_backing_contents(t):
    """Contents behind each object: itself, or those of its seek table."""
    o = K.objects(_chunks(t), "doc_id")
    parts = F.coalesce(F.transform("entries", lambda e: e["object"]), F.array("object_id"))
    return o.select("doc_id", F.explode(parts).alias("content_id"))


# Seek trees of chunks of 256 characters, eight entries a table: long documents have several levels.
def _seek_sql(levels=6):
    out = ["c0 AS (SELECT doc_id, unnest(range(0, greatest(1, (length(text) + 255) // 256))) place, text FROM documents WHERE text IS NOT NULL)", "l0 AS (SELECT doc_id, place, sha256(substr(text, place * 256 + 1, 256)) child, 0 AS depth FROM c0)"]
    for k in range(levels):
        out.append(f"g{k} AS (SELECT doc_id, place // 8 g, list(child ORDER BY place) cs, max(depth) depth FROM l{k} GROUP BY ALL), n{k} AS (SELECT doc_id, g place, CASE WHEN g = 0 AND len(cs) = 1 THEN NULL ELSE 'x' || sha256(array_to_string(cs, ',')) END node, cs, depth FROM g{k}), l{k + 1} AS (SELECT doc_id, place, coalesce(node, cs[1]) child, depth + (node IS NOT NULL)::INT AS depth FROM n{k})")
    return out + ["lk AS (" + " UNION ALL ".join(f"SELECT node, unnest(cs) child FROM n{k} WHERE node IS NOT NULL" for k in range(levels)) + ")", f"ob AS (SELECT doc_id, repeat('I', depth) || child object_id, depth FROM l{levels})"]


_SEEK = _seek_sql()
_BACK = "bc(doc_id, k) AS (SELECT doc_id, regexp_replace(object_id, '^I*Z?', '') FROM ob UNION SELECT doc_id, child FROM bc JOIN (SELECT DISTINCT node, child FROM lk) ON node = k)"


def _seek(t):
    c = K.fixed_chunks(t.documents.select("doc_id", "text"), "text", 256)
    return K.seek_trees(c.select("doc_id", "chunk_no", "start", "length", F.sha2("chunk", 256).alias("content_id")), "doc_id", 8)


@q(sql(*_SEEK, "SELECT doc_id, object_id, depth FROM ob"))
def ob01_seek_trees(t):
    return _seek(t)[0].select("doc_id", "object_id", "depth")


@q(sql(*_SEEK, _BACK, "SELECT DISTINCT k AS key FROM bc").replace("WITH ", "WITH RECURSIVE ", 1))
def gr04_seek_contents(t):
    """Contents behind all objects, seek tables of every level included."""
    objects, links = _seek(t)
    return trees.backing_contents(objects.select(object_key(F.col("object_id")).alias("key")), links)


@q(sql(*_SEEK, _BACK, "us AS (SELECT DISTINCT k FROM bc JOIN documents USING (doc_id) WHERE lang IS NOT NULL)", "SELECT CASE WHEN us.k IS NULL THEN 'unused' ELSE 'in use' END fate, count(*) n FROM (SELECT DISTINCT k FROM bc) a LEFT JOIN us USING (k) GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1))
def jn03_indirect_gc(t):
    """Contents of documents without a language are unused, unless another document has them; what
    lies behind the seek tables of the others is in use."""
    objects, links = _seek(t)
    keyed = objects.select("doc_id", object_key(F.col("object_id")).alias("key"))
    every = trees.backing_contents(keyed, links)
    used = trees.backing_contents(keyed.join(t.documents.filter("lang is not null").select("doc_id"), "doc_id", "left_semi"), links)
    index = every.select(F.col("key").alias("content_id"), F.lit(True).alias("live"), F.lit(0).cast("bigint").alias("timestamp_seconds"))
    return trees.gc_classes(index, used, 10**9, 0).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@q(sql(*_SEEK, _BACK, "lg AS (SELECT DISTINCT sha256(substr(text, 1, 256)) k FROM documents WHERE text IS NOT NULL AND lang IS NULL)", "SELECT state, count(*) n FROM (SELECT object_id, CASE WHEN bool_or(bc.k IN (SELECT k FROM lg)) THEN 'no content' ELSE 'ok' END state FROM ob JOIN bc USING (doc_id) GROUP BY 1) GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1))
def jn06_indirect_verify(t):
    """Objects verified through their seek tables in a store that lost the first chunks of the
    documents without a language."""
    objects, links = _seek(t)
    lost = t.documents.filter("text is not null and lang is null").select(F.sha2(F.substring("text", 1, 256), 256).alias("key")).distinct()
    every = trees.backing_contents(objects.select(object_key(F.col("object_id")).alias("key")), links).join(lost, "key", "left_anti")
    index = every.select(F.col("key").alias("content_id"), F.lit(True).alias("live"), F.lit("p").alias("pack_blob_id"))
    packs = t.spark.createDataFrame([("p",)], "blob_id string")
    return trees.verified(objects, links, index, packs).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@q(f"WITH {_CH}, f AS (SELECT cid, min(doc_id) first_doc, any_value(len) len FROM cc GROUP BY 1) SELECT first_doc AS doc_id, count(*) new_contents, sum(len)::BIGINT new_length FROM f GROUP BY 1")
def ag09_new_chunks(t):
    first = _chunks(t).groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.first("length").alias("length"))
    return first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_contents"), F.sum("length").alias("new_length"))


# -- epochs -------------------------------------------------------------------------------------
_EP = "ep AS (SELECT event_id, epoch_us(ts) // 1000000 // 43200 - 39446 AS epoch, epoch_us(ts) // 1000000 s, event_id % 977 len FROM events)"


def _epochs(t):
    s = F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)")
    return t.events.select("event_id", (F.floor(s / 43_200) - 39_446).cast("bigint").alias("epoch"), s.alias("ts"), (F.col("event_id") % 977).alias("blob_length"))


@q(f"WITH {_EP} SELECT epoch, max(s) - min(s) span, count(*) n, sum(len)::BIGINT bytes FROM ep GROUP BY 1 HAVING max(s) - min(s) >= 40000 AND (count(*) >= 180 OR sum(len) >= 90000)")
def wn14_epoch_advance(t):
    return E.advancing(_epochs(t), 40_000, 180, 90_000)


@q(f"WITH {_EP}, c AS (SELECT DISTINCT epoch FROM ep JOIN events USING (event_id) WHERE event_type = 'signup'), e AS (SELECT * FROM c WHERE epoch >= 1) SELECT CASE WHEN EXISTS (SELECT 1 FROM e WHERE epoch = 1) THEN (SELECT min(epoch) + 1 FROM e WHERE epoch + 1 NOT IN (SELECT epoch FROM e)) ELSE 1 END AS epoch")
def wn15_oldest_uncompacted(t):
    done = _epochs(t).join(t.events.filter("event_type = 'signup'").select("event_id"), "event_id", "left_semi")
    return E.oldest_uncompacted(done.select("epoch").distinct(), 1)


@q(f"WITH {_EP} SELECT max(epoch) write_epoch, (SELECT min(s) FROM ep WHERE epoch = (SELECT max(epoch) FROM ep)) began FROM ep")
def ep01_write_epoch(t):
    firsts = _epochs(t).groupBy("epoch").agg(F.min("ts").alias("ts"))
    return E.markers(firsts)


@q(f"WITH {_EP} SELECT max(s) - 3600 watermark FROM ep")
def ep02_deletion_watermark(t):
    return _epochs(t).agg((F.max("ts") - 3_600).alias("watermark"))


@q(f"WITH {_EP}, c AS (SELECT DISTINCT epoch, event_id % 4 part FROM ep) SELECT epoch, count(*) n FROM c GROUP BY 1 HAVING count(*) >= 4")
def ep03_single_epoch_sets(t):
    from moraine.operators.blobs import complete_sets

    c = _epochs(t).select("epoch", (F.col("event_id") % 4).alias("part")).distinct()
    named = c.select(F.concat(F.lit("xs"), F.col("epoch"), F.lit("_p"), F.col("part"), F.lit("-s"), F.col("epoch"), F.lit("-c4")).alias("blob_id"))
    return complete_sets(named).select(F.col("set_id").cast("bigint").alias("epoch"), F.size("members").cast("bigint").alias("n"))


# Range checkpoints that the table gives: an epoch with an error in it was checkpointed together with
# the epochs up to the next one with a purchase of the highest tenth, and the first half of all in one.
_RG = """er AS (SELECT DISTINCT epoch lo FROM ep JOIN events USING (event_id) WHERE event_type = 'error' AND epoch IS NOT NULL),
pu AS (SELECT DISTINCT epoch hi FROM ep JOIN events USING (event_id) WHERE event_type = 'purchase' AND value > (SELECT quantile_cont(value, 0.9) FROM events) AND epoch IS NOT NULL),
rg AS (SELECT lo, min(hi) hi FROM er JOIN pu ON hi >= lo GROUP BY 1 UNION SELECT min(lo), min(lo) + (max(lo) - min(lo)) // 2 FROM er HAVING min(lo) IS NOT NULL)"""
_CHAIN = "first AS (SELECT min(lo) lo FROM rg), ch AS (SELECT lo, hi, 1 n, hi far, [{'lo': lo, 'hi': hi}] path FROM rg WHERE lo = (SELECT lo FROM first) UNION ALL SELECT rg.lo, rg.hi, n + 1, rg.hi, list_append(path, {'lo': rg.lo, 'hi': rg.hi}) FROM ch JOIN rg ON rg.lo = ch.hi + 1)"


def _ranges(t):
    """``lo, hi`` of the range checkpoints; the chain starts at the least ``lo``."""
    e = _epochs(t).filter("epoch is not null").join(t.events.select("event_id", "event_type", "value"), "event_id")
    top = t.events.agg(F.percentile("value", F.lit(0.9))).first()[0]
    lo = e.filter("event_type = 'error'").select(F.col("epoch").alias("lo")).distinct()
    hi = e.filter((F.col("event_type") == "purchase") & (F.col("value") > F.lit(top))).select(F.col("epoch").alias("hi")).distinct()
    span = lo.agg(F.min("lo").alias("lo"), F.expr("min(lo) + (max(lo) - min(lo)) div 2").alias("hi")).filter("lo is not null")
    return E.next_at_or_after(lo, "lo", hi, "hi").unionByName(span).distinct()


@q(f"WITH RECURSIVE {_EP}, {_RG}, {_CHAIN} SELECT p.lo, p.hi FROM (SELECT unnest(path) p FROM (SELECT * FROM ch ORDER BY far DESC, n LIMIT 1))")
def gr08_longest_chain(t):
    """The chain of range checkpoints that reaches furthest."""
    return E.chain_of(_ranges(t))


@q(f"WITH RECURSIVE {_EP}, {_RG}, {_CHAIN}, fr AS (SELECT coalesce(max(far), -1) far FROM ch), w AS (SELECT max(epoch) w FROM ep), comp AS (SELECT DISTINCT epoch FROM ep JOIN events USING (event_id) WHERE event_type = 'signup' AND epoch > (SELECT far FROM fr) AND epoch <= (SELECT w FROM w) - 2) SELECT kind, count(*) n FROM (SELECT 'range' kind FROM (SELECT unnest(path) p FROM (SELECT * FROM ch ORDER BY far DESC, n LIMIT 1)) UNION ALL SELECT 'compacted' FROM comp UNION ALL SELECT 'written' FROM ep WHERE epoch > (SELECT far FROM fr) AND epoch NOT IN (SELECT epoch FROM comp)) GROUP BY 1")
def ep05_index_set(t):
    """Blobs of the index by kind: range checkpoints, then compacted epochs - settled ones with a
    signup - and blobs as written."""
    e = _epochs(t).filter("epoch is not null")
    chain = E.chain_of(_ranges(t))
    comp = e.join(t.events.filter("event_type = 'signup'").select("event_id"), "event_id", "left_semi").select("epoch").distinct().withColumn("blob_id", F.concat(F.lit("compacted-"), "epoch"))
    rows = E.index_set(e.withColumn("blob_id", F.concat(F.lit("written-"), "event_id")), comp, chain, e.agg(F.max("epoch")).first()[0] or 0)
    return rows.groupBy(F.substring_index("blob_id", "-", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@q(f"WITH RECURSIVE {_EP}, {_RG}, {_CHAIN} SELECT (SELECT max(epoch) FROM ep) - coalesce((SELECT max(far) FROM ch), -1) AS epochs_since_range, (SELECT max(epoch) FROM ep) - coalesce((SELECT max(far) FROM ch), -1) >= 7 AS due")
def ep06_range_due(t):
    reach = E.chain_of(_ranges(t)).agg(F.coalesce(F.max("hi"), F.lit(-1)).alias("far"))
    since = F.col("top") - F.col("far")
    return _epochs(t).agg(F.max("epoch").alias("top")).join(F.broadcast(reach)).select(since.alias("epochs_since_range"), (since >= 7).alias("due"))


@q(f"WITH {_EP}, c AS (SELECT epoch, max(s) + 7200 t FROM ep JOIN events USING (event_id) WHERE event_type = 'signup' GROUP BY 1) SELECT event_id FROM ep WHERE epoch IN (SELECT epoch FROM c WHERE t < (SELECT max(s) FROM ep) - 86400)")
def ep07_superseded(t):
    e = _epochs(t)
    comp = e.join(t.events.filter("event_type = 'signup'").select("event_id"), "event_id", "left_semi").groupBy("epoch").agg((F.max("ts") + 7_200).alias("ts"))
    return E.superseded(e, comp, 86_400).select("event_id")


@q(sql(SN, "r AS (SELECT epoch_us(start_time) // 1000000 s, epoch_us(end_time) // 1000000 e FROM sn WHERE complete AND start_time IS NOT NULL AND end_time IS NOT NULL)", "SELECT max(s) - 3600 drop_before FROM r WHERE s < (SELECT max(s) FROM r) AND (SELECT max(s) FROM r) - e > 14400"))
def wn11_safe_drop_time(t):
    us = lambda c: F.expr(f"cast(unix_micros(cast({c} as timestamp)) div 1000000 as bigint)")
    runs = t.snapshots.filter("start_time is not null and end_time is not null").select(us("start_time").alias("start"), us("end_time").alias("end"), F.col("complete").alias("success"))
    return E.safe_drop_time(runs, 14_400, 3_600)


# -- joins --------------------------------------------------------------------------------------
@q(sql(CW, "SELECT count(*) n, min(content_id) first_id, max(content_id) last_id, sum(timestamp_seconds)::BIGINT s FROM cw"))
def jn17_merge_sorted(t):
    """Many sorted index blobs merged to one row per id."""
    return t.contents.agg(F.count(F.lit(1)).alias("n"), F.min("content_id").alias("first_id"), F.max("content_id").alias("last_id"), F.sum("timestamp_seconds").alias("s"))


@q("WITH r AS (SELECT user_id, ts, max(event_id) eid FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, r.eid last_purchase FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts WHERE e.event_type = 'click'")
def jn18_as_of_join(t):
    e = t.events
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return as_of_join(left, right, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


# -- the rest -----------------------------------------------------------------------------------
@q("SELECT event_id, sum(event_id % 5000) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)::BIGINT total FROM (SELECT DISTINCT event_id, user_id, ts FROM events) WHERE event_id IS NOT NULL")
def wn07_running_totals(t):
    rows = t.events.select("event_id", "user_id", "ts").filter("event_id is not null").distinct()
    run = running_within(rows.withColumn("v", F.col("event_id") % 5000), ["user_id"], ["ts", "event_id"], sums={"total": "v"})
    return run.select("event_id", "total")


@q(f"WITH {_EP}, r AS (SELECT DISTINCT epoch // 10 * 10 lo, epoch // 10 * 10 + 9 hi FROM ep WHERE epoch IS NOT NULL) SELECT count(*) n, min(lo) lo, max(hi) hi FROM r")
def ep04_range_checkpoints(t):
    """Range checkpoints of ten epochs each and how far their chain from 0 reaches."""
    r = _epochs(t).filter("epoch is not null").select(F.expr("epoch div 10 * 10").alias("lo")).distinct().withColumn("hi", F.col("lo") + 9)
    return E.chain_of(r, 0).agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@q()
def ch04_blake3(t):
    return K.hashed(t.documents.filter("text is not null").select("doc_id", "text"), "text", "h", "BLAKE3-256", b"secret").select("doc_id", "h")


@q("SELECT doc_id, true same FROM documents WHERE text IS NOT NULL")
def ch05_s2_round_trip(t):
    rows = K.compressed(t.documents.filter("text is not null").select("doc_id", F.encode("text", "utf-8").alias("raw")), "raw", "c", "s2-default")
    back = K.decompressed(rows, "c", "plain", "s2-default")
    return back.select("doc_id", (F.coalesce("plain", "raw") == F.col("raw")).alias("same"))


@q("SELECT doc_id, true same, true other FROM documents WHERE text IS NOT NULL")
def ch07_chacha(t):
    """Texts sealed with a key per content and opened again."""
    rows = t.documents.filter("text is not null").select("doc_id", F.encode("text", "utf-8").alias("raw")).withColumn("cid", F.sha2("raw", 256))
    back = K.unsealed(K.sealed(rows, "raw", "secret", b"m" * 32, "cid"), "secret", "plain", b"m" * 32, "cid")
    return back.select("doc_id", (F.col("plain") == F.col("raw")).alias("same"), (F.col("secret") != F.col("raw")).alias("other"))


@q("SELECT doc_id, true mended FROM documents WHERE text IS NOT NULL")
def ch08_mended(t):
    """Texts with parity, damaged in four pieces and mended."""
    rows = K.protected(t.documents.filter("text is not null").select("doc_id", F.encode("text", "utf-8").alias("raw")), "raw", "block")
    piece = F.expr("(octet_length(block) - 8) div 20")
    zero = F.repeat(F.lit("\0"), (piece * 4).cast("int")).cast("binary")
    rows = rows.withColumn("block", F.overlay("block", zero, (F.lit(9) + piece * (F.col("doc_id") % 16)).cast("int"), (piece * 4).cast("int")))
    return K.mended(rows, "block", "plain").select("doc_id", (F.col("plain") == F.col("raw")).alias("mended"))


@q()
def ch06_smaller_only(t):
    """Texts whose compressed form is kept, because it is smaller."""
    rows = K.compressed(t.documents.filter("text is not null").select("doc_id", "text"), "text", "c", "gzip-best-speed")
    return rows.filter("c is not null").select("doc_id", (F.octet_length("text") - F.octet_length("c")).alias("saved"))


@q("SELECT doc_id, true same FROM documents WHERE text IS NOT NULL")
def ch07_encryption(t):
    rows = t.documents.filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("raw"), F.lit(b"1" * 32).alias("key"), F.encode(F.lit("id"), "utf-8").alias("cid"))
    return rows.withColumn("secret", K.encrypted(F.col("raw"), F.col("key"), F.col("cid"))).select("doc_id", (K.decrypted(F.col("secret"), F.col("key"), F.col("cid")) == F.col("raw")).alias("same"))


@q("SELECT event_id, to_json({'event_id': event_id, 'kind': event_type}) line FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL")
def sf19_json_params(t):
    rows = t.events.filter("event_id is not null and event_type is not null")
    return rows.select("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("line"))


@q()
def ms10_sampled_check(t):
    """Which index blobs a percentage gate has checked today: the same on every run of a day."""
    ids = t.content_entries.filter("index_blob_id is not null").select("index_blob_id").distinct()
    return ids.filter(F.pmod(F.xxhash64("index_blob_id", F.lit("2025-01-01")), F.lit(100)) < 10)
