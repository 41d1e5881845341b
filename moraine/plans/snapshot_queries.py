"""Queries over snapshot manifests (WN, AG, ST, JN10-11, JN16, MS)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moraine.operators import ranking as R
from moraine.operators import snapshots as S
from moraine.operators.history import SOURCE
from moraine.plans.base import SN, Registry, sql

q = Registry()
QUERIES, ORACLE = q.QUERIES, q.ORACLE

SRC = "host_name, user_name, source_path"
KEEP = {"latest": 3, "hourly": 5, "daily": 7, "weekly": 4, "monthly": 12, "annual": 2}


def _reason_sql(keep):
    pid = {"annual": "strftime(start_time, '%Y')", "monthly": "strftime(start_time, '%Y-%m')", "weekly": "printf('%04d-%02d', isoyear(start_time), week(start_time))", "daily": "strftime(start_time, '%Y-%m-%d')", "hourly": "strftime(start_time, '%Y-%m-%d %H')"}
    cut = {"annual": f"date_trunc('month', mc) - INTERVAL {keep['annual'] * 12} MONTH + (mc - date_trunc('month', mc))", "monthly": f"date_trunc('month', mc) - INTERVAL {keep['monthly']} MONTH + (mc - date_trunc('month', mc))", "weekly": f"mc - INTERVAL {keep['weekly'] * 7} DAY", "daily": f"mc - INTERVAL {keep['daily']} DAY", "hourly": f"mc - INTERVAL {keep['hourly']} HOUR"}
    o = "start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC"
    parts = [f"""lo AS (SELECT *, max(start_time) FILTER (WHERE complete) OVER (PARTITION BY {SRC}) mc, max(start_time) OVER (PARTITION BY {SRC}) mx,
      row_number() OVER (PARTITION BY {SRC} ORDER BY {o}) i, count(*) FILTER (WHERE complete) OVER (PARTITION BY {SRC} ORDER BY {o}) nc FROM sn)""",
      f"latest AS (SELECT manifest_id, row_number() OVER (PARTITION BY {SRC} ORDER BY {o}) k FROM lo WHERE complete)"]
    for kind in ("annual", "monthly", "weekly", "daily", "hourly"):
        extra = " AND NOT EXISTS (SELECT 1 FROM monthly m WHERE m.k <= " + str(keep["monthly"]) + " AND m.p = x.p AND m.host_name IS NOT DISTINCT FROM x.host_name AND m.user_name IS NOT DISTINCT FROM x.user_name AND m.source_path IS NOT DISTINCT FROM x.source_path)" if kind == "weekly" else ""
        parts.append(f"""{kind} AS (SELECT *, row_number() OVER (PARTITION BY {SRC} ORDER BY {o}) k FROM (SELECT * FROM (SELECT *, {pid[kind]} p, row_number() OVER (PARTITION BY {SRC}, {pid[kind]} ORDER BY {o}) f
          FROM lo WHERE complete AND start_time >= {cut[kind]}) x WHERE f = 1{extra}))""")
    picks = " UNION ALL ".join(f"SELECT manifest_id, '{kind}-' || k reason FROM {kind} WHERE k <= {keep[kind]}" for kind in S.KINDS)
    parts.append(f"reasons AS ({picks} UNION ALL SELECT manifest_id, 'incomplete' FROM lo WHERE NOT complete AND nc = 0 AND (start_time > mx - INTERVAL 4 HOUR OR i <= 3))")
    return parts


_REASONS = _reason_sql(KEEP)


@q(sql(SN, *_REASONS, "SELECT manifest_id, reason FROM reasons"))
def wn01_retention_reasons(t):
    return S.retention_reasons(t.snapshots, KEEP)


@q(sql(SN, *_REASONS, "SELECT manifest_id FROM reasons WHERE reason = 'incomplete'"))
def wn02_incomplete_kept(t):
    return S.incomplete_kept(t.snapshots.select("manifest_id", *SOURCE, "start_time", "end_time", "complete")).select("manifest_id")


@q(sql(SN, *_REASONS, "SELECT manifest_id FROM sn WHERE manifest_id NOT IN (SELECT manifest_id FROM reasons) AND coalesce(len(pins), 0) = 0"))
def wn03_expired(t):
    return S.expired(t.snapshots, S.retention_reasons(t.snapshots, KEEP)).select("manifest_id")


@q(sql(SN, f"SELECT manifest_id, lag(manifest_id) OVER (PARTITION BY {SRC} ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) previous_id FROM sn"))
def wn04_preceding(t):
    return S.with_previous(t.snapshots).select("manifest_id", "previous_id")


@q(sql(SN, f"SELECT manifest_id, r::BIGINT place FROM (SELECT manifest_id, row_number() OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r FROM sn) WHERE r <= 2"))
def wn05_two_latest(t):
    w = Window.partitionBy(*SOURCE).orderBy(F.struct("start_time", "end_time", "manifest_id").desc())
    return t.snapshots.withColumn("place", F.row_number().over(w)).filter("place <= 2").select("manifest_id", F.col("place").cast("bigint"))


@q(sql(SN, f"b AS (SELECT *, row_number() OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r FROM sn WHERE complete)", "SELECT manifest_id FROM b WHERE r = 1 UNION ALL SELECT s.manifest_id FROM sn s LEFT JOIN b ON b.r = 1 AND s.host_name IS NOT DISTINCT FROM b.host_name AND s.user_name IS NOT DISTINCT FROM b.user_name AND s.source_path IS NOT DISTINCT FROM b.source_path WHERE NOT s.complete AND (b.manifest_id IS NULL OR s.start_time > b.start_time)"))
def wn06_previous_manifests(t):
    return S.previous_manifests(t.snapshots)


@q(sql(SN, f"SELECT manifest_id, total_size - last_value(CASE WHEN complete THEN total_size END IGNORE NULLS) OVER (PARTITION BY {SRC} ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) delta FROM sn"))
def wn08_size_delta(t):
    return S.delta_to_complete(t.snapshots, "total_size")


@q(sql(SN, f"SELECT {SRC}, count(*) n, sum(total_size)::BIGINT bytes FROM sn GROUP BY ALL"))
def ag14_by_source(t):
    return t.snapshots.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n"), F.sum("total_size").alias("bytes"))


@q(sql(SN, f"SELECT DISTINCT {SRC} FROM sn"))
def ag15_sources(t):
    return t.snapshots.select(*SOURCE).distinct()


@q("SELECT manifest_id, count(*) n, sum(file_size)::BIGINT bytes, count(*) FILTER (WHERE entry_type = 's') links, max(mod_time) last_change FROM snapshot_entries GROUP BY 1")
def ag10_snapshot_stats(t):
    return t.snapshot_entries.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"), F.count(F.when(F.col("entry_type") == "s", 1)).alias("links"), F.max("mod_time").alias("last_change"))


_RUNS = f"""r AS (SELECT *, sum(b) OVER (PARTITION BY {SRC} ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) run FROM (SELECT *, CASE WHEN lag(manifest_id) OVER w IS NULL OR lag(root_oid) OVER w IS DISTINCT FROM root_oid THEN 1 ELSE 0 END b
  FROM sn WINDOW w AS (PARTITION BY {SRC} ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id)))"""


@q(sql(SN, _RUNS, f"SELECT {SRC}, root_oid, first(start_time ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) first_start, last(start_time ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) last_start, count(*) n FROM r GROUP BY {SRC}, run, root_oid"))
def ag16_identical_runs(t):
    return S.identical_runs(t.snapshots).drop("pins")


@q(sql(SN, _RUNS, f"SELECT {SRC}, root_oid, first(start_time ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) begins, count(*) n, coalesce(list_sort(list_distinct(flatten(list(pins) FILTER (WHERE pins IS NOT NULL)))), []) pins FROM r GROUP BY {SRC}, run, root_oid"))
def ag16_runs_with_pins(t):
    """The runs with the pins of all their snapshots."""
    return S.identical_runs(t.snapshots).select(*SOURCE, "root_oid", F.col("first_start").alias("begins"), "n", "pins")


@q(sql(SN, "SELECT root_oid, min_by(manifest_id, (coalesce(start_time, timestamp '0001-01-01'), coalesce(end_time, timestamp '0001-01-01'), manifest_id)) manifest_id, count(*) n, coalesce(list_sort(list_distinct(flatten(list(pins) FILTER (WHERE pins IS NOT NULL)))), []) pins FROM sn GROUP BY 1"))
def ag17_unique_roots(t):
    return S.unique_roots(t.snapshots)


@q(sql(SN, *_REASONS, "SELECT sn.root_oid, min_by(sn.manifest_id, (start_time IS NOT NULL, coalesce(start_time, timestamp '0001-01-01'), end_time IS NOT NULL, coalesce(end_time, timestamp '0001-01-01'), sn.manifest_id)) first_id, count(DISTINCT sn.manifest_id) n, coalesce(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), []) reasons FROM sn LEFT JOIN reasons USING (manifest_id) GROUP BY 1"))
def ag17_reasons_by_root(t):
    """Snapshots of one root as one row, with all reasons to keep any of them."""
    sn = t.snapshots
    return S.reasons_by_root(sn, S.retention_reasons(sn, KEEP))


_TAGS = sql(SN, *_REASONS, f"p AS (SELECT {SRC}, split_part(reason, '-', 1) k, split_part(reason, '-', 2)::INT n FROM reasons JOIN sn USING (manifest_id) WHERE reason <> 'incomplete')", f"g AS (SELECT *, n - row_number() OVER (PARTITION BY {SRC}, k ORDER BY n) r FROM p)", f"SELECT concat_ws('|', coalesce('v' || host_name, 'n'), coalesce('v' || user_name, 'n'), coalesce('v' || source_path, 'n')) source, CASE WHEN min(n) = max(n) THEN k || '-' || min(n) ELSE k || '-' || min(n) || '..' || max(n) END tag FROM g GROUP BY {SRC}, k, r")


@q(_TAGS)
def ag18_compact_tags(t):
    sn = t.snapshots
    name = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) for c in SOURCE])
    rows = S.retention_reasons(sn, KEEP).filter("reason <> 'incomplete'").join(sn.select("manifest_id", name.alias("source")), "manifest_id")
    return S.compact_tags(rows, "source", "reason")


@q(sql(SN, "SELECT manifest_id, list_sort(list_distinct(pins)) pins FROM sn WHERE pins IS NOT NULL"))
def ag19_compact_pins(t):
    return t.snapshots.filter("pins is not null").select("manifest_id", S.compact_pins(F.col("pins")).alias("pins"))


@q(sql(SN, "SELECT manifest_id, CASE WHEN NOT complete THEN 'incomplete' WHEN error_count > 0 THEN 'fatal' WHEN ignored_error_count > 0 THEN 'warnings' ELSE 'success' END status FROM sn"))
def ag20_status(t):
    return t.snapshots.select("manifest_id", S.status_code().alias("status"))


@q(sql(SN, "s AS (SELECT host_name, CASE WHEN NOT complete THEN 'incomplete' WHEN error_count > 0 THEN 'fatal' WHEN ignored_error_count > 0 THEN 'warnings' ELSE 'success' END st FROM sn)", "SELECT host_name, CASE WHEN bool_or(st = 'fatal') THEN 'fatal' WHEN bool_or(st = 'warnings') THEN 'warnings' ELSE 'success' END status, count(*) n FROM s GROUP BY 1"))
def ag20_overall(t):
    return S.overall_status(t.snapshots, ["host_name"])


@q(sql(SN, f"SELECT manifest_id, total_size - lag(total_size) OVER w size_delta, file_count - lag(file_count) OVER w file_delta, dir_count - lag(dir_count) OVER w dir_delta FROM sn WINDOW w AS (PARTITION BY {SRC} ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id)"))
def ag21_deltas(t):
    return S.deltas(t.snapshots, {"size_delta": "total_size", "file_delta": "file_count", "dir_delta": "dir_count"})


@q("SELECT entry_type, count(*) n, count(object_id) with_object, sum(file_size)::BIGINT bytes FROM snapshot_entries GROUP BY 1")
def ag22_verify_counters(t):
    return t.snapshot_entries.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), F.count("object_id").alias("with_object"), F.sum("file_size").alias("bytes"))


@q(sql(SN, "SELECT count(*) FILTER (WHERE complete) complete, count(*) FILTER (WHERE NOT complete) incomplete, sum(total_size)::BIGINT bytes, max(start_time) last_start FROM sn"))
def ag23_task_stats(t):
    return t.snapshots.agg(F.count(F.when(F.col("complete"), 1)).alias("complete"), F.count(F.when(~F.col("complete"), 1)).alias("incomplete"), F.sum("total_size").alias("bytes"), F.max("start_time").alias("last_start"))


@q(sql(SN, "SELECT manifest_id, start_time, end_time FROM sn ORDER BY start_time DESC, end_time DESC, manifest_id DESC"))
def st01_by_time(t):
    return t.snapshots.select("manifest_id", "start_time", "end_time").orderBy(F.desc("start_time"), F.desc("end_time"), F.desc("manifest_id"))


@q(sql(SN, f"SELECT manifest_id FROM (SELECT manifest_id, row_number() OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r FROM sn) WHERE r <= 4"))
def st02_last_n(t):
    w = Window.partitionBy(*SOURCE).orderBy(F.struct("start_time", "end_time", "manifest_id").desc())
    return t.snapshots.withColumn("r", F.row_number().over(w)).filter("r <= 4").select("manifest_id")


@q(sql(SN, "SELECT host_name, max_by(manifest_id, (modified_at, manifest_id)) manifest_id FROM sn GROUP BY 1"))
def st08_latest_pick(t):
    return t.snapshots.groupBy("host_name").agg(F.max_by("manifest_id", F.struct("modified_at", "manifest_id")).alias("manifest_id"))


@q(sql(SN, "SELECT user_name, manifest_id FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY modified_at DESC, manifest_id DESC) r FROM sn) WHERE r = 1 ORDER BY modified_at, manifest_id"))
def st09_dedupe_by_label(t):
    best = t.snapshots.groupBy("user_name").agg(F.max(F.struct("modified_at", "manifest_id")).alias("b"))
    return best.orderBy("b").select("user_name", F.col("b.manifest_id").alias("manifest_id"))


@q(sql(SN, "SELECT root_oid, max_by(manifest_id, (start_time, manifest_id)) manifest_id FROM sn WHERE start_time IS NOT NULL GROUP BY 1"))
def st10_latest_of_root(t):
    return t.snapshots.filter("start_time is not null").groupBy("root_oid").agg(F.max_by("manifest_id", F.struct("start_time", "manifest_id")).alias("manifest_id"))


@q(sql(SN, f"c AS (SELECT DISTINCT {SRC}, start_time, root_oid FROM sn)", """SELECT s.manifest_id, CASE WHEN s.host_name IS NOT DISTINCT FROM 'relay-hub' THEN 'same source' WHEN EXISTS (SELECT 1 FROM c WHERE c.host_name = 'relay-hub' AND c.user_name IS NOT DISTINCT FROM s.user_name AND c.source_path IS NOT DISTINCT FROM s.source_path
  AND c.start_time IS NOT DISTINCT FROM s.start_time AND c.root_oid IS NOT DISTINCT FROM s.root_oid) THEN 'duplicate' ELSE 'copy' END AS action FROM sn s"""))
def jn10_copy_history(t):
    return S.copy_candidates(t.snapshots, {"host_name": F.lit("relay-hub")}).select("manifest_id", "action")


@q(sql(SN, f"SELECT manifest_id FROM sn a WHERE complete AND start_time IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.host_name = 'relay-hub' AND b.start_time = a.start_time)"))
def jn11_migrate(t):
    """Complete snapshots whose start time isn't there yet at the destination host."""
    sn = t.snapshots
    have = sn.filter("host_name = 'relay-hub' and start_time is not null").select("start_time").distinct()
    return sn.filter("complete and start_time is not null").join(have, "start_time", "left_anti").select("manifest_id")


@q(sql(SN, f"SELECT {SRC}, max(start_time) last_start, max(start_time) FILTER (WHERE complete) last_complete, count(*) n FROM sn GROUP BY ALL"))
def jn16_source_status(t):
    return t.snapshots.groupBy(*SOURCE).agg(F.max("start_time").alias("last_start"), F.max(F.when(F.col("complete"), F.col("start_time"))).alias("last_complete"), F.count(F.lit(1)).alias("n"))


@q("SELECT manifest_id, modified_at, deleted, start_time FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC NULLS LAST, deleted) rn FROM manifests) WHERE rn = 1 AND NOT deleted")
def ix16_manifest_merge(t):
    return t.snapshots.select("manifest_id", "modified_at", F.lit(False).alias("deleted"), "start_time")


@q(sql(SN, "SELECT manifest_id, modified_at FROM sn WHERE host_name = 'relay-hub' ORDER BY modified_at, manifest_id"))
def fi02_find_manifests(t):
    return t.snapshots.filter("host_name = 'relay-hub'").select("manifest_id", "modified_at").orderBy("modified_at", "manifest_id")


@q(sql(SN, "SELECT manifest_id FROM sn WHERE (host_name = 'relay-hub') AND (NULL IS NULL OR user_name = NULL)"))
def fi15_source_filter(t):
    """Source filter in which a blank part matches anything."""
    wanted = {"host_name": "relay-hub", "user_name": "", "source_path": ""}
    cond = F.lit(True)
    for c, v in wanted.items():
        cond &= F.lit(True) if not v else F.coalesce(F.col(c) == v, F.lit(False))
    return t.snapshots.filter(cond).select("manifest_id")


@q(sql(SN, "SELECT root_oid, count(*) n, count(DISTINCT source_path) paths FROM sn WHERE root_oid IS NOT NULL GROUP BY 1"))
def gr03_resolve_root(t):
    return t.snapshots.filter("root_oid is not null").groupBy("root_oid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_path").alias("paths"))


@q(sql(SN, "SELECT root_oid FROM sn WHERE root_oid IS NOT NULL GROUP BY 1"))
def se06_unique_roots(t):
    return t.snapshots.filter("root_oid is not null").dropDuplicates(["root_oid"]).select("root_oid")


@q(sql(SN, "SELECT manifest_id, list_sort(list_distinct(list_filter(list_concat(coalesce(pins, []), ['keep']), lambda x: x <> 'audit'))) pins FROM sn"))
def ms12_update_pins(t):
    return t.snapshots.select("manifest_id", S.updated_pins(F.col("pins"), ["keep"], ["audit"]).alias("pins"))


@q(sql(SN, "SELECT manifest_id FROM sn WHERE root_oid IS NULL OR root_oid NOT IN (SELECT root_oid FROM sn WHERE root_oid IS NOT NULL AND NOT complete)"))
def ms13_delete_by_root(t):
    sn = t.snapshots
    return sn.join(sn.filter("not complete and root_oid is not null").select("root_oid").distinct(), "root_oid", "left_anti").select("manifest_id")


@q(sql(SN, "SELECT manifest_id, start_time IS NULL OR end_time IS NULL OR start_time <= end_time ok FROM sn"))
def ms03_time_check(t):
    return t.snapshots.select("manifest_id", F.coalesce(F.col("start_time") <= F.col("end_time"), F.lit(True)).alias("ok"))


@q(sql(SN, "SELECT manifest_id, abs(epoch_us(modified_at) - epoch_us(end_time)) > 60000000 skewed FROM sn WHERE end_time IS NOT NULL"))
def ms04_clock_skew(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.snapshots.filter("end_time is not null").select("manifest_id", (F.abs(us("modified_at") - us("end_time")) > 60_000_000).alias("skewed"))


@q(sql(SN, "SELECT manifest_id, CASE WHEN complete THEN 1 ELSE 2 END severity FROM sn WHERE CASE WHEN complete THEN 1 ELSE 2 END >= 2"))
def ms01_severity(t):
    return t.snapshots.withColumn("severity", F.when(F.col("complete"), 1).otherwise(2)).filter("severity >= 2").select("manifest_id", "severity")


@q(sql(SN, f"SELECT {SRC}, count(*) FILTER (WHERE r <= 4) kept FROM (SELECT *, row_number() OVER (PARTITION BY {SRC} ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r FROM sn) GROUP BY {SRC}"))
def wn12_keep_last_runs(t):
    ranked = R.rank_within(t.snapshots, SOURCE, ["start_time", "end_time", "manifest_id"], descending=True)
    return ranked.groupBy(*SOURCE).agg(F.count(F.when(F.col("rank") <= 4, 1)).alias("kept"))


@q(sql(SN, f"SELECT {SRC}, max(end_time) FILTER (WHERE complete) last_success FROM sn GROUP BY ALL"))
def wn13_last_success(t):
    return t.snapshots.groupBy(*SOURCE).agg(F.max(F.when(F.col("complete"), F.col("end_time"))).alias("last_success"))
