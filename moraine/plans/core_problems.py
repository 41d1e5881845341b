"""Queries p1, p2, p4 and p5 over the test tables, with check SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import cow, history, nested, orphans
from moraine.session import scratch_path
from moraine.plans.base import LV, PO, sql
from moraine.sources.tables import table


def p1_found(spark, d):
    return history.snapshot_changes(table(spark, d, "manifests"), table(spark, d, "snapshot_entries"))


def p1_file_entries(spark, d):
    return history.change_counts(p1_found(spark, d))


def p2_found(spark, d):
    return orphans.orphan_references(*(table(spark, d, t) for t in ("manifests", "dir_manifests", "pack_blobs", "content_entries")))


def p2_report(spark, d):
    return orphans.orphan_report(p2_found(spark, d))


def _contents(spark, payload=()):
    return cow.BucketedTable(spark, scratch_path(spark, "contents"), "content_id", cow.CONTENT_ORDER, payload)


def p4_found(spark, d):
    """Half of the feed, by arrival, is the base; the rest is merged into it in two deliveries."""
    t = _contents(spark)
    t.apply_deliveries(cow.content_feed(table(spark, d, "content_entries")), "arrived_at")
    return cow.alive_contents(t)


def p4_two_feeds(spark, d):
    """The feed in two deliveries, by arrival: the second touches and merges existing buckets."""
    t = _contents(spark, ["original_length", "packed_length"])
    t.apply_deliveries(cow.content_feed(table(spark, d, "content_entries")), "arrived_at", [0.5])
    return t.read().groupBy("live").agg(F.count(F.lit(1)).alias("n"), F.sum("timestamp_seconds").alias("sum_ts"), F.countDistinct("pack_blob_id").alias("packs"))


def p5_found(spark, d):
    return nested.policy_leaves(nested.policy_nodes(table(spark, d, "policies")))


def p5_nodes(spark, d):
    return nested.policy_nodes(table(spark, d, "policies")).select(F.col("record_id").alias("policy_id"), "node_id", "parent_id", "field_path", "leaf_pos", "node_kind", "node_text")


QUERIES = {f.__name__: f for f in (p1_found, p1_file_entries, p2_found, p2_report, p4_found, p4_two_feeds, p5_found, p5_nodes)}

_USABLE = """
usable AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC, deleted) rn FROM manifests)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND coalesce(incomplete_reason, '') = '' AND start_time IS NOT NULL)"""
_P1 = f"""
WITH {_USABLE},
snap AS (SELECT manifest_id, dense_rank() OVER (ORDER BY coalesce('v' || host_name, 'n'), coalesce('v' || user_name, 'n'), coalesce('v' || source_path, 'n')) src,
   row_number() OVER (PARTITION BY host_name, user_name, source_path ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) i
   FROM usable WHERE manifest_id IN (SELECT manifest_id FROM snapshot_entries)),
ent AS (SELECT DISTINCT s.src, s.i, s.manifest_id, e.entry_path, e.entry_type, ltrim(replace(e.file_mode, '0o', ''), '0') m, e.file_size, e.mod_time, e.user_id, e.group_id, e.object_id
   FROM snapshot_entries e JOIN snap s USING (manifest_id)),
later AS (SELECT b.src, b.i, b.manifest_id FROM snap b WHERE b.i > 1)
SELECT n.manifest_id, n.entry_path, CASE WHEN p.entry_path IS NULL THEN 'added' ELSE 'changed' END diff_kind
FROM ent n LEFT JOIN ent p ON p.src = n.src AND p.i = n.i - 1 AND p.entry_path = n.entry_path
WHERE n.i > 1 AND (p.entry_path IS NULL OR (n.entry_type, n.m, n.file_size, n.mod_time, n.user_id, n.group_id, n.object_id) IS DISTINCT FROM (p.entry_type, p.m, p.file_size, p.mod_time, p.user_id, p.group_id, p.object_id))
UNION ALL
SELECT l.manifest_id, p.entry_path, 'removed' FROM later l JOIN ent p ON p.src = l.src AND p.i = l.i - 1
LEFT JOIN ent n ON n.src = l.src AND n.i = l.i AND n.entry_path = p.entry_path WHERE n.entry_path IS NULL"""

_CONTENT = """
cw AS (SELECT * FROM (SELECT content_id, timestamp_seconds t, NOT coalesce(deleted, false) live, pack_blob_id,
   row_number() OVER (PARTITION BY content_id ORDER BY timestamp_seconds DESC, coalesce(deleted, false), pack_blob_id DESC NULLS LAST) rn,
   min(timestamp_seconds) FILTER (WHERE NOT coalesce(deleted, false)) OVER (PARTITION BY content_id) f
   FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL) WHERE rn = 1)"""
_P4 = f"WITH {_CONTENT} SELECT content_id, pack_blob_id FROM cw WHERE live"
_P2 = f"""
WITH {_CONTENT},
dm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir_oid ORDER BY written_at DESC NULLS LAST, deleted) rn,
   min(written_at) FILTER (WHERE NOT coalesce(deleted, false)) OVER (PARTITION BY dir_oid) f FROM dir_manifests) WHERE rn = 1),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY blob_ts DESC NULLS LAST, deleted) rn,
   min(blob_ts) FILTER (WHERE NOT coalesce(deleted, false)) OVER (PARTITION BY blob_id) f FROM pack_blobs) WHERE rn = 1),
mf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC NULLS LAST, deleted) rn FROM manifests) WHERE rn = 1),
targets AS (SELECT 'c' space, content_id k, live, make_timestamp(f * 1000000) f FROM cw
  UNION ALL SELECT 'k', dir_oid, NOT coalesce(deleted, false), f FROM dm UNION ALL SELECT 'p', blob_id, NOT coalesce(deleted, false), f FROM pk),
refs AS (SELECT 'content_entries' ref_table, content_id ref_key, 'p' space, pack_blob_id target_key, make_timestamp(t * 1000000) ref_at FROM cw WHERE live
  UNION ALL SELECT 'manifests', manifest_id, 'k', regexp_replace(root_entry.object_id, '^I*Z?', ''), end_time FROM mf WHERE NOT coalesce(deleted, false)
  UNION ALL SELECT 'dir_manifests', dir_oid, CASE WHEN e.entry_type = 'd' THEN 'k' ELSE 'c' END, regexp_replace(e.object_id, '^I*Z?', ''), written_at
    FROM (SELECT dir_oid, written_at, unnest(entries) e FROM dm WHERE NOT coalesce(deleted, false)))
SELECT DISTINCT ref_table, ref_key, target_key, orphan_kind, ref_month FROM (
  SELECT ref_table, ref_key, target_key, strftime(ref_at, '%Y-%m') ref_month,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN NOT t.live THEN 'deleted' WHEN t.f > ref_at THEN 'late' END orphan_kind
  FROM refs r LEFT JOIN targets t ON t.space = r.space AND t.k = r.target_key WHERE target_key IS NOT NULL) WHERE orphan_kind IS NOT NULL"""

ORACLE = {
    "p1_found": _P1,
    "p1_file_entries": f"SELECT manifest_id, diff_kind, count(*) file_entries FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p2_report": f"SELECT ref_table, ref_month, orphan_kind, count(*) n_references, count(DISTINCT target_key) n_targets FROM ({_P2}) GROUP BY ALL",
    "p4_found": _P4,
    "p5_found": sql(PO, LV, "SELECT policy_id, field_path, leaf_pos, leaf_text FROM lv"),
    "p4_two_feeds": f"WITH {_CONTENT} SELECT live, count(*) n, sum(t)::BIGINT sum_ts, count(DISTINCT pack_blob_id) packs FROM cw GROUP BY live",
}
