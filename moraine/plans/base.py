"""Registration of named queries and the views they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import contents
from moraine.operators.state import state_rows
from moraine.sources.tables import table


class Registry:
    """``@q(sql)`` registers a function of (tables) under its name; without SQL the query has no
    counterpart in SQL and is tested by other means."""

    def __init__(self):
        self.QUERIES, self.ORACLE = {}, {}

    def __call__(self, sql: str | None = None):
        def register(fn):
            self.QUERIES[fn.__name__] = lambda spark, d: fn(Tables(spark, d))
            if sql:
                self.ORACLE[fn.__name__] = sql
            return fn

        return register


class Tables:
    """Tables and state views of one directory."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, base

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.base, name)

    @property
    def contents(self):
        """Winning row of every content id, tombstones included."""
        return contents.merged(self.content_entries)

    @property
    def blobs(self):
        """State row of every blob, tombstones included."""
        return state_rows(self.pack_blobs, "blob_id", "blob_ts", ["blob_length"])

    @property
    def live_blobs(self):
        return self.blobs.filter(~F.col("deleted")).drop("deleted")

    @property
    def snapshots(self):
        """Live state rows of the snapshot manifests, flattened."""
        flat = self.manifests.withColumns({"root_oid": F.col("root_entry.object_id"), "total_size": F.col("stats.total_size"), "file_count": F.col("stats.file_count").cast("bigint"), "dir_count": F.col("stats.dir_count").cast("bigint"), "error_count": F.col("stats.error_count").cast("bigint"), "ignored_error_count": F.col("stats.ignored_error_count").cast("bigint"), "complete": F.coalesce("incomplete_reason", F.lit("")) == ""})
        keep = ["host_name", "user_name", "source_path", "start_time", "end_time", "incomplete_reason", "complete", "root_oid", "total_size", "file_count", "dir_count", "error_count", "ignored_error_count", "pins"]
        return state_rows(flat, "manifest_id", "modified_at", keep).filter(~F.col("deleted")).drop("deleted")

    @property
    def directories(self):
        """Live state rows of the directory manifests."""
        return state_rows(self.dir_manifests, "dir_oid", "written_at", ["entries", "summary"]).filter(~F.col("deleted")).drop("deleted")


# The same views in SQL.
CW = """cw AS (SELECT content_id, timestamp_seconds, NOT coalesce(deleted, false) live, pack_blob_id, original_length, packed_length, pack_offset, compression_id, index_blob_id
  FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY timestamp_seconds DESC, coalesce(deleted, false), pack_blob_id DESC NULLS LAST, original_length DESC NULLS LAST,
    packed_length DESC NULLS LAST, pack_offset DESC NULLS LAST, compression_id DESC NULLS LAST, index_blob_id DESC NULLS LAST) rn
    FROM content_entries WHERE content_id IS NOT NULL AND timestamp_seconds IS NOT NULL) WHERE rn = 1)"""
BL = """bl AS (SELECT blob_id, blob_ts, coalesce(deleted, false) deleted, blob_length FROM (SELECT *, row_number() OVER (PARTITION BY blob_id
  ORDER BY blob_ts DESC NULLS LAST, coalesce(deleted, false), blob_length DESC NULLS LAST) rn FROM pack_blobs WHERE blob_id IS NOT NULL) WHERE rn = 1)"""
SN = """sn AS (SELECT manifest_id, modified_at, host_name, user_name, source_path, start_time, end_time, incomplete_reason, coalesce(incomplete_reason, '') = '' complete, root_entry.object_id root_oid,
    stats.total_size total_size, stats.file_count::BIGINT file_count, stats.dir_count::BIGINT dir_count, stats.error_count::BIGINT error_count, stats.ignored_error_count::BIGINT ignored_error_count, pins
  FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC NULLS LAST, coalesce(deleted, false)) rn FROM manifests WHERE manifest_id IS NOT NULL)
  WHERE rn = 1 AND NOT coalesce(deleted, false))"""
DI = """di AS (SELECT dir_oid, written_at, entries, summary FROM (SELECT *, row_number() OVER (PARTITION BY dir_oid ORDER BY written_at DESC NULLS LAST, coalesce(deleted, false)) rn
  FROM dir_manifests WHERE dir_oid IS NOT NULL) WHERE rn = 1 AND NOT coalesce(deleted, false))"""
EN = """en AS (SELECT dir_oid, written_at, e.* FROM (SELECT dir_oid, written_at, unnest(entries) e FROM di))"""


PO = """po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY modified_at DESC NULLS LAST, coalesce(deleted, false)) rn FROM policies WHERE policy_id IS NOT NULL)
  WHERE rn = 1 AND NOT coalesce(deleted, false))"""
#: Non-null values of the policies' sections.
LV = r"""p1 AS (SELECT policy_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN payload->>'$' ELSE payload END END p FROM po),
p2 AS (SELECT policy_id, s, CASE WHEN json_valid(p) THEN json_extract(p, '$.' || s) END v FROM p1, (VALUES ('retention'), ('scheduling'), ('files'), ('osSnapshots')) x(s) WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
p3 AS (SELECT policy_id, s, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END v FROM p2 WHERE v IS NOT NULL),
lv AS (SELECT DISTINCT policy_id, s || regexp_replace(t.fullkey[2:], '\[[0-9]+\]', '', 'g') field_path,
    CASE WHEN regexp_matches(t.fullkey, '\[[0-9]+\]') THEN regexp_extract(t.fullkey, '.*\[([0-9]+)\]', 1)::BIGINT WHEN regexp_matches(t.fullkey, '^\$(\.[^.]+)*\.(ignore|ignoreDotFiles|timeOfDay|cron)(\.|$)') THEN 0 ELSE -1 END leaf_pos,
    t.atom->>'$' leaf_text FROM p3, json_tree(v) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))"""


def sql(*parts: str) -> str:
    """``WITH`` views, then the query (the last part)."""
    return f"WITH {', '.join(parts[:-1])} {parts[-1]}"
