"""Queries p3, p6, p7 and p8 over the test tables, with check SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.llm import langid, packing, topn, winnow
from moraine.operators.history import SOURCE, usable_snapshots
from moraine.session import materialise
from moraine.sources.tables import table

#: Snapshots kept per source.
LATEST = 5


def p3_found(spark, d):
    # Counted, sliced and ranked apart: the state of the manifests is computed once.
    usable = materialise(usable_snapshots(table(spark, d, "manifests")), "usable")
    best = topn.top_n(usable, SOURCE, ["start_time", "end_time", "manifest_id"], LATEST)
    return best.select("manifest_id", F.concat(F.lit("latest-"), F.col("rank").cast("string")).alias("retention_tag"))


def p3_largest_files(spark, d):
    """The ten largest entries of every kind of mode over all listings."""
    rows = table(spark, d, "snapshot_entries").filter("object_id is not null").groupBy("file_mode", "object_id").agg(F.max("file_size").alias("file_size"))
    return topn.top_n(rows, ["file_mode"], ["file_size", "object_id"], 10).select("file_mode", "object_id", "file_size", F.col("rank").cast("int"))


def p3_newest_contents(spark, d):
    """The ten newest index rows of every pack; packs of more than 500 rows are sliced."""
    rows = table(spark, d, "content_entries").filter("pack_blob_id is not null and content_id is not null").groupBy("pack_blob_id", "content_id").agg(F.max("timestamp_seconds").alias("newest"))
    best = topn.top_n(materialise(rows, "newest"), ["pack_blob_id"], ["newest", "content_id"], 10, heavy=500)
    return best.select("pack_blob_id", "content_id", "newest", "rank")


def p6_packing(spark, d):
    return packing.packed(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_fill(spark, d):
    return packing.fill(p6_packing(spark, d), table(spark, d, "containers"))


def p7_found(spark, d):
    return winnow.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    """Documents that hold each leaked item."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_found(spark, d):
    return langid.wrong_labels(p8_labels(spark, d))


def p8_labels(spark, d):
    return langid.language_stretches(table(spark, d, "documents"), table(spark, d, "lang_samples"))


QUERIES = {f.__name__: f for f in (p3_found, p3_largest_files, p3_newest_contents, p6_packing, p6_fill, p7_found, p7_items, p8_found, p8_labels)}

ORACLE = {
    "p3_found": """
SELECT manifest_id, 'latest-' || r retention_tag FROM (SELECT manifest_id,
   row_number() OVER (PARTITION BY host_name, user_name, source_path ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r
   FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC, deleted) rn FROM manifests)
   WHERE rn = 1 AND NOT coalesce(deleted, false) AND coalesce(incomplete_reason, '') = '' AND start_time IS NOT NULL) WHERE r <= 5""",
    "p3_newest_contents": """
SELECT pack_blob_id, content_id, newest, rank FROM (SELECT *, row_number() OVER (PARTITION BY pack_blob_id ORDER BY newest DESC NULLS LAST, content_id DESC)::INTEGER rank
   FROM (SELECT pack_blob_id, content_id, max(timestamp_seconds) newest FROM content_entries WHERE pack_blob_id IS NOT NULL AND content_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""",
    "p3_largest_files": """
SELECT file_mode, object_id, file_size, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_mode ORDER BY file_size DESC NULLS LAST, object_id DESC)::INTEGER rank
   FROM (SELECT file_mode, object_id, max(file_size) file_size FROM snapshot_entries WHERE object_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""",
}
