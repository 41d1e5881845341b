"""What changed between consecutive full snapshots of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.ranking import HEAVY, rank_within
from moraine.operators.state import state_rows

SOURCE = ["host_name", "user_name", "source_path"]
COMPARED = ["entry_type", "file_mode", "file_size", "mod_time", "user_id", "group_id", "object_id"]


def usable_snapshots(manifests: DataFrame) -> DataFrame:
    """State rows that are live, complete and started: ``manifest_id``, source, ``start_time``, ``end_time``."""
    state = state_rows(manifests, "manifest_id", "modified_at", [*SOURCE, "start_time", "end_time", "incomplete_reason"])
    return state.filter(~F.col("deleted") & (F.coalesce("incomplete_reason", F.lit("")) == "") & F.col("start_time").isNotNull()).select("manifest_id", *SOURCE, "start_time", "end_time")


def canonical_mode(col):
    """Octal text without ``0o`` and leading zeros; any spelling of zero is ``0``, null stays null."""
    bare = F.regexp_replace(F.lower(F.trim(col)), "^0o", "")
    digits = F.regexp_replace(bare, "^0+", "")
    return F.when((digits == "") & (bare != ""), F.lit("0")).otherwise(digits)


def row_hash(columns):
    """64-bit hash of the values in which a null differs from every value and from a null elsewhere."""
    flags = sum((F.col(c).isNull().cast("int") * F.lit(1 << i) for i, c in enumerate(columns)), F.lit(0))
    return F.xxhash64(*columns, flags)


def snapshot_changes(manifests: DataFrame, entries: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Entries added, removed or changed against the snapshot just before, per source.

    Each listed usable snapshot gets its index in its source; each ``(source, path)`` is windowed
    by that index. A lag hash that differs is a change, an index gap before a row an addition, a
    gap after it a removal in the snapshot that follows. The window key is the path within a
    source, so the largest source spreads over as many tasks as it has paths.

    Columns: ``manifest_id`` (the later snapshot), ``entry_path``, ``diff_kind``. Rows without id
    or path are ignored; repeated rows count once, of differing rows for one path the newest
    ``listed_at`` counts. Nulls are equal to nulls only. A source's first snapshot has no rows.
    """
    rows = entries.filter(F.col("manifest_id").isNotNull() & F.col("entry_path").isNotNull()).withColumn("file_mode", canonical_mode(F.col("file_mode")))
    rows = rows.select("manifest_id", "entry_path", "listed_at", row_hash(COMPARED).alias("h"))
    listed = usable_snapshots(manifests).join(rows.select("manifest_id").distinct(), "manifest_id", "left_semi")
    ranked = rank_within(listed, SOURCE, ["start_time", "end_time", "manifest_id"], name="idx", heavy=heavy).select("manifest_id", *SOURCE, "idx")
    after = ranked.select(*SOURCE, (F.col("idx") - 1).alias("_i"), F.col("manifest_id").alias("next_id"))
    left = ranked.alias("a")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SOURCE] + [F.col("a.idx") == F.col("b._i")]
    chain = left.join(after.alias("b"), cond, "left").select(F.col("a.manifest_id").alias("manifest_id"), *[F.col(f"a.{c}").alias(c) for c in SOURCE], "idx", "next_id")
    placed = rows.join(chain, "manifest_id").repartition(*SOURCE, "entry_path")
    once = placed.groupBy(*SOURCE, "entry_path", "idx").agg(F.max(F.struct("listed_at", "h", "manifest_id", "next_id")).alias("r"))
    w = Window.partitionBy(*SOURCE, "entry_path").orderBy("idx")
    seen = once.select("entry_path", "idx", "r.h", "r.manifest_id", "r.next_id", F.lag("idx").over(w).alias("p_idx"), F.lag("r.h").over(w).alias("p_h"), F.lead("idx").over(w).alias("n_idx"))
    came = F.when((F.col("idx") > 1) & (F.coalesce("p_idx", F.lit(0)) < F.col("idx") - 1), F.lit("added")).when((F.col("p_idx") == F.col("idx") - 1) & (F.col("p_h") != F.col("h")), F.lit("changed"))
    went = F.when(F.col("next_id").isNotNull() & (F.coalesce("n_idx", F.lit(0)) != F.col("idx") + 1), F.lit("removed"))
    out = seen.select("entry_path", F.explode(F.filter(F.array(F.struct(F.col("manifest_id"), came.alias("diff_kind")), F.struct(F.col("next_id").alias("manifest_id"), went.alias("diff_kind"))), lambda x: x["diff_kind"].isNotNull())).alias("d"))
    return out.select("d.manifest_id", "entry_path", "d.diff_kind")


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of entries per snapshot and kind of change."""
    return changes.groupBy("manifest_id", "diff_kind").agg(F.count(F.lit(1)).alias("file_entries"))
