"""References whose target is missing, deleted or younger than the referrer.

Keys are dictionary-encoded to small integers within hash ranges. For each range and month one
compressed bitmap holds the keys referred to and one the keys that exist by then; reference
AND-NOT existing leaves the suspects, whose bits are decoded to keys. Only references to
suspects are looked at one by one, for the exact time and kind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.bitmaps import Bitmap
from moraine.operators.ranking import HEAVY, HotKeys
from moraine.operators.state import state_rows
from moraine.session import materialise, shuffle_partitions

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: Month of references without a time, after all months: they are suspects of every kind but late.
NO_MONTH = 999_999
#: References and targets of one key range, which one task encodes.
RANGE_KEYS = 200_000
#: Kinds of target.
PACK, DIRECTORY, CONTENT = "p", "k", "c"


def _month(col):
    return (F.year(col) * 12 + F.month(col) - 1).cast("int")


def _seconds_to_ntz(col):
    """Unix seconds as time without zone; seconds outside years 1 to 9999 give null."""
    ok = (col >= -62_135_596_800) & (col <= 253_402_300_799)
    return F.when(ok, F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col.cast("decimal(18,6)")))


def object_key(col):
    """Key of an object id: any number of ``I``, then at most one ``Z``, stripped."""
    return F.regexp_replace(col, "^I*Z?", "")


def content_states(entries: DataFrame) -> DataFrame:
    """Per usable content: the winning row and the earliest live time, in one aggregation."""
    usable = entries.filter(F.col("content_id").isNotNull() & F.col("timestamp_seconds").isNotNull())
    live = ~F.coalesce("deleted", F.lit(False))
    t = F.col("timestamp_seconds")
    agg = usable.groupBy("content_id").agg(F.max(F.struct(t.alias("t"), live.alias("live"), F.col("pack_blob_id"))).alias("w"), F.min(F.when(live, t)).alias("first"))
    return agg.select("content_id", F.col("w.t").alias("t"), F.col("w.live").alias("live"), F.col("w.pack_blob_id").alias("pack_blob_id"), "first")


def _references(manifests: DataFrame, directories: DataFrame, contents: DataFrame) -> DataFrame:
    c = contents.filter("live").select(F.lit("content_entries").alias("ref_table"), F.col("content_id").alias("ref_key"), F.lit(PACK).alias("space"), F.col("pack_blob_id").alias("target_key"), _seconds_to_ntz(F.col("t")).alias("ref_time"))
    m = state_rows(manifests.withColumn("root_oid", F.col("root_entry.object_id")), "manifest_id", "modified_at", ["root_oid", "end_time"]).filter(~F.col("deleted"))
    m = m.select(F.lit("manifests").alias("ref_table"), F.col("manifest_id").alias("ref_key"), F.lit(DIRECTORY).alias("space"), object_key(F.col("root_oid")).alias("target_key"), F.col("end_time").alias("ref_time"))
    slim = directories.withColumn("entries", F.transform("entries", lambda e: F.struct(e["entry_type"].alias("entry_type"), e["object_id"].alias("object_id"))))
    d = state_rows(slim, "dir_oid", "written_at", ["entries"]).filter(~F.col("deleted"))
    d = d.select("dir_oid", "written_at", F.explode("entries").alias("e")).filter(F.col("e.entry_type").isin("d", "f", "s"))
    d = d.select(F.lit("dir_manifests").alias("ref_table"), F.col("dir_oid").alias("ref_key"), F.when(F.col("e.entry_type") == "d", F.lit(DIRECTORY)).otherwise(F.lit(CONTENT)).alias("space"), object_key(F.col("e.object_id")).alias("target_key"), F.col("written_at").alias("ref_time"))
    return c.unionByName(m).unionByName(d).filter(F.col("target_key").isNotNull())


def _targets(directories: DataFrame, packs: DataFrame, contents: DataFrame) -> DataFrame:
    """``space, target_key, alive, first`` (earliest live time)."""

    def stored(df: DataFrame, key: str, at: str, space: str) -> DataFrame:
        live = ~F.coalesce("deleted", F.lit(False))
        agg = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at), live.alias("live"))).alias("w"), F.min(F.when(live, F.col(at))).alias("first"))
        return agg.select(F.lit(space).alias("space"), F.col(key).alias("target_key"), F.col("w.live").alias("alive"), "first")

    c = contents.select(F.lit(CONTENT).alias("space"), F.col("content_id").alias("target_key"), F.col("live").alias("alive"), _seconds_to_ntz(F.col("first")).alias("first"))
    return c.unionByName(stored(directories, "dir_oid", "written_at", DIRECTORY)).unionByName(stored(packs, "blob_id", "blob_ts", PACK))


def _suspects_of_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range: encode keys, build a bitmap per month and side, AND-NOT, decode."""
    keys = pdf["space"].str.cat(pdf["target_key"])
    codes, uniques = pd.factorize(keys)
    n = len(uniques)
    month, is_ref = pdf["month"].to_numpy(), pdf["is_ref"].to_numpy()
    parents, exists = ~is_ref, Bitmap.empty(n)
    p_month, p_codes = month[parents], codes[parents]
    order = np.argsort(p_month, kind="stable")
    p_month, p_codes, at = p_month[order], p_codes[order], 0
    found_codes, found_months = [], []
    r_month, r_codes = month[is_ref], codes[is_ref]
    for m in np.unique(r_month):
        upto = np.searchsorted(p_month, m, side="left")  # targets that were there before this month
        if upto > at:
            exists = exists | Bitmap.of(p_codes[at:upto], n)
            at = upto
        left = Bitmap.of(r_codes[r_month == m], n).and_not(exists).decode()
        found_codes.append(left)
        found_months.append(np.full(len(left), m, dtype=np.int32))
    code = np.concatenate(found_codes) if found_codes else np.empty(0, np.int64)
    whole = np.asarray(uniques, dtype=object)[code] if len(code) else np.empty(0, object)
    return pd.DataFrame({"space": [k[0] for k in whole], "target_key": [k[1:] for k in whole], "month": np.concatenate(found_months) if found_months else np.empty(0, np.int32)}, columns=["space", "target_key", "month"])


def suspects(counts: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """``space, target_key, month`` of references not covered by a target that is alive and was
    there before the month began. ``counts`` has the references as distinct ``space, target_key,
    month``, so a key that a third of all references name arrives once per month."""
    r = counts.select("space", "target_key", "month", F.lit(True).alias("is_ref"))
    t = targets.filter("alive").select("space", "target_key", F.coalesce(_month(F.col("first")), F.lit(-1)).alias("month"), F.lit(False).alias("is_ref"))
    both = r.unionByName(t).withColumn("range", F.pmod(F.xxhash64("space", "target_key"), F.lit(ranges)).cast("int"))
    return both.groupBy("range").applyInPandas(_suspects_of_range, "space string, target_key string, month int")


def orphan_references(manifests: DataFrame, directories: DataFrame, packs: DataFrame, content_entries: DataFrame, ranges: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """Orphan references with kind and month.

    Columns ``ref_table, ref_key, target_key, orphan_kind, ref_month``, distinct. Null targets are
    no references. ``missing``: no row for the target; ``deleted``: its newest row is a tombstone;
    ``late``: its earliest live row is later than the reference (equal is not late). A reference
    without a time can be missing or deleted but not late and has a null month. A target whose
    live rows have no time is never late. Empty tables give no targets, so all references to
    them are missing.

    ``ranges`` is the number of key ranges, by default as many as keep ``RANGE_KEYS`` references and
    targets in one, and at least one per shuffle partition. References to one target in one month
    are spread over several tasks above ``heavy`` of them.
    """
    spark = content_entries.sparkSession
    contents = materialise(content_states(content_entries), "contents")
    refs, targets = _references(manifests, directories, contents), _targets(directories, packs, contents)
    refs = refs.withColumn("month", F.coalesce(_month(F.col("ref_time")), F.lit(NO_MONTH)))
    counts = materialise(refs.groupBy("space", "target_key", "month").agg(F.count(F.lit(1)).alias("n")), "references")
    hot = HotKeys(counts, ["space", "target_key", "month"], heavy=heavy)
    keys = contents.count() + counts.count()
    found = suspects(counts, targets, ranges or max(shuffle_partitions(spark), -(-keys // RANGE_KEYS)))
    of = found.join(targets, ["space", "target_key"], "left").select("space", "target_key", "month", "alive", "first", F.explode(hot.copies()).alias("salt"))
    rows = refs.withColumn("salt", hot.salt("ref_table", "ref_key")).join(of, ["space", "target_key", "month", "salt"])
    kind = F.when(F.col("alive").isNull(), "missing").when(~F.col("alive"), "deleted").when(F.col("first") > F.col("ref_time"), "late")
    out = rows.select("ref_table", "ref_key", "target_key", kind.alias("orphan_kind"), F.date_format("ref_time", "yyyy-MM").alias("ref_month"))
    return out.filter(F.col("orphan_kind").isNotNull()).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month and kind."""
    return orphans.groupBy("ref_table", "ref_month", "orphan_kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("target_key").alias("n_targets"))
