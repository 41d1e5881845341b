"""Last-writer-wins: the winning row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def winners(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key: the one whose ``order`` tuple is greatest.

    A single aggregation with map-side partial maxima, so a key with a third of all rows is
    reduced before the shuffle. Null order values rank lowest. Rows that tie on ``order`` are
    resolved by the kept columns, greatest first, so the result is deterministic; rows with a
    null key form a group of their own, drop them beforehand if they mean nothing. An empty
    table gives an empty result.
    """
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)])
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.k{i}").alias(k) for i, k in enumerate(keep)])


def state_rows(df: DataFrame, key: str, version: str, keep: Sequence[str]) -> DataFrame:
    """Newest row per ``key`` by ``version``, tombstones included as ``deleted``; null keys dropped.

    Maps cannot be compared, so ``keep`` must not hold any. At equal versions the live row wins.
    """
    src = df.filter(F.col(key).isNotNull()).select(key, version, F.coalesce("deleted", F.lit(False)).alias("deleted"), *[c for c in keep if c not in (key, version, "deleted")])
    return winners(src, [key], [F.col(version), ~F.col("deleted")], [version, "deleted", *[c for c in keep if c not in (key, version, "deleted")]])


def compacted_manifests(written: DataFrame, threshold: int = 16, name: str = "compacted") -> DataFrame:
    """Contents that hold the manifests (IX17): from ``threshold`` contents on the live newest
    manifests are in one content, named ``name``, and all others are gone; below, nothing changes.
    ``written`` has ``content, manifest_id, modified_at, deleted``."""
    rows = written.filter("content is not null and manifest_id is not null").withColumn("deleted", F.coalesce("deleted", F.lit(False))).distinct()
    if rows.select("content").distinct().limit(threshold).count() < threshold:
        return rows.select("content", "manifest_id", "modified_at", "deleted")
    return state_rows(rows, "manifest_id", "modified_at", []).filter("not deleted").select(F.lit(name).alias("content"), "manifest_id", "modified_at", "deleted")


def shadowed(committed: DataFrame, pending: DataFrame, key: str, version: str, keep: Sequence[str]) -> DataFrame:
    """Live rows when pending writes hide the committed ones of their key, older or not (FI02); of
    each side the newest row of a key counts."""
    top = state_rows(pending, key, version, keep)
    below = state_rows(committed, key, version, keep).join(top.select(key), key, "left_anti")
    return top.unionByName(below.select(top.columns)).filter("not deleted").drop("deleted")
