"""Applying a change feed to a bucketed table by copy-on-write.

Layout below the table's path::

    manifest/<version>.json       bucket -> folder, one immutable file per commit
    data/<commit>/_b=<bucket>/    rows of one bucket, never rewritten in place

The base is hashed by key into a fixed number of buckets. A feed is reduced to one winning row
per key, routed to buckets, and merged by a sort-merge join with those buckets only; their
replacement files are written beside the old ones and a new manifest is committed. Readers see
either the old or the new version. Tombstones stay in the table, so an older write that arrives
in a later feed cannot revive its key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moraine.operators.state import winners
from moraine.session import shuffle_partitions


class BucketedTable:
    """A keyed table with versions. ``order`` decides which of two rows of a key wins, greatest
    first, nulls lowest; ``payload`` are the other columns kept."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str], payload: Sequence[str] = (), buckets: int | None = None):
        self.spark, self.path, self.key, self.order, self.payload = spark, path, key, list(order), list(payload)
        found = self._manifest()
        self.buckets = found["buckets"] if found else (buckets or shuffle_partitions(spark))

    # -- manifests -------------------------------------------------------------------------
    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self) -> list[int]:
        fs, jvm = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        rows = self.spark.read.text(f"{self.path}/manifest/{(version or known[-1]):08d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _commit(self, version: int, content: dict) -> None:
        """Write the manifest aside, then rename it without overwriting: where the file system
        renames atomically only one of two writers gets a version, the other an error."""
        fs, jvm = self._fs()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{version:08d}.json")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/_{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, how)
        except Exception as e:
            fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer") from e

    def _delete(self, *folders: str) -> None:
        fs, jvm = self._fs()
        for f in folders:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}"), True)

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the last ``keep`` versions, and the buckets' folders only dropped ones refer to.
        Folders of a commit under way belong to no version and stay."""
        known = self.versions()
        drop, stay = known[: -max(keep, 1)], known[-max(keep, 1) :]
        folders = lambda vs: {f"{f}/_b={b}" for v in vs for b, f in self._manifest(v)["folders"].items()}
        unused = folders(drop) - folders(stay)
        self._delete(*[f"manifest/{v:08d}.json" for v in drop], *sorted(unused))

    # -- rows ------------------------------------------------------------------------------
    def _bucket(self):
        """The bucket is the shuffle's own hash of the key: with as many buckets as shuffle
        partitions, rows that were reduced or joined by key lie in their bucket's partition."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets)).cast("int")

    def _columns(self) -> list[str]:
        return [self.key, *self.order, *self.payload]

    def _reduced(self, feed: DataFrame) -> DataFrame:
        rows = feed.select(*self._columns()).filter(F.col(self.key).isNotNull())
        keep = [*self.order, *self.payload]
        return winners(rows, [self.key], [F.col(c) for c in self.order], keep).select(self._bucket().alias("_b"), *self._columns())

    def _write(self, df: DataFrame, folder: str) -> set[int]:
        """Rows by bucket; gives the buckets that got files. ``df`` comes from a shuffle by key;
        only a table with another number of buckets has to be shuffled again."""
        if self.buckets != shuffle_partitions(self.spark):
            df = df.repartition(self.buckets, self.key)
        df.sortWithinPartitions("_b", self.key).write.partitionBy("_b").parquet(folder)
        fs, jvm = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))]
        return {int(n[3:]) for n in names if n.startswith("_b=")}

    def _read(self, folders: dict[int, str], schema) -> DataFrame:
        by_root: dict[str, list[str]] = {}
        for b, root in sorted(folders.items()):
            by_root.setdefault(root, []).append(f"{self.path}/{root}/_b={b}")
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.path}/{root}").parquet(*paths) for root, paths in by_root.items()]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    def apply(self, feed: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Merge ``feed`` (any order, repeats allowed, null keys ignored); gives the new version.

        ``batch`` names a stream and its batch: one that a version already holds is not applied
        again, so a repeated micro-batch changes nothing.

        On an empty table the reduced feed is the base. Otherwise it is staged, and only buckets
        it touches are read, merged and replaced; a feed without usable rows commits an unchanged
        version. A commit that fails leaves no files.
        """
        known = self.versions()
        old = self._manifest() if known else {"buckets": self.buckets, "folders": {}, "schema": None}
        batches = dict(old.get("batches", {}))
        if batch:
            if batches.get(batch[0], -1) >= batch[1]:
                return known[-1]
            batches[batch[0]] = batch[1]
        folders = {int(b): f for b, f in old["folders"].items()}
        version, own = (known[-1] if known else 0) + 1, uuid.uuid4().hex
        commit, staged = f"data/{own}", f"stage/{own}"
        reduced = self._reduced(feed)
        try:
            if not folders:
                written = self._write(reduced, f"{self.path}/{commit}")
            else:
                touched = self._write(reduced, f"{self.path}/{staged}")
                meets = {b: f for b, f in folders.items() if b in touched}
                written = set()
                if touched:
                    delta = self._read({b: staged for b in touched}, reduced.schema)
                    merged = self._merge(self._read(meets, reduced.schema), delta) if meets else delta
                    written = self._write(merged, f"{self.path}/{commit}")
            content = {"buckets": self.buckets, "folders": {**{str(b): f for b, f in folders.items()}, **{str(b): commit for b in written}}, "schema": reduced.schema.json(), "batches": batches}
            self._commit(version, content)
        except Exception:
            self._delete(commit)
            raise
        finally:
            self._delete(staged)
        return version

    def apply_deliveries(self, feed: DataFrame, arrival: str, shares: Sequence[float] = (0.5, 0.75)) -> int:
        """Apply ``feed`` as it was delivered: the rows that arrived up to the first of ``shares``
        (quantiles of ``arrival``) as the first delivery, those up to the next one after it, and so
        on. Rows without a time of arrival belong to the first."""
        cuts = feed.agg(F.percentile_approx(arrival, list(shares), 1_000)).first()[0] or []
        bounds = [None, *sorted(set(cuts)), None]
        version = 0
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = feed
            if hi is not None:
                part = part.filter((F.col(arrival) <= F.lit(hi)) if lo is not None else F.coalesce(F.col(arrival) <= F.lit(hi), F.lit(True)))
            if lo is not None:
                part = part.filter(F.col(arrival) > F.lit(lo))
            version = self.apply(part)
        return version

    def _merge(self, base: DataFrame, delta: DataFrame) -> DataFrame:
        cols = [*self.order, *self.payload]
        a = base.select("_b", self.key, F.struct(*cols).alias("_old"))
        b = delta.select(self.key, F.struct(*cols).alias("_new"))
        both = a.drop("_b").hint("merge").join(b, self.key, "full_outer").withColumn("_b", self._bucket())
        first = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in self.order])
        win = F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).when(first("_new") > first("_old"), F.col("_new")).otherwise(F.col("_old"))
        return both.select("_b", self.key, win.alias("_w")).select("_b", self.key, *[F.col(f"_w.{c}").alias(c) for c in cols])

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the last one by default), tombstones included."""
        found = self._manifest(version)
        if not found or not found["schema"]:
            raise ValueError(f"no version in {self.path}")
        schema = StructType.fromJson(json.loads(found["schema"]))
        if not found["folders"]:
            return self.spark.createDataFrame([], schema).drop("_b")
        return self._read({int(b): f for b, f in found["folders"].items()}, schema).drop("_b")


#: The winner of a content id: highest time, then not deleted, then greatest pack.
CONTENT_ORDER = ["timestamp_seconds", "live", "pack_blob_id"]


def content_feed(entries: DataFrame) -> DataFrame:
    """Usable rows of the content feed with ``live``; rows without id or time are dropped and a
    null ``deleted`` counts as not deleted."""
    usable = entries.filter(F.col("content_id").isNotNull() & F.col("timestamp_seconds").isNotNull())
    return usable.withColumn("live", ~F.coalesce("deleted", F.lit(False)))


def alive_contents(table: BucketedTable) -> DataFrame:
    return table.read().filter("live").select("content_id", "pack_blob_id")
