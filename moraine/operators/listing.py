"""What a listing leaves out: ignore files of folders, other devices, cache folders, large files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions import wildcards as W

RULES = "tree string, folder string, place bigint, regex string, negated boolean, folders_only boolean"
# Name of the file that marks a cache folder, and how it begins.
CACHE_MARKER, CACHE_SIGNATURE = "CACHEDIR.TAG", "Signature: 8a477f597d28d172789f06886806bc55"


def folder_rules(lines: DataFrame) -> DataFrame:
    """Rules of ignore files (FI12): ``lines`` has ``tree, folder, place, line``; a line of a file is
    a row, or the whole file is one. Blank lines, comments and unreadable patterns give no rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for tree, folder, place, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for k, r in enumerate(W.parsed(text, folder or "")):
                    for c, v in zip(cols, (tree, folder or "", place * (1 << 20) + k, r.regex, r.negated, r.folders_only), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tree", "folder", "place", "regex", "negated", "folders_only"])

    return lines.select("tree", "folder", F.coalesce(F.col("place").cast("bigint"), F.lit(0)).alias("place"), "line").mapInArrow(run, RULES)


def _verdicts(nodes: DataFrame, rules: DataFrame, resets: DataFrame) -> DataFrame:
    """``tree, path, is_folder`` of the nodes that rules of the folders above them leave out, the
    pattern alone considered. ``resets`` are folders whose rules replace those from above."""
    above = F.array_union(F.array(F.lit("")), W.folders_above(F.col("path")))
    at = nodes.select("tree", "path", "is_folder", F.explode(above).alias("folder"))
    lists = rules.groupBy("tree", "folder").agg(F.array_sort(F.collect_list(F.struct("place", "regex", "negated", "folders_only"))).alias("_rules"))
    held = lists.join(resets.select("tree", "folder", F.lit(True).alias("_reset")).distinct(), ["tree", "folder"], "full_outer")
    got = at.join(held, ["tree", "folder"]).groupBy("tree", "path", "is_folder").agg(
        F.array_sort(F.collect_list(F.struct(F.length("folder").alias("depth"), F.coalesce("_reset", F.lit(False)).alias("reset"), F.coalesce("_rules", F.array()).alias("rules")))).alias("_l")
    )
    first = F.coalesce(F.array_max(F.transform(F.filter("_l", lambda x: x["reset"]), lambda x: x["depth"])), F.lit(0))
    inner = F.flatten(F.transform(F.filter("_l", lambda x: x["depth"] >= first), lambda x: x["rules"]))
    hit = lambda r: F.rlike(F.col("path"), r["regex"]) & (~r["folders_only"] | F.col("is_folder"))
    out = F.aggregate(inner, F.lit(False), lambda s, r: F.when((s == r["negated"]) & hit(r), ~s).otherwise(s))
    return got.filter(out).select("tree", "path", "is_folder")


def without_ignored(entries: DataFrame, rules: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Entries (``tree, path, is_folder`` and others; paths begin with ``/``) that ignore files of
    the folders above them don't leave out (FI10, FI11, FI12).

    The rules of a folder count for what lies below it, after those of the folders above; one in
    ``resets`` (``tree, folder``) doesn't take over any from above. What lies in a folder that is
    left out is left out too: every folder is judged once, and entries are anti-joined with the
    folders above them, so nothing is matched per pair of entry and foreign rule. Entries with a
    null tree or path are kept. The root folder is ``""``.
    """
    resets = entries.sparkSession.createDataFrame([], "tree string, folder string") if resets is None else resets
    keyed = entries.filter("tree is not null and path is not null")
    folders = keyed.select("tree", F.explode(W.folders_above(F.col("path"))).alias("path"), F.lit(True).alias("is_folder")).distinct()
    nodes = folders.unionByName(keyed.select("tree", "path", F.coalesce("is_folder", F.lit(False)).alias("is_folder"))).distinct()
    gone = _verdicts(nodes, rules, resets)
    own = gone.select(F.col("tree").alias("_t"), F.col("path").alias("_p"), F.col("is_folder").alias("_f"))
    left = keyed.join(own, (F.col("tree") == F.col("_t")) & (F.col("path") == F.col("_p")) & (F.coalesce("is_folder", F.lit(False)) == F.col("_f")), "left_anti")
    below = gone.filter("is_folder").select("tree", F.col("path").alias("_a"))
    lost = left.select("tree", "path", F.explode(W.folders_above(F.col("path"))).alias("_a")).join(below, ["tree", "_a"], "left_semi").select("tree", "path").distinct()
    rest = entries.filter("tree is null or path is null")
    return left.join(lost, ["tree", "path"], "left_anti").select(entries.columns).unionByName(rest)


def cache_folders(files: DataFrame) -> DataFrame:
    """``tree, folder`` of the folders with a valid marker file (FI11); ``files`` has ``tree, path,
    content``."""
    good = (F.element_at(F.split("path", "/"), -1) == CACHE_MARKER) & F.substring(F.col("content").cast("string"), 1, len(CACHE_SIGNATURE)).eqNullSafe(F.lit(CACHE_SIGNATURE))
    return files.filter(good).select("tree", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()


def without_below(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries that don't lie below any of ``folders`` (``tree, folder``; FI11): the folders
    themselves stay, as empty ones. Entries with a null tree or path are kept."""
    above = F.array_union(F.array(F.lit("")), W.folders_above(F.col("path")))
    lost = entries.select("tree", "path", F.explode(above).alias("folder")).join(folders.select("tree", "folder"), ["tree", "folder"], "left_semi").select("tree", "path").distinct()
    return entries.join(lost, ["tree", "path"], "left_anti").select(entries.columns)


def on_root_device(entries: DataFrame, roots: DataFrame, device: str = "device") -> DataFrame:
    """Entries on their tree's own device (FI11): a folder on another one is left out with all below
    it. ``roots`` has ``tree`` and the device as ``root_device``; without one nothing is left out."""
    r = roots.select("tree", "root_device").distinct()
    rows = entries.join(r, "tree", "left")
    other = F.coalesce(F.col(device) != F.col("root_device"), F.lit(False))
    mounts = rows.filter(other & F.coalesce("is_folder", F.lit(False))).select("tree", F.col("path").alias("folder"))
    return without_below(rows.filter(~other).select(entries.columns), mounts)


def within_size(entries: DataFrame, most: int, size: str = "file_size", folder: str = "is_folder") -> DataFrame:
    """Folders, and files up to a size (FI11); 0 is no bound, a file of unknown size stays."""
    return entries if most <= 0 else entries.filter(F.coalesce(folder, F.lit(False)) | (F.coalesce(size, F.lit(0)) <= most))


def combined_rules(parts: Sequence[DataFrame]) -> DataFrame:
    """Rules of several origins, such as policies and ignore files, one after the other."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("place", F.col("place") + F.lit(k * (1 << 50)))
        out = p if out is None else out.unionByName(p)
    return out
