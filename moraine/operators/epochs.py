"""Epochs of the index: advance, compaction, ranges, cleanup."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.joins import as_of_join
from moraine.operators.ranking import running_within


def advancing(blobs: DataFrame, min_seconds: int, count: int, size: int) -> DataFrame:
    """Epochs that are due to end (WN14): long enough between first and last write, and enough
    blobs or bytes. Columns ``epoch, ts, blob_length``."""
    g = blobs.groupBy("epoch").agg((F.max("ts") - F.min("ts")).alias("span"), F.count(F.lit(1)).alias("n"), F.sum("blob_length").alias("bytes"))
    return g.filter((F.col("span") >= min_seconds) & ((F.col("n") >= count) | (F.col("bytes") >= size)))


def oldest_uncompacted(epochs: DataFrame, candidate: int) -> DataFrame:
    """First epoch from ``candidate`` on that isn't among the compacted ones, if ``candidate`` is;
    else ``candidate`` itself (WN15). The run of compacted epochs ends at its first gap."""
    e = epochs.filter(F.col("epoch") >= candidate).select("epoch").distinct()
    after = e.select((F.col("epoch") - 1).alias("epoch"), F.lit(1).alias("_n"))
    one = e.join(after, "epoch", "left").agg(F.min(F.when(F.col("_n").isNull(), F.col("epoch"))).alias("_end"), F.max((F.col("epoch") == candidate).cast("int")).alias("_has"))
    return one.select(F.when(F.col("_has") == 1, F.col("_end") + 1).otherwise(F.lit(candidate)).cast("bigint").alias("epoch"))


def next_at_or_after(df: DataFrame, at: str, others: DataFrame, other: str) -> DataFrame:
    """``at`` with the least ``other`` not below it, by one order over both sides instead of a join on
    an inequality; what has none is left out."""
    rows = df.select((-F.col(at)).alias("_o"), F.lit(1).alias("_s"), F.lit(None).cast("bigint").alias("_v")).unionByName(others.select((-F.col(other)).alias("_o"), F.lit(0).alias("_s"), F.col(other).cast("bigint").alias("_v")))
    run = running_within(rows.withColumn("_g", F.lit(0)), ["_g"], ["_o", "_s"], lasts={other: "_v"})
    return run.filter((F.col("_s") == 1) & F.col(other).isNotNull()).select((-F.col("_o")).alias(at), other)


def longest_chain(ranges: Iterable[tuple[int, int]], start: int = 0) -> list[tuple[int, int]]:
    """Contiguous ranges from ``start`` that reach furthest, of those the fewest (GR08, EP04)."""
    by_lo: dict[int, set[tuple[int, int]]] = {}
    for lo, hi in ranges:
        by_lo.setdefault(lo, set()).add((lo, hi))
    best: dict[int, tuple[int, int, tuple[int, int]]] = {}  # reach, ranges, first range
    for lo in sorted(by_lo, reverse=True):
        options = []
        for r in by_lo[lo]:
            end, n, _ = best.get(r[1] + 1, (r[1], 0, r))
            options.append((max(end, r[1]), -(n + 1), r))
        end, n, first = max(options)
        best[lo] = (end, -n, first)
    out, at = [], start
    while at in best and best[at][0] >= at:
        out.append(best[at][2])
        at = out[-1][1] + 1
    return out


def chain_of(ranges: DataFrame, start: int | None = None) -> DataFrame:
    """The longest chain (``lo, hi``) of range checkpoints from ``start``, by default the least ``lo``
    (GR08, EP04). All go through one task, in order: a store has one range per several epochs, two numbers
    each, far fewer than blobs. Ranges whose end lies before their start are no ranges."""
    r = ranges.filter("lo is not null and hi >= lo").select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).distinct()

    def run(batches):
        import pyarrow as pa

        every = [(a, b) for x in batches for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
        got = longest_chain(every, (min(every)[0] if every else 0) if start is None else start)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["lo", "hi"])

    return r.repartition(1).mapInArrow(run, "lo bigint, hi bigint")


def index_set(uncompacted: DataFrame, compacted: DataFrame, chain: DataFrame, write_epoch: int) -> DataFrame:
    """Blobs that make up the index (EP05): those of the range chain (``lo, hi``), then per later
    epoch its compacted blobs if it is settled (two behind the write epoch) and has any, else the
    others. A range of one epoch is that epoch's compaction."""
    covered = chain.agg(F.coalesce(F.max("hi"), F.lit(-1)).alias("_c"))
    behind = lambda df: df.join(F.broadcast(covered)).filter(F.col("epoch") > F.col("_c")).drop("_c")
    comp = behind(compacted.filter(F.col("epoch") <= write_epoch - 2))
    rest = behind(uncompacted).join(comp.select("epoch").distinct(), "epoch", "left_anti")
    held = chain.select(F.concat_ws("-", F.lit("range"), "lo", "hi").alias("blob_id"))
    return held.unionByName(comp.select("blob_id")).unionByName(rest.select("blob_id")).distinct()


def superseded(uncompacted: DataFrame, compacted: DataFrame, margin: int) -> DataFrame:
    """Uncompacted blobs that may go (EP07): their epoch has a compaction written at least
    ``margin`` seconds before the newest uncompacted blob. Columns ``epoch, blob_id, ts``."""
    newest = uncompacted.agg(F.max("ts")).first()[0]
    early = compacted.groupBy("epoch").agg(F.max("ts").alias("_t")).filter(F.col("_t") < F.lit((newest or 0) - margin)).select("epoch")
    return uncompacted.join(early, "epoch", "left_semi")


def safe_drop_time(runs: DataFrame, margin: int, extra: int) -> DataFrame:
    """Time before which tombstones may be dropped (WN11): of the successful runs, the start of the
    latest earlier one that ended more than ``margin`` before the last one's start, less ``extra``;
    null if there is none. Columns ``start, end, success`` in Unix seconds."""
    ok = runs.filter("success")
    last = ok.agg(F.max("start").alias("_l"))
    joined = ok.join(F.broadcast(last), F.col("start") < F.col("_l"), "inner")
    return joined.filter(F.col("_l") - F.col("end") > margin).agg((F.max("start") - extra).alias("drop_before"))


def markers(blobs: DataFrame) -> DataFrame:
    """Write epoch and when it began (EP01), from marker blobs ``epoch, ts``."""
    return blobs.agg(F.max("epoch").alias("write_epoch"), F.min_by("ts", -F.col("epoch")).alias("began"))


def judged_writes(writes: DataFrame, epochs: DataFrame) -> DataFrame:
    """What becomes of index writes (EP08): ``write_id, epoch, outcome``. A write belongs to the epoch
    that was current when it started; it is ``kept`` if that or the next one is current when it
    ends, else ``too slow``: its shards go, since that epoch may have been compacted without it.
    ``no epoch`` had begun for writes before the first. ``writes`` has ``write_id, started, ended``,
    ``epochs`` ``epoch, began``; both sides meet in order of time, not by a join on a range."""
    e = epochs.filter("epoch is not null and began is not null").groupBy(F.col("began").alias("at")).agg(F.max("epoch").alias("epoch")).withColumn("_g", F.lit(0))
    w = writes.select("write_id", F.lit(0).alias("_g"), F.col("started").alias("at"), "ended")
    first = _as_of(w, e, "_first")
    last = _as_of(first.select("write_id", "_g", "_first", F.col("ended").alias("at")), e, "_last")
    outcome = F.when(F.col("_first").isNull(), "no epoch").when(F.col("_last") >= F.col("_first") + 2, "too slow").otherwise("kept")
    return last.select("write_id", F.col("_first").alias("epoch"), outcome.alias("outcome"))


def _as_of(left: DataFrame, epochs: DataFrame, name: str) -> DataFrame:
    return as_of_join(left, epochs.withColumnRenamed("epoch", "_e"), "_g", "at", "_e").withColumnRenamed("_e", name)
