"""Counters, distributions and time series of intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.scalars import bucket, next_period, period_start
from moraine.operators.ranking import null_safe


def pieces(df: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """Each interval cut at the bounds of hours, days, weeks, months, quarters or years (MT06):
    one row per period it overlaps with ``point`` and the ``ratio`` of its seconds. Intervals that
    are empty or have a null end give none."""
    s, e = F.col(start), F.col(end)
    step = {"hour": "interval 1 hour", "day": "interval 1 day", "sunday": "interval 7 days", "monday": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
    rows = df.filter(s < e).withColumn("point", F.explode(F.sequence(period_start(s, unit), period_start(e, unit), F.expr(step))))
    rows = rows.filter(F.col("point") < e)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    lo, hi = F.greatest(F.col("point"), s), F.least(next_period(F.col("point"), unit), e)
    return rows.withColumn("ratio", (us(hi) - us(lo)) / 1e6 / ((us(e) - us(s)) / 1e6))


def counter_series(df: DataFrame, group: Sequence[str], start: str, end: str, value: str, unit: str = "day") -> DataFrame:
    """Counters spread over time in proportion to overlap (MT06), every piece cut to a whole number
    before it is added (MT07)."""
    part = F.col(value) * F.col("ratio")
    whole = F.when(part < 0, F.ceil(part)).otherwise(F.floor(part)).cast("bigint")
    return pieces(df, start, end, unit).groupBy(*group, "point").agg(F.sum(whole).alias("value"))


def distribution_series(df: DataFrame, group: Sequence[str], start: str, end: str, value: str, thresholds: Sequence[int], unit: str = "day") -> DataFrame:
    """Distributions spread over time (MT08): bucket counts are scaled by the overlap, while sum,
    count, least and greatest are added unscaled to every period touched."""
    b = pieces(df, start, end, unit).withColumn("bucket", bucket(F.col(value), thresholds))
    return b.groupBy(*group, "point", "bucket").agg(F.sum(F.floor(F.col("ratio")).cast("bigint")).alias("scaled"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def spread_distributions(df: DataFrame, group: Sequence[str], start: str, end: str, unit: str = "day") -> DataFrame:
    """Distributions spread over time (MT08): of every interval's ``buckets`` each period gets the
    overlap's share, cut to whole numbers; ``total, n, least, most`` are added unscaled to every
    period touched. ``buckets`` of one group are of one length."""
    cut = pieces(df, start, end, unit)
    flat = cut.select(*group, "point", F.posexplode(F.transform("buckets", lambda c: F.floor(c * F.col("ratio")).cast("bigint"))).alias("_i", "_c")).groupBy(*group, "point", "_i").agg(F.sum("_c").alias("_c"))
    counts = flat.groupBy(*group, "point").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda x: x["_c"]).alias("buckets"))
    sums = cut.groupBy(*group, "point").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return null_safe(sums, counts, [*group, "point"], "inner")


def distribution(df: DataFrame, group: Sequence[str], value: str, thresholds: Sequence[int]) -> DataFrame:
    """Least, greatest, sum, count and bucket counts (MT02). Buckets are counted by partial
    aggregation, one column each."""
    b = bucket(F.col(value), thresholds)
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"), b.alias("_b"))
    counts = [F.count(F.when(F.col("_b") == i, 1)).alias(f"_c{i}") for i in range(len(thresholds) + 1)]
    out = rows.groupBy(*group).agg(F.min("_v").alias("least"), F.max("_v").alias("most"), F.sum("_v").alias("total"), F.count(F.lit(1)).alias("n"), *counts)
    return out.withColumn("buckets", F.array(*[f"_c{i}" for i in range(len(thresholds) + 1)])).drop(*[f"_c{i}" for i in range(len(thresholds) + 1)])


def merged_distributions(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distributions of one kind merged (MT03): bucket counts are added place by place."""
    flat = parts.select(*group, "least", "most", "total", "n", F.posexplode("buckets").alias("_i", "_c"))
    per = flat.groupBy(*group, "_i").agg(F.sum("_c").alias("_c"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return per.groupBy(*group).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("total").alias("total"), F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda x: x["_c"]).alias("buckets"))


def throughput(df: DataFrame, group: Sequence[str], size: str, nanos: str) -> DataFrame:
    """Bytes and time of each group (MT05)."""
    return df.groupBy(*group).agg(F.sum(size).alias("bytes"), F.sum(nanos).alias("nanos"))
