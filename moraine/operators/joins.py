"""Joins along an order, and names made distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.ranking import running_within
from moraine.session import materialise


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Last non-null ``value`` of ``right`` at or before each row of ``left``, per key (JN18):
    both sides in one order by time, right before left at equal times. Large keys run in slices."""
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    run = running_within(a.unionByName(b), [key], [at, "_side"], lasts={value: "_v"})
    return run.filter("_side = 1").drop("_v", "_side")


def disambiguated(df: DataFrame, name: str, safe: str) -> DataFrame:
    """Safe names made distinct regardless of case (SE07): of names that share one the first keeps
    it and the others get `` (2)``, `` (3)`` and so on, until all are distinct. Names are written after
    each round, so the lineage stays short."""
    rows = df
    while True:
        w = Window.partitionBy(F.lower(safe)).orderBy(name)
        k = F.row_number().over(w)
        rows = rows.withColumn("_k", k).withColumn(safe, F.when(F.col("_k") > 1, F.concat(F.col(safe), F.lit(" ("), F.col("_k"), F.lit(")"))).otherwise(F.col(safe))).drop("_k")
        rows = materialise(rows, "names")
        if rows.groupBy(F.lower(safe)).count().filter("count > 1").isEmpty():
            return rows
