"""The N highest rows of every group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.ranking import heavy_groups, null_safe, packed, sliced, unpacked

#: Groups above this many rows are cut into value ranges.
HEAVY = 10_000


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, *, name: str = "rank", heavy: int = HEAVY) -> DataFrame:
    """Rows of ``df`` with a ``rank`` of at most ``n`` in their group, by ``order`` descending.

    Exact counts part heavy groups from light ones. Light groups are ranked by a window. Heavy
    ones are salted by value range: each range is ranked by itself in parallel and keeps ``n``
    rows; the number of rows in the ranges above shifts its ranks; what is beyond ``n`` goes.

    Nulls in ``order`` come last, null group values form groups, rows equal in all of ``order``
    take neighbouring ranks in no defined sequence: end ``order`` with a unique column for a
    consistent tie rule. Empty tables and ``n`` below 1 give no rows. Other columns are kept as they are; one named
    ``name`` is replaced.
    """
    rows, g, o = packed(df, group, order)
    ordering = [F.col(c).desc_nulls_last() for c in o]

    def windowed(part: DataFrame, keys: Sequence[str], to: str) -> DataFrame:
        return part.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering))).filter(F.col(to) <= n)

    hot = heavy_groups(rows, g, heavy)
    light = windowed(null_safe(rows, hot.drop("_n"), g, "left_anti"), g, "_rank")
    salted = sliced(rows, hot, g, o, heavy)
    sizes = salted.groupBy(*g, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.partitionBy(*g).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(above), F.lit(0))).filter(F.col("_before") < n).drop("_c")
    best = null_safe(windowed(salted, [*g, "_slice"], "_local"), offsets, [*g, "_slice"], "inner")
    ranked = best.withColumn("_rank", (F.col("_local") + F.col("_before")).cast("int")).filter(F.col("_rank") <= n)
    return unpacked(light.unionByName(ranked.select(*light.columns)), "_rank", name, df.columns, "int")
