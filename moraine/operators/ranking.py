"""Exact ranks within groups of any size.

A plain window puts a whole group into one task. Here the groups are counted first; groups above
``heavy`` rows are cut into value ranges ("slices") of about that size, ranked slice by slice in
parallel, and shifted by the number of rows in the slices before. Light groups use one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task ranks.
HEAVY = 200_000
#: Most slices of one group; beyond it slices grow instead.
MAX_SLICES = 2_048
#: Sampled keys per slice that the slice bounds are taken from. They set only where slices end.
PER_SLICE = 32


def heavy_groups(df: DataFrame, group: Sequence[str], heavy: int) -> DataFrame:
    """``group`` columns and ``_n`` of the groups above ``heavy`` rows (exact counts)."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which two nulls are equal; keeps the left key columns."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def sliced(df: DataFrame, hot: DataFrame, group: Sequence[str], order: Sequence[str], heavy: int) -> DataFrame:
    """Rows of the groups in ``hot`` with ``_n`` and the ascending slice number ``_slice``.

    The slice of a row depends only on its values: bounds are order tuples of rows whose hash
    falls below a rate, so a recomputed task assigns the same slices.
    """
    key = F.struct(*order)
    rows = null_safe(df, hot, group, "inner").withColumn("_key", key)
    width = F.greatest(F.lit(heavy), F.ceil(F.col("_n") / MAX_SLICES)).cast("bigint")
    rate = F.greatest(F.lit(1), (width / PER_SLICE).cast("bigint"))
    sample = rows.filter(F.pmod(F.xxhash64(*order), rate) == 0).groupBy(*group).agg(F.array_sort(F.collect_set("_key")).alias("_s"), F.max(F.ceil(F.col("_n") / width)).alias("_slices"))
    bounds = sample.select(*group, F.expr("transform(sequence(1, greatest(int(_slices) - 1, 1)), i -> get(_s, int(i * size(_s) / _slices)))").alias("_bounds"))
    return null_safe(rows, bounds, group, "left").withColumn("_slice", F.coalesce(_bounds_up_to(F.col("_bounds"), F.col("_key")), F.lit(0))).drop("_bounds")


def _bounds_up_to(bounds: Column, key: Column) -> Column:
    """Number of ascending bounds not above a key, by halving: 11 comparisons for 2,047 bounds."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((MAX_SLICES - 1).bit_length()))])
    up = lambda at, step: F.when((at + step <= F.size(bounds)) & F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(True)), at + step).otherwise(at)
    return F.when(bounds.isNotNull(), F.aggregate(steps, F.lit(0), up))


def packed(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The rows as one struct ``_row`` beside copies of the group and order columns, under names
    that no column of ``df`` can clash with."""
    g, o = [f"_g{i}" for i in range(len(group))], [f"_o{i}" for i in range(len(order))]
    cols = [*(F.col(f"`{c}`").alias(n) for c, n in zip(group, g, strict=True)), *(F.col(f"`{c}`").alias(n) for c, n in zip(order, o, strict=True))]
    return df.select(*cols, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")), g, o


def unpacked(df: DataFrame, rank: str, name: str, columns: Sequence[str], kind: str) -> DataFrame:
    """The rows again, with the rank as ``name``; a column of that name gives way."""
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c != name], F.col(rank).cast(kind).alias(name))


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str], *, descending: bool = False, name: str = "rank", heavy: int = HEAVY) -> DataFrame:
    """``df`` with its 1-based place in its group by ``order`` (all ascending, nulls first, or all
    descending, nulls last).

    Null group values are values. Rows equal in ``order`` get distinct, arbitrary neighbouring
    ranks, so end ``order`` with a key where that matters. Empty tables stay empty. A column named
    ``name`` is replaced.
    """
    rows, g, o = packed(df, group, order)
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in o]
    hot = heavy_groups(rows, g, heavy)
    if hot.isEmpty():
        return unpacked(rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*g).orderBy(*ordering))), "_rank", name, df.columns, "bigint")
    cold = null_safe(rows, hot.drop("_n"), g, "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy(*g).orderBy(*ordering)).cast("bigint"))
    parts = sliced(rows, hot, g, o, heavy)
    sizes = parts.groupBy(*g, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*g).orderBy(F.col("_slice").desc() if descending else F.col("_slice").asc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy(*g, "_slice").orderBy(*ordering)))
    ranked = null_safe(local, offsets, [*g, "_slice"], "inner").withColumn("_rank", (F.col("_local") + F.col("_before")).cast("bigint"))
    return unpacked(cold.unionByName(ranked.select(*cold.columns)), "_rank", name, df.columns, "bigint")


def running_within(df: DataFrame, group: Sequence[str], order: Sequence[str], *, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, before: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Running sums and last non-null values of each group along ``order``, ascending.

    ``sums`` and ``lasts`` map new columns to the columns they follow; with ``before`` the row
    itself is left out. Groups above ``heavy`` rows are cut into value ranges as in
    ``rank_within``: each range runs by itself and starts from what the ranges before it leave.
    A sum over nothing is 0, a last value of nothing null. End ``order`` with a key: rows equal in
    it follow each other in no defined sequence. New columns replace columns of their name.
    """
    sums, lasts = sums or {}, lasts or {}
    rows, g, o = packed(df, group, order)
    values = {**{n: f"_s{i}" for i, n in enumerate(sums)}, **{n: f"_l{i}" for i, n in enumerate(lasts)}}
    rows = rows.select("*", *[F.col(f"_row.`{c}`").alias(values[n]) for n, c in [*sums.items(), *lasts.items()]])
    end = -1 if before else 0

    def along(part: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, end)
        new = {f"_r{values[n]}": F.coalesce(F.sum(values[n]).over(w), F.lit(0)) for n in sums}
        return part.withColumns(new | {f"_r{values[n]}": F.last(values[n], ignorenulls=True).over(w) for n in lasts})

    def finished(part: DataFrame) -> DataFrame:
        kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in values]
        return part.select(*kept, *[F.col(f"_r{v}").alias(n) for n, v in values.items()])

    hot = heavy_groups(rows, g, heavy)
    if hot.isEmpty():
        return finished(along(rows, g))
    cold = along(null_safe(rows, hot.drop("_n"), g, "left_anti"), g)
    parts = sliced(rows, hot, g, o, heavy)
    key = F.struct(*o)
    left = parts.groupBy(*g, "_slice").agg(*[F.sum(values[n]).alias(values[n]) for n in sums], *[F.max(F.when(F.col(values[n]).isNotNull(), F.struct(key.alias("k"), F.col(values[n]).alias("v"))))["v"].alias(values[n]) for n in lasts])
    w = Window.partitionBy(*g).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select(*g, "_slice", *[F.coalesce(F.sum(values[n]).over(w), F.lit(0)).alias(f"_c{values[n]}") for n in sums], *[F.last(values[n], ignorenulls=True).over(w).alias(f"_c{values[n]}") for n in lasts])
    run = null_safe(along(parts, [*g, "_slice"]), carried, [*g, "_slice"], "inner")
    run = run.withColumns({f"_r{values[n]}": F.col(f"_r{values[n]}") + F.col(f"_c{values[n]}") for n in sums} | {f"_r{values[n]}": F.coalesce(f"_r{values[n]}", f"_c{values[n]}") for n in lasts})
    return finished(cold).unionByName(finished(run))


def neighbour(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: dict[str, str], *, ahead: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Values of the row before (or after) each row in its group, by exact rank and an equi-join
    on it, so that no group has to fit into one task. ``columns`` maps new names to columns; a
    first (or last) row gets nulls. Adds ``_place``, the row's rank."""
    ranked = rank_within(df, group, order, name="_place", heavy=heavy)
    other = ranked.select(*group, (F.col("_place") + (-1 if ahead else 1)).alias("_place"), *[F.col(c).alias(n) for n, c in columns.items()])
    return null_safe(ranked, other, [*group, "_place"], "left")


#: Bits of the field that marks hot keys, and parts that the rows of one are spread over.
HOT_BITS, SALTS = 1 << 16, 32


class HotKeys:
    """Salts for a join in which some keys have very many rows on one side.

    ``counts`` has the rows of each key as ``n``; keys above ``heavy`` are marked in a field of
    ``HOT_BITS`` bits by their hash, which is all that reaches the driver. A key whose bit is set by
    another is salted without need, which changes no row.
    """

    def __init__(self, counts: DataFrame, keys: Sequence[str], n: str = "n", heavy: int = HEAVY):
        self.keys = list(keys)
        bit = F.pmod(F.xxhash64(*keys), F.lit(HOT_BITS))
        rows = counts.filter(F.col(n) > heavy).groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}), {HOT_BITS}) & 63 as int))")).alias("v")).collect()
        self.words = {r.w: r.v for r in rows}

    def _hot(self) -> Column:
        if not self.words:
            return F.lit(False)
        bit = F.pmod(F.xxhash64(*self.keys), F.lit(HOT_BITS))
        field = F.array(*[F.lit(self.words.get(i, 0)).cast("bigint") for i in range(HOT_BITS >> 6)])
        return F.get(field, F.shiftright(bit, 6).cast("int")).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(self.keys)}), {HOT_BITS}) & 63 as int))")) != 0

    def salt(self, *by: str) -> Column:
        """Salt of a row on the side with many rows, by columns that differ among them."""
        return F.when(self._hot(), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")

    def copies(self) -> Column:
        """Salts of a row on the other side: all for a hot key, to be exploded."""
        return F.when(self._hot(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
