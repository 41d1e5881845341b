"""Snapshot manifests: retention, expiry, grouping, history, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.history import SOURCE
from moraine.operators.ranking import neighbour, null_safe, rank_within, running_within
from moraine.session import materialise

ORDER = ["start_time", "end_time", "manifest_id"]
#: Kinds of period in the order they are decided, and in the order of their tags.
KINDS = ["latest", "annual", "monthly", "weekly", "daily", "hourly"]
TAG_ORDER = ["latest", "hourly", "daily", "weekly", "monthly", "annual"]
#: Snapshots kept by default.
DEFAULTS = {"latest": 10, "hourly": 48, "daily": 7, "weekly": 4, "monthly": 24, "annual": 3}
#: Incomplete snapshots are kept below this age in hours, or up to this number.
INCOMPLETE_HOURS, INCOMPLETE_COUNT = 4, 3


def period_id(kind: str, t: Column) -> Column:
    if kind == "weekly":
        return F.when(t.isNotNull(), F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t)))
    return F.date_format(t, {"annual": "yyyy", "monthly": "yyyy-MM", "daily": "yyyy-MM-dd", "hourly": "yyyy-MM-dd HH"}[kind])


def _months_before(t: Column, n: int) -> Column:
    """Calendar months back where a day beyond the month's end runs over into the next month."""
    first = F.date_trunc("month", t).cast("timestamp_ntz")
    return first - F.make_ym_interval(F.lit(0), F.lit(n)) + (t - first)


def cutoff(kind: str, newest: Column, n: int) -> Column:
    if kind in ("annual", "monthly"):
        return _months_before(newest, n * (12 if kind == "annual" else 1))
    hours = n * {"weekly": 168, "daily": 24, "hourly": 1}[kind]
    return newest - F.make_dt_interval(F.lit(0), F.lit(hours))


def retention_reasons(snapshots: DataFrame, keep: dict[str, int | None]) -> DataFrame:
    """``manifest_id, reason``: why each snapshot is kept (WN01, WN02), one row per reason.

    ``keep`` gives the number kept per kind, None for not set; if nothing is kept all complete
    snapshots are, as latest. Per kind the newest complete snapshot of each period counts; periods
    are first reduced to that snapshot, then ranked, so a large source is aggregated before its
    ranks are taken. A weekly period with the id of a monthly one already kept is no period of its
    own. Incomplete snapshots are kept as long as, newest first, no complete one has come and
    each is young or among the first few. Null start times count as oldest and have no period.
    """
    rows = materialise(snapshots.select("manifest_id", *SOURCE, "start_time", "end_time", "complete"), "retention")
    order = F.struct("start_time", "end_time", "manifest_id")
    done = rows.filter("complete").withColumn("_o", order)
    limit = dict(keep)
    if not sum(v or 0 for v in limit.values()):
        limit["latest"] = -1  # no bound
    kinds = [k for k in KINDS if k != "latest" and limit.get(k) is not None]
    parts = [incomplete_kept(rows).select("manifest_id", F.lit("incomplete").alias("reason"))]
    if kinds:
        parts.append(_period_reasons(done, {k: limit[k] for k in kinds}))
    if limit.get("latest") is not None:
        if limit["latest"] < 0:
            ranked = rank_within(done, SOURCE, ORDER, descending=True, name="_k")
        else:
            ranked = done.withColumn("_k", F.row_number().over(Window.partitionBy(*SOURCE).orderBy(F.col("_o").desc()))).filter(F.col("_k") <= limit["latest"])
        parts.append(ranked.select("manifest_id", F.concat(F.lit("latest-"), F.col("_k").cast("string")).alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _period_reasons(done: DataFrame, limit: dict[str, int]) -> DataFrame:
    """Reasons of all kinds of period in one pass: the newest snapshot of each period by one
    aggregation, which leaves a source no more rows than the calendar has periods; then one
    shuffle by source for all ranks. A period's newest snapshot is within the cut-off if and only
    if any of the period is."""
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), period_id(k, F.col("start_time")).alias("p")) for k in limit])
    best = done.filter("start_time is not null").select(*SOURCE, "_o", F.explode(ids).alias("_x")).groupBy(*SOURCE, "_x.kind", "_x.p").agg(F.max("_o").alias("_o"))
    best = best.repartition(*SOURCE)
    newest = F.max("_o.start_time").over(Window.partitionBy(*SOURCE))
    within = F.coalesce(*[F.when(F.col("kind") == k, F.col("_o.start_time") >= cutoff(k, F.col("_mc"), n)) for k, n in limit.items()])
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in limit.items()])
    place = F.row_number().over(Window.partitionBy(*SOURCE, "kind").orderBy(F.col("_o").desc()))
    kept = best.withColumn("_mc", newest).filter(within).withColumns({"_k": place, "_n": most}).filter((F.col("_k") <= F.col("_n")) | (F.col("kind") == "weekly"))
    if "weekly" in limit and "monthly" in limit:
        taken = F.max(F.col("kind") == "monthly").over(Window.partitionBy(*SOURCE, "p"))
        kept = kept.withColumn("_t", taken).filter((F.col("kind") != "weekly") | ~F.col("_t"))
        kept = kept.withColumn("_k", place)
    kept = kept.filter(F.col("_k") <= F.col("_n"))
    return kept.select(F.col("_o.manifest_id").alias("manifest_id"), F.concat_ws("-", "kind", F.col("_k").cast("string")).alias("reason"))


def incomplete_kept(rows: DataFrame) -> DataFrame:
    """Incomplete snapshots newer than every complete one that are young or among the first few,
    up to the first that is neither (WN02)."""
    best = rows.groupBy(*SOURCE).agg(F.max(F.when(F.col("complete"), F.struct("start_time", "end_time", "manifest_id"))).alias("_bc"), F.max("start_time").alias("_m"))
    lead = null_safe(rows.filter("not complete"), best, SOURCE, "left").filter(F.col("_bc").isNull() | (F.struct("start_time", "end_time", "manifest_id") > F.col("_bc")))
    placed = rank_within(lead, SOURCE, ORDER, descending=True, name="_i")
    young = F.col("start_time") > F.col("_m") - F.make_dt_interval(F.lit(0), F.lit(INCOMPLETE_HOURS))
    # Age only grows and the place only rises along the order: the first failure ends the run.
    return placed.filter(F.coalesce(young, F.lit(False)) | (F.col("_i") <= INCOMPLETE_COUNT))


def expired(snapshots: DataFrame, reasons: DataFrame) -> DataFrame:
    """Snapshots without a reason to keep them and without pins (WN03)."""
    return snapshots.join(reasons.select("manifest_id").distinct(), "manifest_id", "left_anti").filter(F.coalesce(F.size("pins"), F.lit(0)) <= 0)


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the id of the one before it in its source (WN04)."""
    return neighbour(snapshots, SOURCE, ORDER, {"previous_id": "manifest_id"}).drop("_place")


def deltas(snapshots: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Change of columns against the snapshot before (AG21); null for a source's first."""
    rows = neighbour(snapshots, SOURCE, ORDER, {f"_p_{n}": c for n, c in columns.items()})
    return rows.select("manifest_id", *[(F.col(c) - F.col(f"_p_{n}")).alias(n) for n, c in columns.items()])


def delta_to_complete(snapshots: DataFrame, column: str) -> DataFrame:
    """Change of a column against the last complete snapshot before (WN08)."""
    rows = snapshots.withColumn("_done", F.when(F.col("complete"), F.col(column)))
    run = running_within(rows, SOURCE, ORDER, lasts={"_last": "_done"}, before=True)
    return run.select("manifest_id", (F.col(column) - F.col("_last")).alias("delta"))


def previous_manifests(snapshots: DataFrame, no_later_than: Column | None = None) -> DataFrame:
    """Per source the latest complete snapshot and all incomplete ones started after it (WN06)."""
    rows = snapshots if no_later_than is None else snapshots.filter(F.col("start_time") <= no_later_than)
    best = rows.filter("complete").groupBy(*SOURCE).agg(F.max(F.struct("start_time", "end_time", "manifest_id")).alias("_b"))
    done = best.select(F.col("_b.manifest_id").alias("manifest_id"))
    rest = null_safe(rows.filter("not complete"), best, SOURCE, "left").filter(F.col("_b").isNull() | (F.col("start_time") > F.col("_b.start_time")))
    return done.unionByName(rest.select("manifest_id"))


def identical_runs(snapshots: DataFrame) -> DataFrame:
    """Adjacent snapshots of a source with one root as a single row (AG16): first and last start,
    count, and all pins. A run begins where the root differs from the one before; the number of
    begins so far names it. Large sources are walked in slices. Pins are made distinct before they
    are gathered."""
    rows = snapshots.select("manifest_id", *SOURCE, "start_time", "end_time", "root_oid", "pins", F.struct("root_oid").alias("_root"))
    seen = running_within(rows, SOURCE, ORDER, lasts={"_before": "_root"}, before=True)
    marked = materialise(seen.select("*", (F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_root"))).cast("int").alias("_new")).drop("_root", "_before"), "runs")
    run = materialise(running_within(marked, SOURCE, ORDER, sums={"_run": "_new"}), "runs")
    at = F.struct("start_time", "end_time", "manifest_id")
    sizes = run.groupBy(*SOURCE, "_run", "root_oid").agg(F.min(at)["start_time"].alias("first_start"), F.max(at)["start_time"].alias("last_start"), F.count(F.lit(1)).alias("n"))
    pins = run.select(*SOURCE, "_run", F.explode("pins").alias("_p")).distinct().groupBy(*SOURCE, "_run").agg(F.array_sort(F.collect_list("_p")).alias("pins"))
    both = null_safe(sizes, pins, [*SOURCE, "_run"], "left")
    return both.select(*SOURCE, "root_oid", "first_start", "last_start", "n", F.coalesce("pins", F.array().cast("array<string>")).alias("pins"))


def unique_roots(snapshots: DataFrame) -> DataFrame:
    """One row per root, the first snapshot and all pins (AG17). Pins are made distinct before they
    are gathered."""
    first = snapshots.groupBy("root_oid").agg(F.min(F.struct("start_time", "end_time", "manifest_id")).alias("_f"), F.count(F.lit(1)).alias("n"))
    pins = snapshots.select("root_oid", F.explode("pins").alias("_p")).distinct().groupBy("root_oid").agg(F.array_sort(F.collect_list("_p")).alias("pins"))
    both = null_safe(first, pins, ["root_oid"], "left")
    return both.select("root_oid", F.col("_f.manifest_id").alias("manifest_id"), "n", F.coalesce("pins", F.array().cast("array<string>")).alias("pins"))


def compact_tags(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """Runs of consecutive numbers of one prefix as ``prefix-a..b`` (AG18); other tags stay."""
    t = F.col(tag)
    n = F.expr(f"try_cast(regexp_extract({tag}, '^.*-([^-]*)$', 1) as bigint)")
    cols = rows.select(key, t.alias("_t"), F.regexp_extract(t, "^(.*)-[^-]*$", 1).alias("_p"), n.alias("_n"))
    other = cols.filter("_n is null").select(key, F.col("_t").alias("tag"))
    w = Window.partitionBy(key, "_p").orderBy("_n")
    runs = cols.filter("_n is not null").select(key, "_p", "_n").distinct().withColumn("_r", F.col("_n") - F.row_number().over(w)).groupBy(key, "_p", "_r").agg(F.min("_n").alias("a"), F.max("_n").alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.concat_ws("-", "_p", "a")).otherwise(F.concat(F.col("_p"), F.lit("-"), F.col("a"), F.lit(".."), F.col("b")))
    return runs.select(key, name.alias("tag")).unionByName(other)


def compact_pins(pins: Column) -> Column:
    """Distinct pins in order (AG19)."""
    return F.array_sort(F.array_distinct(pins))


def updated_pins(pins: Column, add: list[str], remove: list[str]) -> Column:
    """Pins with some added and some removed (AG19, MS12)."""
    have = F.coalesce(pins, F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array_union(have, F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>")))


def status_code() -> Column:
    """Status of a snapshot (AG20)."""
    return F.when(~F.col("complete"), "incomplete").when(F.col("error_count") > 0, "fatal").when(F.col("ignored_error_count") > 0, "warnings").otherwise("success")


def overall_status(rows: DataFrame, group: list[str]) -> DataFrame:
    """Worst status per group; incomplete snapshots don't count (AG20)."""
    s = rows.withColumn("_s", status_code())
    code = F.when(F.max(F.when(F.col("_s") == "fatal", 1)) == 1, "fatal").when(F.max(F.when(F.col("_s") == "warnings", 1)) == 1, "warnings").otherwise("success")
    return s.groupBy(*group).agg(code.alias("status"), F.count(F.lit(1)).alias("n"))


def copy_candidates(snapshots: DataFrame, rename: dict[str, Column]) -> DataFrame:
    """Copying history to changed sources (JN10): each snapshot with the source it would get and
    what happens: ``same source``, ``duplicate`` (one with that source, start and root exists) or
    ``copy``."""
    to = {c: rename.get(c, F.col(c)) for c in SOURCE}
    keys = [*SOURCE, "start_time", "root_oid"]
    moved = snapshots.select("manifest_id", *[F.col(c).alias(f"_from_{c}") for c in SOURCE], *[to[c].alias(c) for c in SOURCE], "start_time", "root_oid")
    have = snapshots.select(*keys).distinct().withColumn("_have", F.lit(True))
    out = null_safe(moved, have, keys, "left")
    same = F.lit(True)
    for c in SOURCE:
        same &= F.col(c).eqNullSafe(F.col(f"_from_{c}"))
    return out.select("manifest_id", *SOURCE, F.when(same, "same source").when(F.col("_have"), "duplicate").otherwise("copy").alias("action"))


def history_since_complete(snapshots: DataFrame) -> DataFrame:
    """Per source the latest complete snapshot and the ids of all incomplete ones since, oldest first
    (JN16); a source that never had a complete one lists all."""
    best = snapshots.groupBy(*SOURCE).agg(F.max(F.when(F.col("complete"), F.struct(*ORDER))).alias("_b"), F.max("start_time").alias("last_start"))
    rest = null_safe(snapshots.filter("not complete"), best.drop("last_start"), SOURCE, "inner").filter(F.col("_b").isNull() | (F.struct(*ORDER) > F.col("_b")))
    ids = rest.groupBy(*SOURCE).agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER))), lambda x: x["manifest_id"]).alias("since"))
    out = null_safe(best, ids, SOURCE, "left")
    return out.select(*SOURCE, F.col("_b.manifest_id").alias("complete_id"), "last_start", F.coalesce("since", F.array().cast("array<string>")).alias("since"))


def resolved_roots(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Root object of each ``asked`` id (GR03): that of the snapshot with this id, else the id itself
    if it is a snapshot's root. ``consistent`` tells if all snapshots of a root agree on the size of
    what they hold; an id that is neither gives no row."""
    roots = snapshots.filter("root_oid is not null").groupBy("root_oid").agg((F.min("total_size").eqNullSafe(F.max("total_size"))).alias("consistent"), F.count(F.lit(1)).alias("n"))
    ids = asked.select("asked").filter("asked is not null").distinct()
    by_id = ids.join(snapshots.select(F.col("manifest_id").alias("asked"), "root_oid"), "asked", "left").withColumn("root_oid", F.coalesce("root_oid", "asked"))
    return by_id.join(roots, "root_oid").select("asked", "root_oid", "consistent", "n")


def reasons_by_root(snapshots: DataFrame, reasons: DataFrame) -> DataFrame:
    """``root_oid, first_id, n, reasons``: snapshots of one root as one row (AG17), the first of them
    and all reasons to keep any of them, each once and in order. Reasons are made distinct before
    they are gathered; a root whose snapshots have none has an empty list."""
    first = snapshots.groupBy("root_oid").agg(F.min(F.struct(*ORDER))["manifest_id"].alias("first_id"), F.count(F.lit(1)).alias("n"))
    had = snapshots.select("manifest_id", "root_oid").join(reasons.select("manifest_id", "reason"), "manifest_id").select("root_oid", "reason").distinct()
    lists = had.groupBy("root_oid").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    return null_safe(first, lists, ["root_oid"], "left").select("root_oid", "first_id", "n", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
