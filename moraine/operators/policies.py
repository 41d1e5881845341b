"""Policies: hierarchy, effective values, access rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import null_safe
from moraine.operators.state import state_rows

SOURCE = ["host_name", "user_name", "source_path"]
# How the fields of policies merge. Optional ones count where they are given, numbers
# where they aren't 0, flags where they are true, texts and lists where they aren't empty.
FIELD_KINDS = {
    **{f"retention.{f}": "optional" for f in ("keepLatest", "keepHourly", "keepDaily", "keepWeekly", "keepMonthly", "keepAnnual", "ignoreIdenticalSnapshots")},
    "files.ignore": "list", "files.ignoreDotFiles": "list", "files.noParentIgnore": "flag", "files.noParentDotFiles": "flag", "files.ignoreCacheDirs": "optional", "files.maxFileSize": "number", "files.oneFileSystem": "optional",
    "scheduling.intervalSeconds": "number", "scheduling.cron": "list", "scheduling.manual": "flag", "scheduling.runMissed": "optional", "osSnapshots.volumeShadowCopy.enable": "optional",
}
#: Times of day are gathered from all policies up to the first that says not to.
TIMES, NO_MORE_TIMES = "scheduling.timeOfDay", "scheduling.noParentTimeOfDay"
#: Places of a path and the folders above it; user, host and global come behind them, and further
#: behind for a path with more.
PLACES = 64


def parent_path(path: Column) -> Column:
    """Folder above, for slashes and backslashes, with or without a drive letter (SF09); the root
    and a name without a separator are their own parent."""
    drive = F.regexp_extract(path, r"^([^/\\]:)(?=[/\\])", 1)
    rest = F.substring(path, F.length(drive) + 1, F.length(path))
    bare = F.when(F.length(rest) > 1, F.regexp_replace(rest, r"[/\\]$", "")).otherwise(rest)
    up = F.regexp_extract(bare, r"^(?s)(.*)[/\\][^/\\]*$", 1)
    none = ~bare.rlike(r"[/\\]")
    return F.when(none, path).when(up == "", F.concat(drive, F.substring(bare, 1, 1))).otherwise(F.concat(drive, up))


def steps(path: Column) -> Column:
    """Most folders above a path: its separators and one."""
    return F.length(path) - F.length(F.regexp_replace(path, r"[/\\]", "")) + 1


def ancestors(path: Column) -> Column:
    """The path and all folders above it with their distance: array of (place, path)."""
    step = lambda acc, i: F.when(parent_path(F.element_at(acc, -1)) == F.element_at(acc, -1), acc).otherwise(F.array_append(acc, parent_path(F.element_at(acc, -1))))
    return F.aggregate(F.sequence(F.lit(1), steps(path)), F.array(path), step)


def label_match(labels: Column, wanted: dict[str, str]) -> Column:
    """All wanted labels are there with their values (FI01); a missing label never matches."""
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.coalesce(F.try_element_at(labels, F.lit(k)) == v, F.lit(False))
    return out


def hierarchy(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies that apply to each source with their place (JN13): its path, the folders above,
    then user, host and global. ``sources`` has ``host_name, user_name, source_path``;
    ``policies`` the same and ``policy_id``. Policies join by equality on an exploded key, so no
    pair of a source and a foreign policy is formed."""
    s = sources.select("host_name", "user_name", "source_path").distinct()
    up = s.filter("source_path is not null").select("*", F.posexplode(ancestors(F.col("source_path"))).alias("place", "_p")).withColumn("_u", F.col("user_name")).withColumn("_h", F.col("host_name"))
    none = F.lit(None).cast("string")
    top = F.greatest(F.lit(PLACES), F.coalesce(steps(F.col("source_path")), F.lit(0))) + 1
    rest = s.select("*", F.explode(F.array(F.struct(top.alias("place"), F.col("host_name").alias("_h"), F.col("user_name").alias("_u")), F.struct((top + 1).alias("place"), F.col("host_name").alias("_h"), none.alias("_u")), F.struct((top + 2).alias("place"), none.alias("_h"), none.alias("_u")))).alias("_x")).select("host_name", "user_name", "source_path", "_x.place", none.alias("_p"), "_x._u", "_x._h")
    keys = up.unionByName(rest)
    p = policies.select("policy_id", F.col("host_name").alias("ph"), F.col("user_name").alias("pu"), F.col("source_path").alias("pp"))
    hit = keys.join(p, keys["_h"].eqNullSafe(p["ph"]) & keys["_u"].eqNullSafe(p["pu"]) & keys["_p"].eqNullSafe(p["pp"]))
    return hit.select("host_name", "user_name", "source_path", "place", "policy_id")


def effective(applied: DataFrame, values: DataFrame, fields: Sequence[str], defaults: dict | None = None) -> DataFrame:
    """First value of each field along the hierarchy and the policy that gave it (PO01, PO02).

    The hierarchy ends with the first policy that has ``no_parent``; then defaults don't apply.
    ``values`` has ``policy_id``, ``no_parent`` and the fields."""
    src = ["host_name", "user_name", "source_path"]
    rows = applied.join(values, "policy_id")
    stop = rows.groupBy(*src).agg(F.min(F.when(F.coalesce("no_parent", F.lit(False)), F.col("place"))).alias("_stop"))
    rows = null_safe(rows, stop, src, "left").filter(F.col("_stop").isNull() | (F.col("place") <= F.col("_stop")))
    aggs = [F.min(F.when(F.col(f).isNotNull(), F.struct("place", "policy_id", F.col(f).alias("v")))).alias(f) for f in fields]
    got = rows.groupBy(*src).agg(F.max("_stop").alias("_stop"), *aggs)
    cols = []
    for f in fields:
        d = (defaults or {}).get(f)
        cols += [F.coalesce(F.col(f"{f}.v"), F.when(F.col("_stop").isNull(), F.lit(d))).alias(f), F.col(f"{f}.policy_id").alias(f"{f}_from")]
    return got.select(*src, *cols)


def merged_fields(applied: DataFrame, leaves: DataFrame, cut: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Effective value of every field of every source (PO01, PO02): the source, ``field_path``,
    ``leaf_values`` (the elements of a list in order, one value of others) and ``defined_by``, the
    policy it comes from.

    ``applied`` is the hierarchy, ``leaves`` has ``policy_id, field_path, leaf_pos, leaf_text`` and
    ``cut`` the ``policy_id`` of policies without parents: those above them don't count, for any
    field. Of the rest the most specific policy that gives a field decides it, by the kind of the
    field; of two at one place the one of lesser id. Times of day are united as minutes of the day,
    up to the first policy that cuts them off; ``defined_by`` is then the last that adds any. Fields
    nobody gives have no row. Values stay apart as rows, so no policy is widened to all fields.
    """
    kinds = FIELD_KINDS if kinds is None else kinds
    stop = applied.join(cut.select("policy_id").distinct(), "policy_id", "left_semi").groupBy(*SOURCE).agg(F.min("place").alias("_stop"))
    a = null_safe(applied, stop, SOURCE, "left").filter(F.col("_stop").isNull() | (F.col("place") <= F.col("_stop"))).drop("_stop")
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("field_path")]
    given = F.when(kind == "number", ~F.col("leaf_text").rlike("^[+-]?0*$")).when(kind == "flag", F.col("leaf_text") == "true").when(kind == "list", F.col("leaf_text").isNotNull()).when(kind == "optional", F.col("leaf_text") != "")
    own = leaves.filter(given).groupBy("policy_id", "field_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_pos", "leaf_text"))), lambda x: x["leaf_text"]).alias("_v"))
    best = a.join(own, "policy_id").groupBy(*SOURCE, "field_path").agg(F.min(F.struct("place", "policy_id", "_v")).alias("_b"))
    plain = best.select(*SOURCE, "field_path", F.col("_b._v").alias("leaf_values"), F.col("_b.policy_id").alias("defined_by"))
    part = lambda n: F.max(F.when(F.col("field_path").endswith(n), F.expr("try_cast(leaf_text as int)")))
    times = leaves.filter(F.col("field_path").isin(f"{TIMES}.hour", f"{TIMES}.min")).groupBy("policy_id", "leaf_pos").agg((F.coalesce(part(".hour"), F.lit(0)) * 60 + F.coalesce(part(".min"), F.lit(0))).alias("_t"))
    last = a.join(leaves.filter((F.col("field_path") == NO_MORE_TIMES) & (F.col("leaf_text") == "true")).select("policy_id"), "policy_id", "left_semi").groupBy(*SOURCE).agg(F.min(F.struct("place", "policy_id")).alias("_last"))
    counted = null_safe(a, last, SOURCE, "left").filter(F.col("_last").isNull() | (F.struct("place", "policy_id") <= F.col("_last"))).join(times, "policy_id")
    united = counted.groupBy(*SOURCE).agg(F.transform(F.array_sort(F.collect_set("_t")), lambda x: x.cast("string")).alias("leaf_values"), F.max_by("policy_id", F.struct("place", "policy_id")).alias("defined_by"))
    return plain.unionByName(united.withColumn("field_path", F.lit(TIMES)))


def with_set(policies: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Versions of policies after setting some (PO05): ``new`` has the source and ``payload``. A
    source that has a live policy gets a version of that one, any other a new id; an older version
    of a policy never follows a newer one. Gives all versions: ``policy_id``, source,
    ``modified_at, deleted, payload``."""
    cols = ["policy_id", *SOURCE, "modified_at", "deleted", "payload"]
    state = state_rows(policies, "policy_id", "modified_at", [*SOURCE]).filter(~F.col("deleted"))
    live = state.groupBy(*SOURCE).agg(F.min(F.struct("policy_id", F.col("modified_at").alias("m"))).alias("_l"))
    wanted = new.groupBy(*SOURCE).agg(F.max("payload").alias("payload"))
    rows = null_safe(wanted, live, SOURCE, "left")
    fresh = F.sha2(F.to_json(F.struct(*SOURCE)), 256)
    put = rows.select(F.coalesce("_l.policy_id", F.substring(fresh, 1, 32)).alias("policy_id"), *SOURCE, F.greatest(now, F.col("_l.m") + F.expr("interval 1 microsecond")).alias("modified_at"), F.lit(False).alias("deleted"), "payload")
    return policies.select(*cols).unionByName(put)


def with_removed(policies: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Versions of policies after removing those of ``sources`` (PO05): a tombstone for each live one."""
    cols = ["policy_id", *SOURCE, "modified_at", "deleted", "payload"]
    live = state_rows(policies, "policy_id", "modified_at", SOURCE).filter(~F.col("deleted"))
    gone = null_safe(live, sources.select(*SOURCE).distinct(), SOURCE, "left_semi")
    dead = gone.select("policy_id", *SOURCE, F.greatest(now, F.col("modified_at") + F.expr("interval 1 microsecond")).alias("modified_at"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("payload"))
    return policies.select(*cols).unionByName(dead)


def exported(policies: DataFrame) -> DataFrame:
    """``target, payload`` of the live policies (PO05): the target as text, unique per source."""
    live = state_rows(policies, "policy_id", "modified_at", [*SOURCE, "payload"]).filter(~F.col("deleted"))
    return live.groupBy(F.to_json(F.struct(*SOURCE)).alias("target")).agg(F.min_by("payload", "policy_id").alias("payload"))


def imported(policies: DataFrame, rows: DataFrame, now: Column, only: bool = False) -> DataFrame:
    """Versions of policies after an import of exported rows (PO05); with ``only`` the policies of all
    other sources are removed."""
    at = F.from_json("target", ", ".join(f"{c} string" for c in SOURCE))
    new = rows.select(at.alias("_s"), "payload").select(*[F.col(f"_s.{c}").alias(c) for c in SOURCE], "payload")
    if only:
        live = state_rows(policies, "policy_id", "modified_at", SOURCE).filter(~F.col("deleted"))
        policies = with_removed(policies, null_safe(live, new.select(*SOURCE).distinct(), SOURCE, "left_anti"), now)
    return with_set(policies, new, now)


def merged_lists(a: Column, b: Column, no_parent: Column) -> Column:
    """Sorted union of a list with its parent's unless the parent is cut off (SE02, PO02)."""
    empty = F.array().cast("array<string>")
    mine = F.coalesce(a, empty)
    return F.array_sort(F.when(no_parent, mine).otherwise(F.array_union(mine, F.coalesce(b, empty))))


def user_matches(pattern: Column, user: Column) -> Column:
    """``user@host`` against a pattern in which each side may be ``*`` (FI18)."""
    pu, ph = F.substring_index(pattern, "@", 1), F.substring_index(pattern, "@", -1)
    uu, uh = F.substring_index(user, "@", 1), F.substring_index(user, "@", -1)
    return ((pu == "*") | (pu == uu)) & ((ph == "*") | (ph == uh))


def effective_access(users: DataFrame, rules: DataFrame) -> DataFrame:
    """Highest access level of each user (JN15). ``rules`` (``pattern, access``) split by what they
    fix - both sides, user, host or neither - and each kind joins by equality."""
    u = users.select("user_at_host").distinct().withColumns({"_u": F.substring_index("user_at_host", "@", 1), "_h": F.substring_index("user_at_host", "@", -1)})
    r = rules.select(F.substring_index("pattern", "@", 1).alias("pu"), F.substring_index("pattern", "@", -1).alias("ph"), "access").groupBy("pu", "ph").agg(F.max("access").alias("access"))
    keys = u.select("user_at_host", F.explode(F.array(F.struct(F.col("_u").alias("pu"), F.col("_h").alias("ph")), F.struct(F.col("_u").alias("pu"), F.lit("*").alias("ph")), F.struct(F.lit("*").alias("pu"), F.col("_h").alias("ph")), F.struct(F.lit("*").alias("pu"), F.lit("*").alias("ph")))).alias("k")).select("user_at_host", "k.*")
    return keys.join(r, ["pu", "ph"]).groupBy("user_at_host").agg(F.max("access").alias("access"))


def access(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Highest access that rules give to each request (FI18, JN15), 0 if none does.

    ``requests`` has ``request_id, user_at_host`` and ``labels`` (map) of the manifest asked for,
    ``rules`` ``pattern, target`` (map) and ``access``. A rule matches if its pattern does - each side
    may be ``*`` - and the labels have all of its target's entries, ``OWN_USER`` and ``OWN_HOST``
    in them standing for the request's. Rules and requests meet by equality on the pattern's two
    sides. Maps cannot be null-compared: a rule or request without a map has none of its entries.
    """
    user, host = F.substring_index("user_at_host", "@", 1), F.substring_index("user_at_host", "@", -1)
    r = requests.select("request_id", user.alias("_user"), host.alias("_host"), "labels")
    star = F.lit("*")
    keys = F.explode(F.array(*[F.struct(u.alias("pu"), h.alias("ph")) for u, h in ((F.col("_user"), F.col("_host")), (F.col("_user"), star), (star, F.col("_host")), (star, star))])).alias("k")
    p = rules.select(F.substring_index("pattern", "@", 1).alias("pu"), F.substring_index("pattern", "@", -1).alias("ph"), "target", "access")
    met = r.select("*", keys).select("request_id", "_user", "_host", "labels", "k.*").join(p, ["pu", "ph"])
    own = lambda v: F.replace(F.replace(v, F.lit("OWN_USER"), F.col("_user")), F.lit("OWN_HOST"), F.col("_host"))
    has = F.forall(F.map_entries(F.coalesce("target", F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.try_element_at("labels", e["key"]) == own(e["value"]), F.lit(False)))
    best = met.filter(has).groupBy("request_id").agg(F.max("access").alias("access"))
    return requests.select("request_id").distinct().join(best, "request_id", "left").select("request_id", F.coalesce("access", F.lit(0)).alias("access"))


def compressor(name: Column, extension: Column, size: Column, least: Column, most: Column, only: Column, never: Column) -> Column:
    """Compressor of a file by a policy's compression values (FI13), empty for none: ``none`` and no
    name mean none; so do sizes below ``least`` or above ``most`` (0 or null is no bound) and an
    extension in ``never`` that isn't in ``only``. A list of extensions to compress leaves the
    others as they are. The lists may be null."""
    listed = lambda xs: F.coalesce(F.array_contains(xs, extension), F.lit(False))
    out = F.when(F.coalesce(name, F.lit("none")).isin("none", ""), "").when((least > 0) & (size < least), "").when((most > 0) & (size > most), "")
    return out.when(listed(only), name).when(listed(never), "").otherwise(name)


def maintenance_mode(owner: Column, full_due: Column, quick_due: Column) -> Column:
    """Kind of maintenance to run now (MS09): none for anyone but the owner, else full before quick."""
    return F.when(~F.coalesce(owner, F.lit(False)), "none").when(full_due, "full").when(quick_due, "quick").otherwise("none")
