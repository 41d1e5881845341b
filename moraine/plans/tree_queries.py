"""Queries over directory trees, listings, policies and filters (GR, JN, AG, FI, PO, SE, ST, SC)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moraine.functions import scalars as X
from moraine.functions import wildcards as W
from moraine.operators import listing, nested, trees
from moraine.operators import policies as P
from moraine.operators.history import SOURCE, usable_snapshots
from moraine.operators.joins import disambiguated
from moraine.operators.orphans import object_key
from moraine.operators.ranking import neighbour, null_safe
from moraine.operators.state import compacted_manifests, state_rows
from moraine.plans.base import BL, CW, DI, EN, LV, PO, SN, Registry, sql
from moraine.session import materialise
from moraine.sources import sinks

q = Registry()
QUERIES, ORACLE = q.QUERIES, q.ORACLE

NOW = 1_735_689_600  # 2025-01-01
KEY = "regexp_replace({}, '^I*Z?', '')"
WALK = f"walk(k) AS (SELECT DISTINCT {KEY.format('root_oid')} FROM sn WHERE root_oid IS NOT NULL UNION SELECT {KEY.format('en.object_id')} FROM walk JOIN en ON en.dir_oid = k WHERE entry_type = 'd' AND en.object_id IS NOT NULL)"
USED = f"used AS (SELECT DISTINCT {KEY.format('object_id')} k FROM en WHERE entry_type IN ('f', 's') AND object_id IS NOT NULL AND dir_oid IN (SELECT k FROM walk))"


def rec(*parts):
    return sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _roots(t):
    return t.snapshots.filter("root_oid is not null").select(object_key(F.col("root_oid")).alias("key"))


def _edges(t):
    """Entries of all directories, written once and read at each level of a walk."""
    return materialise(trees.edges(t.directories), "edges")


def _used(t):
    edge = _edges(t)
    return trees.reachable_contents(trees.reachable_folders(_roots(t), edge), edge)


# -- walks --------------------------------------------------------------------------------------
@q(sql(DI, EN, "SELECT dir_oid, entry_name, entry_type, object_id, file_size FROM en"))
def sc18_directory_entries(t):
    return trees.edges(t.directories).select("dir_oid", "entry_name", "entry_type", "object_id", "file_size")


@q(rec(SN, DI, EN, WALK, "SELECT k AS key FROM walk"))
def gr01_tree_walk(t):
    return trees.reachable_folders(_roots(t), _edges(t))


@q(rec(SN, DI, EN, WALK, USED, "SELECT k AS key FROM used"))
def jn04_contents_in_use(t):
    return _used(t)


_PATHS = f"pt(root, node, path, entry_type, key, file_size, depth) AS (SELECT DISTINCT {KEY.format('root_oid')}, {KEY.format('root_oid')}, '', 'd', NULL::VARCHAR, NULL::BIGINT, 0 FROM sn WHERE root_oid IS NOT NULL UNION ALL SELECT root, CASE WHEN en.entry_type = 'd' THEN {KEY.format('en.object_id')} END, path || '/' || entry_name, en.entry_type, {KEY.format('en.object_id')}, en.file_size, depth + 1 FROM pt JOIN en ON en.dir_oid = pt.node)"


@q(rec(SN, DI, EN, _PATHS, "SELECT root, path, entry_type, key, file_size, depth FROM pt WHERE depth > 0"))
def gr05_recursive_list(t):
    return trees.paths_below(_roots(t), _edges(t))


@q(rec(SN, DI, EN, _PATHS, "SELECT path, count(*) n, count(DISTINCT key) objects FROM pt WHERE depth = 2 GROUP BY 1"))
def gr02_nested_path(t):
    edge, folder = _edges(t), "entry_type = 'd' and key is not null"
    one = _roots(t).distinct().join(edge.filter(folder).select(F.col("dir_oid").alias("key"), F.col("entry_name").alias("a"), F.col("key").alias("b")), "key")
    two = one.select("a", "b").join(edge.select(F.col("dir_oid").alias("b"), "entry_name", "key"), "b")
    rows = two.select(F.concat(F.lit("/"), "a", F.lit("/"), "entry_name").alias("path"), "key")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("objects"))


_ASKED = f"rt AS (SELECT DISTINCT {KEY.format('root_oid')} root FROM sn WHERE root_oid IS NOT NULL), ak AS (SELECT root, e.entry_name a, min(f.entry_name) b FROM rt JOIN en e ON e.dir_oid = root JOIN en f ON f.dir_oid = {KEY.format('e.object_id')} WHERE e.entry_type = 'd' GROUP BY ALL)"


@q(sql(SN, DI, EN, _ASKED, f"SELECT DISTINCT root, a || '/' || b AS path, f.entry_type, {KEY.format('f.object_id')} AS key FROM ak JOIN en e ON e.dir_oid = root AND e.entry_name = a AND e.entry_type = 'd' JOIN en f ON f.dir_oid = {KEY.format('e.object_id')} AND f.entry_name = b"))
def gr02_resolved_paths(t):
    """The first entry of each folder in a root, asked for by its path."""
    edge = _edges(t)
    up = edge.filter("entry_type = 'd'").select(F.col("dir_oid").alias("root"), F.col("entry_name").alias("a"), F.col("key").alias("dir_oid"))
    asked = _roots(t).distinct().select(F.col("key").alias("root")).join(up, "root").join(edge.select("dir_oid", "entry_name"), "dir_oid").groupBy("root", "a").agg(F.min("entry_name").alias("b"))
    return trees.resolved(asked.select("root", F.concat_ws("/", "a", "b").alias("path")).filter("a is not null and b is not null"), edge).distinct()


@q(sql(DI, EN, "SELECT dir_oid, count(*) FILTER (WHERE keep) n, coalesce(sum(file_size) FILTER (WHERE keep), 0)::BIGINT bytes FROM (SELECT *, NOT (entry_name LIKE '%.raw' OR entry_name LIKE '%.mkv') keep FROM en WHERE entry_name IS NOT NULL) GROUP BY 1"))
def gr07_remove_by_name(t):
    out = trees.without_entries(t.directories, F.col("entry_name").rlike(r"\.(raw|mkv)$"))
    had = t.directories.filter("size(filter(entries, e -> e.entry_name is not null)) > 0").select("dir_oid")
    size = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["file_size"], F.lit(0)))
    return out.join(had, "dir_oid", "left_semi").select("dir_oid", F.greatest(F.coalesce(F.size("entries"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"), F.coalesce(size, F.lit(0)).alias("bytes"))


@q()
def gr06_rewritten_trees(t):
    """Trees without links: old and new id of each folder and root, the SHA-256 of what is left of
    it, and files, bytes and folders below. A root that isn't in the table keeps its id."""
    out = trees.rewritten(t.directories, F.col("entry_type") == "s")
    roots = _roots(t).select(F.col("key").alias("dir_oid"), F.lit(True).alias("root")).distinct()
    rows = out.join(roots, "dir_oid", "full_outer")
    return rows.withColumns({"root": F.coalesce("root", F.lit(False)), "new_oid": F.coalesce("new_oid", "dir_oid")})


@q("WITH l AS (SELECT manifest_id, entry_path, sha256(concat_ws('|', entry_path, coalesce(object_id, ''))) h FROM (SELECT DISTINCT manifest_id, entry_path, object_id FROM snapshot_entries WHERE manifest_id IS NOT NULL AND entry_path IS NOT NULL)) SELECT manifest_id, sha256(string_agg(h, '' ORDER BY run)) fingerprint FROM (SELECT manifest_id, run, sha256(string_agg(h, '' ORDER BY entry_path, h)) h FROM (SELECT *, (row_number() OVER (PARTITION BY manifest_id ORDER BY entry_path, h) - 1) // 4096 run FROM l) GROUP BY ALL) GROUP BY 1")
def gr09_fingerprint(t):
    rows = t.snapshot_entries.filter("manifest_id is not null and entry_path is not null").select("manifest_id", "entry_path", "object_id").distinct()
    return trees.fingerprints(rows, ["manifest_id"], "entry_path", F.coalesce("object_id", F.lit("")))


# -- garbage and verification --------------------------------------------------------------------
_GC = f"gc AS (SELECT CASE WHEN content_id LIKE 'm%' THEN 'system' WHEN k IS NOT NULL AND live THEN 'in use' WHEN k IS NOT NULL THEN 'undelete' WHEN {NOW} - timestamp_seconds < 15552000 THEN 'too recent' ELSE 'unused' END fate, packed_length FROM cw LEFT JOIN used ON k = content_id)"


@q(rec(SN, DI, EN, WALK, USED, CW, _GC, "SELECT fate, count(*) n, sum(packed_length)::BIGINT bytes FROM gc GROUP BY 1"))
def jn03_snapshot_gc(t):
    return trees.gc_classes(t.contents, _used(t), NOW, 15_552_000).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.sum("packed_length").alias("bytes"))


_VO = "SELECT CASE WHEN c.content_id IS NULL THEN 'no content' WHEN NOT c.live THEN 'deleted content' WHEN b.blob_id IS NULL THEN 'no pack' ELSE 'ok' END state, count(*) n FROM (SELECT " + KEY.format("object_id") + " k FROM en WHERE entry_type IN ('f', 's') AND object_id IS NOT NULL) LEFT JOIN cw c ON c.content_id = k LEFT JOIN (SELECT blob_id FROM bl WHERE NOT deleted) b ON b.blob_id = c.pack_blob_id GROUP BY 1"


@q(sql(DI, EN, CW, BL, _VO))
def jn06_verify_objects(t):
    e = trees.edges(t.directories).filter("entry_type in ('f', 's') and key is not null").select(F.col("key").alias("content_id"))
    c = t.contents.select("content_id", "live", F.col("pack_blob_id").alias("blob_id"), F.lit(True).alias("_c"))
    b = t.live_blobs.select("blob_id", F.lit(True).alias("_b"))
    state = F.when(F.col("_c").isNull(), "no content").when(~F.col("live"), "deleted content").when(F.col("_b").isNull(), "no pack").otherwise("ok")
    return e.join(c, "content_id", "left").join(b, "blob_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


# -- listings -----------------------------------------------------------------------------------
ENTRY = "en1 AS (SELECT DISTINCT manifest_id, entry_path, entry_type, " + KEY.format("object_id") + " k, file_size, file_mode, mod_time, user_id, group_id FROM snapshot_entries WHERE entry_path IS NOT NULL)"
LAST = f"la AS (SELECT *, row_number() OVER (PARTITION BY host_name, user_name, source_path ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) r, lead(manifest_id) OVER (PARTITION BY host_name, user_name, source_path ORDER BY start_time DESC NULLS LAST, end_time DESC NULLS LAST, manifest_id DESC) older FROM sn WHERE complete AND start_time IS NOT NULL AND manifest_id IN (SELECT manifest_id FROM snapshot_entries)), pr AS (SELECT manifest_id pair, older FROM la WHERE r = 1 AND older IS NOT NULL)"


def _entries(t):
    e = t.snapshot_entries.filter("entry_path is not null")
    return e.select("manifest_id", "entry_path", "entry_type", object_key(F.col("object_id")).alias("key"), "file_size", "file_mode", "mod_time", "user_id", "group_id").distinct()


def _last_pairs(t):
    """The newest listed snapshot of each source with the one before it."""
    listed = usable_snapshots(t.manifests).join(t.snapshot_entries.select("manifest_id").distinct(), "manifest_id", "left_semi")
    w = Window.partitionBy(*SOURCE).orderBy(F.struct("start_time", "end_time", "manifest_id").desc())
    top = listed.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    g = top.groupBy(*SOURCE).agg(F.max(F.when(F.col("r") == 1, F.col("manifest_id"))).alias("pair"), F.max(F.when(F.col("r") == 2, F.col("manifest_id"))).alias("older"))
    return g.filter("older is not null").select("pair", "older")


def _all_pairs(t):
    """Every listed snapshot of each source with the one before it."""
    listed = usable_snapshots(t.manifests).join(t.snapshot_entries.select("manifest_id").distinct(), "manifest_id", "left_semi")
    placed = neighbour(listed, SOURCE, ["start_time", "end_time", "manifest_id"], {"older": "manifest_id"})
    return placed.filter("older is not null").select(F.col("manifest_id").alias("pair"), "older")


def _sides(t):
    pairs, e = _last_pairs(t), _entries(t)
    new = e.join(pairs.select(F.col("pair").alias("manifest_id"), "pair"), "manifest_id").drop("manifest_id")
    old = e.join(pairs.select(F.col("older").alias("manifest_id"), "pair"), "manifest_id").drop("manifest_id")
    return old, new


_DIFF = "df AS (SELECT coalesce(a.pair, b.pair) pair, a.pair IS NULL isnew, b.pair IS NULL gone, a.k IS DISTINCT FROM b.k other, (a.entry_type, a.file_size, a.file_mode, a.mod_time, a.user_id, a.group_id) IS DISTINCT FROM (b.entry_type, b.file_size, b.file_mode, b.mod_time, b.user_id, b.group_id) meta FROM (SELECT pair, e.* FROM en1 e JOIN pr ON older = manifest_id) a FULL JOIN (SELECT pair, e.* FROM en1 e JOIN pr ON pair = manifest_id) b ON a.pair = b.pair AND a.entry_path = b.entry_path)"


@q(sql(SN, ENTRY, LAST, _DIFF, "SELECT pair, count(*) FILTER (WHERE isnew) added, count(*) FILTER (WHERE gone) removed, sum(CASE WHEN NOT isnew AND NOT gone AND other THEN 1 + meta::INT ELSE 0 END)::BIGINT modified, count(*) FILTER (WHERE NOT isnew AND NOT gone AND NOT other AND meta) same_content_touched FROM df GROUP BY 1"))
def jn07_tree_diff(t):
    old, new = _sides(t)
    return trees.diff_stats(trees.diff(old, new, ["pair", "entry_path"]), ["pair"])


@q(sql(SN, ENTRY, LAST, "SELECT pair, count(*) n, count(o.k) cached FROM (SELECT pair, e.* FROM en1 e JOIN pr ON pair = manifest_id) n LEFT JOIN (SELECT pair op, entry_path, file_size, file_mode, mod_time, user_id, group_id, min(k) k FROM (SELECT pair, e.* FROM en1 e JOIN pr ON older = manifest_id) GROUP BY ALL) o ON op = pair AND o.entry_path = n.entry_path AND o.file_size = n.file_size AND o.file_mode = n.file_mode AND o.mod_time = n.mod_time AND o.user_id = n.user_id AND o.group_id = n.group_id GROUP BY 1"))
def jn09_cache_hits(t):
    old, new = _sides(t)
    keys = ["pair", "entry_path", "file_size", "file_mode", "mod_time", "user_id", "group_id"]
    hits = trees.cache_hits(new, old.withColumn("previous_no", F.lit(1)), keys)
    return hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.count("cached_key").alias("cached"))


@q(sql(SN, ENTRY, LAST, "w AS (SELECT DISTINCT pair, entry_path, entry_type = 'd' d FROM en1 JOIN pr ON pair = manifest_id)", "SELECT pair || ':' || entry_path path, entry_type FROM (SELECT DISTINCT pair, entry_path, entry_type FROM en1 JOIN pr ON older = manifest_id) l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.pair = l.pair AND w.entry_path = l.entry_path AND w.d = (l.entry_type = 'd'))"))
def jn12_delete_extra(t):
    old, new = (s.select(F.concat_ws(":", "pair", "entry_path").alias("path"), "entry_type").distinct() for s in _sides(t))
    return trees.extra_locals(old, new)


# The same over all pairs.
EVERY = LAST.replace("WHERE r = 1 AND older IS NOT NULL", "WHERE older IS NOT NULL")
META = ["file_size", "file_mode", "mod_time", "user_id", "group_id"]


def _all_sides(t, columns, keys):
    """Distinct entries of both sides of every pair. They are dealt out by ``keys`` once, which
    serves the repeats and a join on ``keys``; the shuffle by listing is shared by both sides."""
    pairs = _all_pairs(t)
    e = t.snapshot_entries.filter("entry_path is not null and manifest_id is not null").withColumn("key", object_key(F.col("object_id"))).select("manifest_id", "entry_path", *columns)
    return [e.join(pairs.select(F.col(side).alias("manifest_id"), F.col("pair").alias("pair")), "manifest_id").select("pair", "entry_path", *columns).repartition(*keys).distinct() for side in ("older", "pair")]


@q(ORACLE["jn07_tree_diff"].replace(LAST, EVERY))
def jn07_all_diffs(t):
    keys = ["pair", "entry_path"]
    old, new = _all_sides(t, ["entry_type", "key", *META], keys)
    return trees.diff_stats(trees.diff(old, new, keys), ["pair"])


@q(ORACLE["jn09_cache_hits"].replace(LAST, EVERY))
def jn09_all_cache_hits(t):
    keys = ["pair", "entry_path", *META]
    old, new = _all_sides(t, ["entry_type", "key", *META], keys)
    hits = trees.cache_hits(new, old.withColumn("previous_no", F.lit(1)), keys)
    return hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.count("cached_key").alias("cached"))


@q(ORACLE["jn12_delete_extra"].replace(LAST, EVERY))
def jn12_all_extra(t):
    old, new = (s.select(F.concat_ws(":", "pair", "entry_path").alias("path"), "entry_type") for s in _all_sides(t, ["entry_type"], ["pair", "entry_path"]))
    return trees.extra_locals(old, new)


_LISTED = "ls AS (SELECT DISTINCT manifest_id, entry_path, entry_type, file_size, mod_time FROM snapshot_entries WHERE entry_path IS NOT NULL AND manifest_id IS NOT NULL)"


@q(f"WITH {_LISTED}, ex AS (SELECT *, unnest(range(0, len(string_split(entry_path, '/')))) i FROM ls) SELECT manifest_id, CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(string_split(entry_path, '/')[1:i], '/') END folder, sum(file_size)::BIGINT bytes, count(*) FILTER (WHERE entry_type = 'f') files, count(*) FILTER (WHERE entry_type = 's') links, max(mod_time) last_change FROM ex GROUP BY ALL")
def ag07_roll_up(t):
    rows = t.snapshot_entries.filter("entry_path is not null and manifest_id is not null").select("manifest_id", "entry_path", "entry_type", "file_size", "mod_time").distinct()
    return trees.rolled_up(rows, ["manifest_id"], "entry_path", "file_size")


_FAILED = "SELECT manifest_id, list(entry_path ORDER BY entry_path) failed FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY entry_path) r FROM (SELECT DISTINCT manifest_id, entry_path FROM snapshot_entries WHERE object_id IS NULL AND entry_path IS NOT NULL)) WHERE r <= 10 GROUP BY 1"


@q(_FAILED)
def ag08_top_failures(t):
    """The first ten entries without an object of each snapshot, by path."""
    bad = t.snapshot_entries.filter("object_id is null and entry_path is not null").select("manifest_id", "entry_path").distinct()
    w = Window.partitionBy("manifest_id").orderBy("entry_path")
    return bad.withColumn("r", F.row_number().over(w)).filter("r <= 10").groupBy("manifest_id").agg(F.array_sort(F.collect_list("entry_path")).alias("failed"))


_SRC = "host_name, user_name, source_path"


@q(sql(SN, CW, f"sq AS (SELECT *, row_number() OVER (PARTITION BY {_SRC} ORDER BY start_time NULLS FIRST, end_time NULLS FIRST, manifest_id) seq FROM sn)", "ob AS (SELECT s.host_name, s.user_name, s.source_path, " + KEY.format("e.object_id") + " k, min(seq) seq, min_by(file_size, (seq, coalesce(file_size, -1))) file_size FROM snapshot_entries e JOIN sq s USING (manifest_id) WHERE e.object_id IS NOT NULL GROUP BY ALL)", "nw AS (SELECT host_name, user_name, source_path, seq, count(*) new_objects, sum(file_size) object_bytes, count(original_length) new_contents, sum(packed_length) packed_bytes FROM ob LEFT JOIN cw ON content_id = k GROUP BY ALL)", f"SELECT concat_ws('|', coalesce(host_name, ''), coalesce(user_name, ''), coalesce(source_path, '')) src, seq, new_objects, object_bytes::BIGINT object_bytes, new_contents, packed_bytes::BIGINT packed_bytes, sum(new_objects) OVER (PARTITION BY {_SRC} ORDER BY seq)::BIGINT total_objects FROM nw"))
def ag09_storage_stats(t):
    from moraine.operators.ranking import rank_within, running_within

    seq = rank_within(t.snapshots, SOURCE, ["start_time", "end_time", "manifest_id"], name="seq").select("manifest_id", *SOURCE, "seq")
    e = t.snapshot_entries.filter("object_id is not null").select("manifest_id", object_key(F.col("object_id")).alias("key"), "file_size")
    new = trees.storage_stats(e.join(seq, "manifest_id"), t.contents, SOURCE, "seq")
    src = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in SOURCE])
    run = running_within(new, SOURCE, ["seq"], sums={"total_objects": "new_objects"})
    return run.select(src.alias("src"), "seq", F.col("new_objects"), "object_bytes", "new_contents", "packed_bytes", "total_objects")


@q("SELECT size_class, left_out, count(*) n, sum(file_size)::BIGINT bytes FROM (SELECT CASE " + " ".join(f"WHEN file_size >= {10**k} THEN {k}" for k in range(15, 2, -1)) + " ELSE 0 END size_class, entry_path LIKE '%.tar' OR entry_path LIKE '%.raw' left_out, file_size FROM snapshot_entries WHERE file_size IS NOT NULL AND entry_path IS NOT NULL) GROUP BY ALL")
def ag06_estimate(t):
    """Included and excluded files by the first size class they reach, largest first (MS07)."""
    rules = [W.compiled("*.tar"), W.compiled("*.raw")]
    e = t.snapshot_entries.filter("file_size is not null and entry_path is not null")
    path = F.concat(F.lit("/"), "entry_path")
    k = F.coalesce(*[F.when(F.col("file_size") >= 10**i, F.lit(i)) for i in range(15, 2, -1)], F.lit(0))
    return e.groupBy(k.alias("size_class"), W.pruned(rules, path, F.lit(False)).alias("left_out")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


# -- filters ------------------------------------------------------------------------------------
@q("SELECT policy_id, modified_at FROM policies WHERE labels['type'] = 'policy' AND labels['policyType'] = 'path'")
def fi01_label_match(t):
    return t.policies.filter(P.label_match(F.col("labels"), {"type": "policy", "policyType": "path"})).select("policy_id", "modified_at")


_PATTERNS = {"*.tar": r"(?:.*/)?[^/]*\.tar", "/ka*/**": r"/ka[^/]*/.*", "ir??l*": r"(?:.*/)?ir[^/][^/]l[^/]*", "**/bel*/*.dat": r"(?:.*/)?bel[^/]*/[^/]*\.dat", "[a-f]*[!a-m]": r"(?:.*/)?[a-f][^/]*[^a-m]"}


@q(" UNION ALL ".join(f"SELECT '{p}' pattern, count(*) n FROM snapshot_entries WHERE regexp_full_match('/' || entry_path, '{r}')" for p, r in _PATTERNS.items()))
def fi09_wildcards(t):
    path = F.concat(F.lit("/"), "entry_path")
    sums = t.snapshot_entries.filter("entry_path is not null").agg(*[F.count(F.when(W.compiled(p).matches(path, F.lit(False)), 1)).alias(f"c{i}") for i, p in enumerate(_PATTERNS)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("n")) for i, p in enumerate(_PATTERNS)])).alias("x")).select("x.*")


@q("SELECT ign, count(*) n FROM (SELECT CASE WHEN entry_path LIKE '%.tar' THEN NOT regexp_full_match(entry_path, '(?:.*/)?ka[^/]*') ELSE regexp_full_match(entry_path, '(?:.*/)?bel[^/]*') AND NOT regexp_full_match(entry_path, '(?:.*/)?ka[^/]*') END ign FROM snapshot_entries WHERE entry_path IS NOT NULL) GROUP BY 1")
def fi10_layers(t):
    """Outer rules first, then inner ones that may take a verdict back."""
    path, no = F.concat(F.lit("/"), "entry_path"), F.lit(False)
    outer = W.ignored([W.compiled("*.tar"), W.compiled("bel*")], path, no)
    inner = W.ignored([W.compiled("!ka*")], path, no, outer)
    return t.snapshot_entries.filter("entry_path is not null").groupBy(inner.alias("ign")).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT manifest_id, count(*) n FROM snapshot_entries WHERE entry_path IS NOT NULL AND coalesce(file_size, 0) <= 100000 AND NOT regexp_matches('/' || entry_path, '/(ka|bel)[^/]*/') AND NOT regexp_matches('/' || entry_path, '/(ka|bel)[^/]*$') GROUP BY 1")
def fi11_pruned_listing(t):
    """Entries up to a size, without what lies in ignored folders."""
    rules = [W.compiled("ka*"), W.compiled("bel*")]
    path = F.concat(F.lit("/"), "entry_path")
    rows = t.snapshot_entries.filter("entry_path is not null").filter(F.coalesce("file_size", F.lit(0)) <= 100_000)
    return rows.filter(~W.pruned(rules, path, F.lit(False))).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT manifest_id, count(*) n FROM snapshot_entries WHERE entry_path IS NOT NULL AND NOT ((entry_path LIKE '%.tar' OR regexp_full_match('/' || entry_path, '/kagud/(?:.*/)?[^/]*\\.dat')) AND NOT regexp_full_match('/' || entry_path, '/bel/(?:.*/)?[^/]*\\.tar')) GROUP BY 1")
def fi12_folder_rules(t):
    """Rules that belong to folders: each folder's rules count below it, after its parents'."""
    path, no = F.concat(F.lit("/"), "entry_path"), F.lit(False)
    rules = [W.compiled("*.tar"), W.compiled("*.dat", base="/kagud"), W.compiled("!*.tar", base="/bel")]
    return t.snapshot_entries.filter("entry_path is not null").filter(~W.ignored(rules, path, no)).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"))


# Rules of policies as ignore files at the roots of their sources: SQL for the forms that occur.
_RX = r"'^' || CASE WHEN contains(rtrim(b, '/'), '/') THEN '/' ELSE '/(?:[^/]+/)*' END || replace(replace(replace(replace(replace(ltrim(rtrim(b, '/'), '/'), '.', '\.'), '**/', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(?:[^/]+/)*') || '$'"
_RULE = f"""pk AS (SELECT host_name, user_name, source_path, min(policy_id) policy_id FROM po GROUP BY ALL),
ru AS (SELECT sn.manifest_id, leaf_pos, leaf_text, b LIKE '%/' dirs, leaf_text LIKE '!%' neg, {_RX} rx FROM (SELECT *, ltrim(trim(leaf_text), '!') b FROM lv WHERE field_path = 'files.ignore') lv JOIN pk USING (policy_id)
  JOIN sn ON sn.host_name IS NOT DISTINCT FROM pk.host_name AND sn.user_name IS NOT DISTINCT FROM pk.user_name AND sn.source_path IS NOT DISTINCT FROM pk.source_path WHERE trim(b) <> ''),
ls AS (SELECT DISTINCT manifest_id, '/' || entry_path path FROM snapshot_entries WHERE manifest_id IS NOT NULL AND entry_path IS NOT NULL),
nd AS (SELECT manifest_id, path, array_to_string(string_split(path, '/')[1:i], '/') node, i < len(string_split(path, '/')) folder FROM (SELECT *, unnest(range(2, len(string_split(path, '/')) + 1)) i FROM ls)),
vd AS (SELECT nd.manifest_id, path, node, list_reduce(list_prepend(0, list(CASE WHEN regexp_matches(node, rx) AND (folder OR NOT dirs) THEN CASE WHEN neg THEN 3 ELSE 1 END ELSE 2 END ORDER BY leaf_pos, rx, neg)), lambda s, e: CASE WHEN s = 0 AND e = 1 THEN 1 WHEN s = 1 AND e = 3 THEN 0 ELSE s END) v FROM nd JOIN ru USING (manifest_id) GROUP BY ALL)"""


@q(sql(SN, PO, LV, _RULE, "SELECT manifest_id, count(*) n FROM ls WHERE (manifest_id, path) NOT IN (SELECT (manifest_id, path) FROM vd WHERE v = 1) GROUP BY 1"))
def fi12_policy_rules(t):
    """Entries left by the ignore lists of the policies of their sources, as ignore files at the
    root; of several policies for one source the one of least id counts."""
    pol = _policies(t).groupBy(*SOURCE).agg(F.min("policy_id").alias("policy_id"))
    leaves = nested.policy_leaves(nested.policy_nodes(t.policies)).filter("field_path = 'files.ignore'")
    at = null_safe(t.snapshots.select("manifest_id", *SOURCE), pol, SOURCE, "inner").select("manifest_id", "policy_id")
    lines = at.join(leaves, "policy_id").select(F.col("manifest_id").alias("tree"), F.lit("").alias("folder"), F.col("leaf_pos").alias("place"), F.col("leaf_text").alias("line"))
    e = t.snapshot_entries.filter("manifest_id is not null and entry_path is not null").select(F.col("manifest_id").alias("tree"), F.concat(F.lit("/"), "entry_path").alias("path"), F.lit(False).alias("is_folder")).distinct()
    return listing.without_ignored(e, listing.folder_rules(lines)).groupBy(F.col("tree").alias("manifest_id")).agg(F.count(F.lit(1)).alias("n"))


def _tree_entries(t):
    e = t.snapshot_entries.filter("manifest_id is not null and entry_path is not null")
    return e.select(F.col("manifest_id").alias("tree"), F.concat(F.lit("/"), "entry_path").alias("path"), (F.col("entry_type") == "d").alias("is_folder"), F.col("group_id").alias("device"), "file_size").distinct()


@q("WITH e AS (SELECT DISTINCT manifest_id, entry_path, entry_type, group_id, file_size FROM snapshot_entries WHERE manifest_id IS NOT NULL AND entry_path IS NOT NULL), r AS (SELECT manifest_id, min(group_id) root FROM e GROUP BY 1) SELECT manifest_id, count(*) n FROM e JOIN r USING (manifest_id) WHERE group_id = root OR group_id IS NULL OR root IS NULL GROUP BY 1")
def fi11_one_device(t):
    """Entries on the device of their listing's root; ``group_id`` stands for the device, and the
    root has the least. Listings have no rows of folders, so no mount takes others with it."""
    e = _tree_entries(t)
    return listing.on_root_device(e, e.groupBy("tree").agg(F.min("device").alias("root_device"))).groupBy(F.col("tree").alias("manifest_id")).agg(F.count(F.lit(1)).alias("n"))


@q("WITH e AS (SELECT DISTINCT manifest_id, '/' || entry_path path, entry_type, group_id, file_size FROM snapshot_entries WHERE manifest_id IS NOT NULL AND entry_path IS NOT NULL), m AS (SELECT DISTINCT manifest_id, regexp_replace(path, '/[^/]*$', '') folder FROM e WHERE path LIKE '%.db') SELECT manifest_id, count(*) n FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.manifest_id = e.manifest_id AND starts_with(e.path, m.folder || '/')) GROUP BY 1")
def fi11_cache_folders(t):
    """Entries outside of cache folders; a file ``*.db`` stands for a valid marker of its folder."""
    e = _tree_entries(t)
    marked = e.filter(F.col("path").endswith(".db")).select("tree", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    return listing.without_below(e, marked).groupBy(F.col("tree").alias("manifest_id")).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT chosen, count(*) n FROM (SELECT CASE WHEN file_size < 1000 THEN '' WHEN file_size > 1000000 THEN '' WHEN ext IN ('.db') THEN 'zstd' WHEN ext IN ('.mkv', '.tar') THEN '' ELSE 'zstd' END chosen FROM (SELECT regexp_extract(entry_path, '(\\.[^./]*)$', 1) ext, file_size FROM snapshot_entries WHERE entry_path IS NOT NULL AND file_size IS NOT NULL)) GROUP BY 1")
def fi13_compressor(t):
    """Compressor by size and extension; a list of extensions to compress doesn't exclude others."""
    ext, size = F.regexp_extract("entry_path", r"(\.[^./]*)$", 1), F.col("file_size")
    chosen = F.when(size < 1_000, "").when(size > 1_000_000, "").when(ext.isin(".db"), "zstd").when(ext.isin(".mkv", ".tar"), "").otherwise("zstd")
    return t.snapshot_entries.filter("entry_path is not null and file_size is not null").groupBy(chosen.alias("chosen")).agg(F.count(F.lit(1)).alias("n"))


_RULES = [("*@*", 1), ("root@*", 2), ("*@relay-hub", 3), ("svc_mirror@relay-hub", 4)]
_USERS = "u AS (SELECT DISTINCT user_name || '@' || host_name user_at_host FROM sn WHERE user_name IS NOT NULL AND host_name IS NOT NULL)"
_VALUES = "r(pattern, access) AS (VALUES " + ", ".join(f"('{p}', {a})" for p, a in _RULES) + ")"


def _users(t):
    return t.snapshots.filter("user_name is not null and host_name is not null").select(F.concat_ws("@", "user_name", "host_name").alias("user_at_host")).distinct()


@q(sql(SN, _USERS, "SELECT user_at_host FROM u WHERE user_at_host LIKE 'root@%'"))
def fi18_acl_match(t):
    return _users(t).filter(P.user_matches(F.lit("root@*"), F.col("user_at_host")))


@q(sql(SN, _USERS, _VALUES, "SELECT user_at_host, max(access) AS access FROM u JOIN r ON (split_part(pattern, '@', 1) IN ('*', split_part(user_at_host, '@', 1))) AND (split_part(pattern, '@', 2) IN ('*', split_part(user_at_host, '@', 2))) GROUP BY 1"))
def jn15_effective_access(t):
    return P.effective_access(_users(t), t.spark.createDataFrame(_RULES, "pattern string, access int"))


# -- policies -----------------------------------------------------------------------------------
_POL = "po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY modified_at DESC NULLS LAST, coalesce(deleted, false)) rn FROM policies WHERE policy_id IS NOT NULL) WHERE rn = 1 AND NOT coalesce(deleted, false))"
_UP = r"""up(host_name, user_name, source_path, p, place) AS (SELECT DISTINCT host_name, user_name, source_path, source_path, 0 FROM sn WHERE source_path IS NOT NULL
  UNION ALL SELECT host_name, user_name, source_path, np, place + 1 FROM (SELECT *, CASE WHEN NOT regexp_matches(b, '[/\\]') THEN p WHEN regexp_extract(b, '^(.*)[/\\][^/\\]*$', 1) = '' THEN d || b[1:1] ELSE d || regexp_extract(b, '^(.*)[/\\][^/\\]*$', 1) END np
    FROM (SELECT *, CASE WHEN length(rest) > 1 THEN regexp_replace(rest, '[/\\]$', '') ELSE rest END b FROM (SELECT *, p[length(d) + 1:] rest FROM (SELECT *, CASE WHEN regexp_matches(p, '^[^/\\]:[/\\]') THEN p[1:2] ELSE '' END d FROM up)))) WHERE np <> p)"""
_HI = """hi AS (SELECT k.host_name, k.user_name, k.source_path, place, policy_id FROM (
    SELECT host_name, user_name, source_path, p, user_name ku, host_name kh, place FROM up
    UNION ALL SELECT DISTINCT host_name, user_name, source_path, NULL, user_name, host_name, 65 FROM sn UNION ALL SELECT DISTINCT host_name, user_name, source_path, NULL, NULL, host_name, 66 FROM sn UNION ALL SELECT DISTINCT host_name, user_name, source_path, NULL, NULL, NULL, 67 FROM sn) k
  JOIN po ON po.host_name IS NOT DISTINCT FROM kh AND po.user_name IS NOT DISTINCT FROM ku AND po.source_path IS NOT DISTINCT FROM p)"""


def _policies(t):
    return state_rows(t.policies, "policy_id", "modified_at", ["host_name", "user_name", "source_path", "payload"]).filter("not deleted")


@q(rec(SN, _POL, _UP, _HI, "SELECT host_name, user_name, source_path, place, policy_id FROM hi"))
def jn13_policy_hierarchy(t):
    return P.hierarchy(t.snapshots, _policies(t))


FIELDS = ["keepLatest", "keepDaily", "keepWeekly"]


def _leaves(t):
    """Values of the policies' sections, and the flag of a policy without parents."""
    live = _policies(t).filter("payload is not null")
    return nested.policy_leaves(nested.nested_nodes(live, "policy_id", "payload", (*nested.SECTIONS, "noParent"), nested.LISTS))


def _values(t):
    leaves = _leaves(t).filter(F.col("field_path").isin(*[f"retention.{f}" for f in FIELDS], "noParent"))
    num = F.expr("try_cast(leaf_text as bigint)")
    return leaves.groupBy("policy_id").agg(*[F.max(F.when(F.col("field_path") == f"retention.{f}", num)).alias(f) for f in FIELDS], F.max(F.when(F.col("field_path") == "noParent", F.col("leaf_text") == "true")).alias("no_parent"))


_VALS = "vl AS (SELECT po.policy_id, " + ", ".join(f"max(TRY_CAST(leaf_text AS BIGINT)) FILTER (WHERE field_path = 'retention.{f}') {f}" for f in FIELDS) + ", bool_or(policy_id IN (SELECT policy_id FROM np)) np FROM po LEFT JOIN lv USING (policy_id) GROUP BY 1)"
#: Policies without parents; follows the values, whose first step it uses.
_NP = "np AS (SELECT policy_id FROM p1 WHERE json_valid(p) AND json_type(p) = 'OBJECT' AND p->>'noParent' = 'true')"
_EFF = "st AS (SELECT host_name, user_name, source_path, min(place) FILTER (WHERE np) stop FROM hi JOIN vl USING (policy_id) GROUP BY ALL), ap AS (SELECT hi.*, vl.* EXCLUDE (policy_id), stop FROM hi JOIN vl USING (policy_id) JOIN st ON hi.host_name IS NOT DISTINCT FROM st.host_name AND hi.user_name IS NOT DISTINCT FROM st.user_name AND hi.source_path IS NOT DISTINCT FROM st.source_path WHERE stop IS NULL OR place <= stop)"
_PICK = "SELECT host_name, user_name, source_path, " + ", ".join(f"coalesce(min_by({f}, (place, policy_id)) FILTER (WHERE {f} IS NOT NULL), CASE WHEN max(stop) IS NULL THEN {d} END) {f}, min_by(policy_id, (place, policy_id)) FILTER (WHERE {f} IS NOT NULL) {f}_from" for f, d in zip(FIELDS, (10, 7, 4), strict=True)) + " FROM ap GROUP BY ALL"


@q(rec(SN, _POL, _UP, _HI, LV, _NP, _VALS, _EFF, _PICK))
def po01_effective_policy(t):
    """Effective retention values of each source, and the policy each comes from."""
    v = _policies(t).select("policy_id").join(_values(t), "policy_id", "left")
    return P.effective(P.hierarchy(t.snapshots, _policies(t)), v, FIELDS, {"keepLatest": 10, "keepDaily": 7, "keepWeekly": 4})


_OPT = ", ".join(f"'{f}'" for f, k in P.FIELD_KINDS.items() if k == "optional")
_NUM, _FLAG, _LIST = (", ".join(f"'{f}'" for f, k in P.FIELD_KINDS.items() if k == kind) for kind in ("number", "flag", "list"))
_S3 = "host_name, user_name, source_path"
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("host_name", "user_name", "source_path"))
_MERGE = f"""sp AS (SELECT {_S3}, min(place) stop FROM hi WHERE policy_id IN (SELECT policy_id FROM np) GROUP BY ALL),
aa AS (SELECT a.* FROM hi a LEFT JOIN sp b ON {_SAME} WHERE stop IS NULL OR place <= stop),
vv AS (SELECT aa.*, field_path, leaf_pos, leaf_text FROM aa JOIN lv USING (policy_id) WHERE (field_path IN ({_OPT}) AND leaf_text <> '') OR (field_path IN ({_NUM}) AND NOT regexp_matches(leaf_text, '^[+-]?0*$')) OR (field_path IN ({_FLAG}) AND leaf_text = 'true') OR field_path IN ({_LIST})),
bb AS (SELECT *, rank() OVER (PARTITION BY {_S3}, field_path ORDER BY place, policy_id) r FROM vv),
tt AS (SELECT policy_id, leaf_pos, coalesce(max(TRY_CAST(leaf_text AS INT)) FILTER (WHERE field_path LIKE '%.hour'), 0) * 60 + coalesce(max(TRY_CAST(leaf_text AS INT)) FILTER (WHERE field_path LIKE '%.min'), 0) m FROM lv WHERE field_path IN ('scheduling.timeOfDay.hour', 'scheduling.timeOfDay.min') GROUP BY ALL),
lt AS (SELECT {_S3}, min((place, policy_id)) last FROM aa JOIN lv USING (policy_id) WHERE field_path = 'scheduling.noParentTimeOfDay' AND leaf_text = 'true' GROUP BY ALL),
ct AS (SELECT a.*, m FROM aa a JOIN tt USING (policy_id) LEFT JOIN lt b ON {_SAME} WHERE last IS NULL OR (place, policy_id) <= last)"""


@q(rec(SN, _POL, _UP, _HI, LV, _NP, _MERGE, f"SELECT {_S3}, field_path, list(leaf_text ORDER BY leaf_pos, leaf_text) leaf_values, min(policy_id) defined_by FROM bb WHERE r = 1 GROUP BY {_S3}, field_path UNION ALL SELECT {_S3}, 'scheduling.timeOfDay', list_transform(list_sort(list(DISTINCT m)), lambda x: x::VARCHAR), max_by(policy_id, (place, policy_id)) FROM ct GROUP BY {_S3}"))
def po02_merged_fields(t):
    """Every field of the effective policy of each source, with the policy that defines it."""
    leaves = materialise(_leaves(t), "leaves")
    cut = leaves.filter("field_path = 'noParent' and leaf_text = 'true'")
    return P.merged_fields(P.hierarchy(t.snapshots, _policies(t)), leaves, cut)


_AT = "timestamp '2025-06-01'"
_ALL = "al AS (SELECT policy_id, host_name, user_name, source_path, modified_at, coalesce(deleted, false) deleted, payload FROM policies)"


@q(sql(_POL, _ALL, f"rm AS (SELECT policy_id, {_S3}, greatest({_AT}, modified_at + INTERVAL 1 MICROSECOND) modified_at FROM po WHERE source_path IS NULL AND user_name IS NOT NULL)", f"hs AS (SELECT DISTINCT host_name FROM po WHERE host_name IS NOT NULL)", "lv1 AS (SELECT host_name, min(policy_id) policy_id FROM po WHERE user_name IS NULL AND source_path IS NULL GROUP BY 1)", "SELECT host_name, user_name, source_path, count(*) n, count(*) FILTER (WHERE payload = '{}') emptied FROM (SELECT policy_id, host_name, user_name, source_path, CASE WHEN policy_id IN (SELECT policy_id FROM lv1 WHERE host_name IS NOT NULL) THEN '{}' ELSE payload END payload FROM po WHERE policy_id NOT IN (SELECT policy_id FROM rm) UNION ALL SELECT NULL, host_name, NULL, NULL, '{}' FROM hs WHERE host_name NOT IN (SELECT host_name FROM lv1 WHERE host_name IS NOT NULL)) GROUP BY ALL"))
def po05_set_and_remove(t):
    """Live policies after the users' ones are removed and each host's is set to an empty one."""
    at = F.lit("2025-06-01").cast("timestamp_ntz")
    rows = t.policies.select("policy_id", *SOURCE, "modified_at", "deleted", "payload")
    live = _policies(t)
    done = P.with_removed(rows, live.filter("source_path is null and user_name is not null"), at)
    none = F.lit(None).cast("string")
    hosts = live.filter("host_name is not null").select("host_name", none.alias("user_name"), none.alias("source_path"), F.lit("{}").alias("payload")).distinct()
    out = state_rows(P.with_set(done, hosts, at), "policy_id", "modified_at", [*SOURCE, "payload"]).filter("not deleted")
    return out.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("payload") == "{}", 1)).alias("emptied"))


@q(sql(_POL, f"SELECT {_S3}, min_by(payload, policy_id) payload FROM po GROUP BY {_S3}"))
def po05_export_and_import(t):
    """Policies exported and imported into an empty store."""
    rows = t.policies.select("policy_id", *SOURCE, "modified_at", "deleted", "payload")
    got = P.imported(rows.limit(0), P.exported(rows), F.lit("2025-06-01").cast("timestamp_ntz"))
    return state_rows(got, "policy_id", "modified_at", [*SOURCE, "payload"]).filter("not deleted").select(*SOURCE, "payload")


_GRANTS = f"""rl AS (SELECT coalesce(user_name, '*') pu, coalesce(host_name, '*') ph, source_path, labels, length(coalesce(source_path, '')) % 3 + 1 AS access FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY modified_at DESC NULLS LAST, coalesce(deleted, false)) rn FROM policies WHERE policy_id IS NOT NULL) WHERE rn = 1 AND NOT coalesce(deleted, false)),
rq AS (SELECT DISTINCT manifest_id request_id, user_name u, host_name h, source_path p FROM sn WHERE user_name IS NOT NULL AND host_name IS NOT NULL)"""


@q(sql(SN, _GRANTS, "SELECT request_id, coalesce(max(access) FILTER (WHERE rl.pu IS NOT NULL AND (source_path IS NULL OR source_path = p)), 0) AS access FROM rq LEFT JOIN rl ON rl.pu IN ('*', u) AND rl.ph IN ('*', h) GROUP BY 1"))
def jn15_access_to_targets(t):
    """Access of each snapshot's user to it. Every live policy is a rule for its users and hosts,
    whose target is their own snapshots, of its path if it has one."""
    own = F.create_map(F.lit("type"), F.lit("snapshot"), F.lit("username"), F.lit("OWN_USER"), F.lit("hostname"), F.lit("OWN_HOST"))
    target = F.when(F.col("source_path").isNull(), own).otherwise(F.map_concat(own, F.create_map(F.lit("path"), F.col("source_path"))))
    level = (F.length(F.coalesce("source_path", F.lit(""))) % 3 + 1).alias("access")
    rules = _policies(t).select(F.concat_ws("@", F.coalesce("user_name", F.lit("*")), F.coalesce("host_name", F.lit("*"))).alias("pattern"), target.alias("target"), level)
    labels = F.create_map(F.lit("type"), F.lit("snapshot"), F.lit("username"), F.col("user_name"), F.lit("hostname"), F.col("host_name"), F.lit("path"), F.col("source_path"))
    asked = t.snapshots.filter("user_name is not null and host_name is not null").select(F.col("manifest_id").alias("request_id"), F.concat_ws("@", "user_name", "host_name").alias("user_at_host"), labels.alias("labels"))
    return P.access(asked, rules)


@q(rec(SN, _POL, _UP, _HI, "SELECT host_name, user_name, source_path, count(*) n, min_by(policy_id, (place, policy_id)) nearest FROM hi GROUP BY ALL"))
def po03_nearest_policy(t):
    h = P.hierarchy(t.snapshots, _policies(t))
    return h.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n"), F.min_by("policy_id", F.struct("place", "policy_id")).alias("nearest"))


@q("SELECT * FROM (VALUES ('latest', 10), ('hourly', 48), ('daily', 7), ('weekly', 4), ('monthly', 24), ('annual', 3)) v(kind, n)")
def po04_defaults(t):
    from moraine.operators.snapshots import DEFAULTS

    return t.spark.createDataFrame(list(DEFAULTS.items()), "kind string, n int")


@q(sql(_POL, "SELECT policy_id, labels['policyType'] kind, host_name, user_name, source_path FROM po"))
def po05_list_policies(t):
    kinds = t.policies.filter("labels is not null").select("policy_id", "modified_at", F.try_element_at("labels", F.lit("policyType")).alias("kind"))
    best = kinds.groupBy("policy_id", "modified_at").agg(F.max("kind").alias("kind"))
    rows = state_rows(t.policies, "policy_id", "modified_at", ["host_name", "user_name", "source_path"]).filter("not deleted")
    return rows.join(best, ["policy_id", "modified_at"], "left").select("policy_id", "kind", "host_name", "user_name", "source_path")


@q(sql(PO, LV, "ls AS (SELECT policy_id, list_sort(list(DISTINCT leaf_text)) l FROM lv WHERE field_path = 'files.ignore' GROUP BY 1)", "pl AS (SELECT po.policy_id, host_name, user_name, source_path, l FROM po LEFT JOIN ls USING (policy_id))", "SELECT a.policy_id, list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))) AS ignore FROM pl a LEFT JOIN pl b ON b.user_name IS NULL AND b.source_path IS NULL AND b.host_name = a.host_name"))
def po02_field_merges(t):
    """Ignore lists of each policy, merged with the list of its host's policy unless cut off."""
    leaves = nested.policy_leaves(nested.policy_nodes(t.policies))
    lists = leaves.filter("field_path = 'files.ignore'").groupBy("policy_id").agg(F.array_sort(F.collect_set("leaf_text")).alias("ignore"))
    p = _policies(t).select("policy_id", "host_name", "user_name", "source_path").join(lists, "policy_id", "left")
    host = p.filter("user_name is null and source_path is null").select(F.col("host_name").alias("_h"), F.col("ignore").alias("_i"))
    return p.join(host, F.col("host_name") == F.col("_h"), "left").select("policy_id", P.merged_lists(F.col("ignore"), F.col("_i"), F.lit(False)).alias("ignore"))


@q(sql(PO, LV, "SELECT lv.policy_id, field_path, leaf_text, CASE WHEN coalesce(user_name, '') = '' AND coalesce(host_name, '') = '' AND coalesce(source_path, '') = '' THEN '(global)' ELSE coalesce(user_name, '') || '@' || coalesce(host_name, '') || CASE WHEN coalesce(source_path, '') <> '' THEN ':' || source_path ELSE '' END END defined_for FROM lv JOIN po USING (policy_id)"))
def ms14_policy_report(t):
    """Each value of each policy with the source it is defined for."""
    leaves = nested.policy_leaves(nested.policy_nodes(t.policies))
    p = _policies(t).select("policy_id", X.source_string(F.col("user_name"), F.col("host_name"), F.col("source_path")).alias("defined_for"))
    return leaves.join(p, "policy_id").select("policy_id", "field_path", "leaf_text", "defined_for")


@q(sql(_POL, "n AS (SELECT coalesce(host_name, '') h, count(*) n FROM po GROUP BY 1)", "SELECT count(*) hosts, sum(n)::BIGINT policies, max(n) most FROM n"))
def ix17_compaction_counts(t):
    n = _policies(t).groupBy(F.coalesce("host_name", F.lit("")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("policies"), F.max("n").alias("most"))


_WR = "wr AS (SELECT DISTINCT id || '@' || coalesce(epoch_us(modified_at), 0) AS content, id AS manifest_id, modified_at, coalesce(deleted, false) deleted FROM (SELECT policy_id id, modified_at, deleted FROM policies UNION ALL SELECT manifest_id, modified_at, deleted FROM manifests) WHERE id IS NOT NULL), ct AS (SELECT count(DISTINCT content) >= 16 many FROM wr)"


@q(sql(_WR, "SELECT CASE WHEN many THEN 'compacted' ELSE content END AS content, manifest_id, modified_at, deleted FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY modified_at DESC NULLS LAST, deleted) rn FROM wr), ct WHERE NOT many OR (rn = 1 AND NOT deleted)"))
def ix17_compacted_manifests(t):
    """Contents of the manifests of both tables after compaction. The tables don't name contents:
    each written version of a manifest counts as one."""
    at = F.coalesce(F.expr("unix_micros(cast(modified_at as timestamp))"), F.lit(0)).cast("string")
    both = t.policies.select(F.col("policy_id").alias("manifest_id"), "modified_at", "deleted").unionByName(t.manifests.select("manifest_id", "modified_at", "deleted"))
    return compacted_manifests(both.withColumn("content", F.concat("manifest_id", F.lit("@"), at)))


@q("WITH l AS (SELECT policy_id, modified_at FROM policies WHERE policy_id IS NOT NULL AND policy_id NOT IN (SELECT policy_id FROM policies WHERE policy_id IS NOT NULL AND labels['policyType'] = 'host' AND labels['type'] = 'policy')) SELECT policy_id, modified_at FROM l UNION ALL SELECT 'new', timestamp '2025-01-01'")
def ix18_replace(t):
    """Replace all manifests that have some labels by one."""
    hit = t.policies.filter(P.label_match(F.col("labels"), {"type": "policy", "policyType": "host"})).select("policy_id").distinct()
    kept = t.policies.filter("policy_id is not null").select("policy_id", "modified_at").join(hit, "policy_id", "left_anti")
    return kept.unionByName(t.spark.sql("select 'new' policy_id, timestamp_ntz'2025-01-01 00:00:00' modified_at"))


# -- sorts and sets -----------------------------------------------------------------------------
@q("SELECT policy_id, labels['policyType'] kind, labels['hostname'] host, modified_at FROM policies WHERE labels IS NOT NULL ORDER BY kind, host, modified_at")
def st05_by_labels(t):
    at = lambda k: F.try_element_at("labels", F.lit(k))
    return t.policies.filter("labels is not null").select("policy_id", at("policyType").alias("kind"), at("hostname").alias("host"), "modified_at").orderBy("kind", "host", "modified_at")


@q(sql(DI, EN, "SELECT dir_oid, entry_name, (row_number() OVER (PARTITION BY dir_oid ORDER BY entry_type <> 'd', entry_name, object_id))::INT place FROM en WHERE entry_name IS NOT NULL AND entry_type IS NOT NULL AND object_id IS NOT NULL"))
def st06_folders_first(t):
    """Entries of a directory, folders first: ordered within the array, no window."""
    ok = F.filter("entries", lambda e: e["entry_name"].isNotNull() & e["entry_type"].isNotNull() & e["object_id"].isNotNull())
    keyed = F.array_sort(F.transform(ok, lambda e: F.struct((e["entry_type"] != "d").alias("a"), e["entry_name"].alias("entry_name"), e["object_id"].alias("o"))))
    return t.directories.select("dir_oid", F.posexplode(keyed).alias("p", "e")).select("dir_oid", "e.entry_name", (F.col("p") + 1).cast("int").alias("place"))


@q(sql(DI, EN, "SELECT dir_oid, min(entry_name) first_name, max(entry_name) last_name FROM en WHERE entry_name IS NOT NULL GROUP BY 1"))
def st07_by_name(t):
    names = F.transform(F.filter("entries", lambda e: e["entry_name"].isNotNull()), lambda e: e["entry_name"])
    return t.directories.select("dir_oid", F.array_min(names).alias("first_name"), F.array_max(names).alias("last_name")).filter("first_name is not null")


@q(sql(PO, LV, "tm AS (SELECT policy_id, leaf_pos, max(TRY_CAST(leaf_text AS INT)) FILTER (WHERE field_path LIKE '%hour') h, max(TRY_CAST(leaf_text AS INT)) FILTER (WHERE field_path LIKE '%min') m FROM lv WHERE field_path IN ('scheduling.timeOfDay.hour', 'scheduling.timeOfDay.min') GROUP BY ALL)", "SELECT policy_id, list_sort(list(DISTINCT h * 60 + coalesce(m, 0))) AS minutes FROM tm WHERE h IS NOT NULL GROUP BY 1"))
def st12_times_of_day(t):
    """Distinct times of day of each policy in order, as minutes."""
    leaves = nested.policy_leaves(nested.policy_nodes(t.policies)).filter(F.col("field_path").isin("scheduling.timeOfDay.hour", "scheduling.timeOfDay.min"))
    v = F.expr("try_cast(leaf_text as int)")
    per = leaves.groupBy("policy_id", "leaf_pos").agg(F.max(F.when(F.col("field_path").endswith("hour"), v)).alias("h"), F.max(F.when(F.col("field_path").endswith("min"), v)).alias("m"))
    return per.filter("h is not null").groupBy("policy_id").agg(F.array_sort(F.collect_set(F.col("h") * 60 + F.coalesce("m", F.lit(0)))).alias("minutes"))


@q(sql(SN, "d AS (SELECT host_name, max(start_time) + INTERVAL 6 HOUR due FROM sn WHERE host_name IS NOT NULL AND start_time IS NOT NULL GROUP BY 1)", "SELECT host_name, due FROM d WHERE due = (SELECT min(due) FROM d)"))
def st13_next_due(t):
    """Sources due next, all that tie."""
    d = t.snapshots.filter("host_name is not null and start_time is not null").groupBy("host_name").agg((F.max("start_time") + F.expr("interval 6 hours")).alias("due"))
    first = d.agg(F.min("due")).first()[0]
    return d.filter(F.col("due") == F.lit(first))


@q(_FAILED.replace("r <= 10", "r <= 3"))
def st11_examples(t):
    bad = t.snapshot_entries.filter("object_id is null and entry_path is not null").select("manifest_id", "entry_path").distinct()
    w = Window.partitionBy("manifest_id").orderBy("entry_path")
    return bad.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("manifest_id").agg(F.array_sort(F.collect_list("entry_path")).alias("failed"))


@q("SELECT manifest_id, modified_at, list_sort(list_distinct(list_concat(coalesce(pins, []), coalesce(retention_tags, [])))) names FROM manifests")
def se02_string_union(t):
    return t.manifests.select("manifest_id", "modified_at", P.merged_lists(F.col("pins"), F.col("retention_tags"), F.lit(False)).alias("names"))


@q("SELECT manifest_id, modified_at, list_filter(l, lambda x, i: list_position(l, x) = i) names FROM (SELECT manifest_id, modified_at, list_concat(coalesce(pins, []), coalesce(retention_tags, [])) l FROM manifests)")
def se03_ordered_dedupe(t):
    e = F.array().cast("array<string>")
    return t.manifests.select("manifest_id", "modified_at", F.array_distinct(F.concat(F.coalesce("pins", e), F.coalesce("retention_tags", e))).alias("names"))


_SAFE = r"CASE WHEN p = '/' THEN '__root' ELSE rtrim(rtrim(replace(replace(ltrim(replace(replace(p, ':/', '_'), ':\', '_'), '/'), '/', '_'), '\', '_'), '_'), ':') END"


@q(sql(SN, f"s AS (SELECT p, {_SAFE} safe FROM (SELECT DISTINCT source_path p FROM sn WHERE source_path IS NOT NULL))", "SELECT p AS name, CASE WHEN r > 1 THEN safe || ' (' || r || ')' ELSE safe END safe FROM (SELECT *, row_number() OVER (PARTITION BY lower(safe) ORDER BY p) r FROM s)"))
def se07_disambiguate(t):
    names = t.snapshots.filter("source_path is not null").select(F.col("source_path").alias("name")).distinct()
    return disambiguated(names.withColumn("safe", X.mount_name(F.col("name"))), "name", "safe")


# -- files --------------------------------------------------------------------------------------
@q()
def sc16_folder_scan(t):
    rows = sinks.scan_folder(t.spark, t.base, "*.parquet")
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@q("SELECT 'a/b.txt' path, 5::BIGINT length UNION ALL SELECT 'c.bin', 3")
def sc17_virtual_folder(t):
    return sinks.virtual_folder(t.spark, {"a/b.txt": b"hello", "c.bin": b"\0\1\2"}).select("path", "length")


@q("SELECT count(*) files, sum(strlen(text))::BIGINT bytes FROM documents WHERE text IS NOT NULL")
def sc19_archives(t):
    from moraine.session import scratch_path

    docs = t.documents.filter("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("p"), "text")
    return sinks.write_archives(docs, "p", "text", scratch_path(t.spark, "archives")).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.sum("bytes").alias("bytes"))


@q("SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 1 ELSE 0 END shallow, count(*) files, sum(strlen(text))::BIGINT bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sc19_restored_folder(t):
    """Texts written to a folder; those of three sources lie deeper and are left as placeholders."""
    from moraine.session import scratch_path

    deep = F.when(F.col("source").isin("src0", "src1", "src2"), "a/b/c/d").otherwise("a")
    docs = t.documents.filter("text is not null").select(F.concat_ws("/", deep, F.concat(F.lit("d"), "doc_id")).alias("p"), "text")
    done = materialise(sinks.restore(docs, "p", "text", scratch_path(t.spark, "restored"), depth=2), "restored")
    return done.groupBy(F.col("placeholder").cast("int").alias("shallow")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@q("SELECT * FROM (VALUES ('filesystem', 'file:///data/x'), ('s3', 's3a://b/x'), ('azure', 'abfss://b/x'), ('gcs', 'gs://b/x'), ('sftp', 'sftp://b/x'), ('b2', 's3a://b/x')) v(provider, address)")
def sc08_addresses(t):
    """Address of a path in each kind of store that Spark reads."""
    rows = [(p, sinks.address(p, "b", "/data/x" if p == "filesystem" else "x")) for p, scheme in sinks.SCHEMES.items() if scheme]
    return t.spark.createDataFrame(rows, "provider string, address string")
