"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit prefixes and histogram thresholds.
PREFIXES_10 = ["", "K", "M", "G", "T", "P", "E"]
PREFIXES_2 = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei"]
SIZE_THRESHOLDS = [100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000]
IO_LATENCY_US = [500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000]
CPU_LATENCY_US = [10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000]


def one_decimal(value: Column) -> Column:
    """A number of at least 0 with one decimal, rounded by its exact binary value, ties to even."""
    whole = F.floor(value)
    tenths = ((value - whole) * float(1 << 52)).cast("bigint") * 10
    q, r = F.shiftright(tenths, 52), tenths.bitwiseAND((1 << 52) - 1)
    up = F.when((r > 1 << 51) | ((r == 1 << 51) & (q % 2 == 1)), 1).otherwise(0)
    t = whole * 10 + q + up
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def unit_string(value: Column, suffix: str = "B", base: int = 1000) -> Column:
    """Number with the first unit in which it is below nine tenths of the next (SF01, SF02), one
    decimal at most."""
    prefixes = PREFIXES_10 if base == 1000 else PREFIXES_2
    v = value.cast("double")
    out = None
    for i, p in enumerate(prefixes):
        scaled = v / float(base**i)
        text = F.concat(F.regexp_replace(one_decimal(scaled), r"\.0$", ""), F.lit(f" {p}{suffix}"))
        if i == len(prefixes) - 1:
            return out.otherwise(text)
        cond = scaled < 0.9 * base
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def compression_percent(original: Column, packed: Column) -> Column:
    """Share saved with one decimal, ``0%`` if nothing was (SF03)."""
    return F.when((packed >= original) | (original == 0), "0%").otherwise(F.concat(one_decimal(F.lit(100.0) * (F.lit(1.0) - packed / original)), F.lit("%")))


def parsed_source(text: Column) -> Column:
    """``user@host:path``, ``user@host``, ``@host`` or ``(global)`` as a struct of host, user and
    path (SF04); what isn't one of them gives null."""
    whole = r"^([^@:]*)@([^:]+)(?::(.*))?$"
    s = F.struct(F.regexp_extract(text, whole, 2).alias("host"), F.regexp_extract(text, whole, 1).alias("user"), F.regexp_extract(text, whole, 3).alias("path"))
    empty = F.struct(F.lit("").alias("host"), F.lit("").alias("user"), F.lit("").alias("path"))
    return F.when(text == "(global)", empty).when(text.rlike(whole), s)


def source_string(user: Column, host: Column, path: Column) -> Column:
    """The text form of a source; null parts count as empty."""
    u, h, p = (F.coalesce(c, F.lit("")) for c in (user, host, path))
    return F.when((u == "") & (h == "") & (p == ""), "(global)").otherwise(F.concat(u, F.lit("@"), h, F.when(p != "", F.concat(F.lit(":"), p)).otherwise("")))


def epoch_number(blob_id: Column) -> Column:
    """Epoch of ``<prefix><number>_<rest>`` (SF05), null if there is none."""
    digits = F.regexp_extract(F.substring_index(blob_id, "_", 1), r"^\D*(\d+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def epoch_range(blob_id: Column) -> Column:
    """Epochs of ``<prefix><from>_<to>_<rest>`` as a struct (SF05)."""
    shape = r"^\D*(\d+)_(\d+)_"
    return F.when(blob_id.rlike(shape), F.struct(F.regexp_extract(blob_id, shape, 1).cast("int").alias("lo"), F.regexp_extract(blob_id, shape, 2).cast("int").alias("hi")))


def content_prefix(content_id: Column) -> Column:
    """Letter g to z in front of a content id of odd length (SF07); null for ids that are no
    content ids."""
    ok = content_id.rlike("^[g-z]?(?:[0-9a-f]{2}){1,32}$")
    return F.when(ok, F.regexp_extract(content_id, "^([g-z]?)", 1))


def object_parts(oid: Column) -> Column:
    """Indirections, compression mark and content id of an object id (SF07, MS06)."""
    shape = "^(I*)(Z?)(D?)(.*)$"
    part = lambda i: F.regexp_extract(oid, shape, i)
    return F.struct(F.length(part(1)).alias("indirections"), (part(2) == "Z").alias("compressed"), part(4).alias("content_id"))


def mode_bits(mode: Column) -> Column:
    """Octal text as a number (SF08)."""
    return F.conv(F.regexp_replace(F.lower(mode), "^0o", ""), 8, 10).cast("int")


def mount_name(path: Column) -> Column:
    """A path as a file name (SF10)."""
    p = F.regexp_replace(F.regexp_replace(path, ":/", "_"), r":\\", "_")
    p = F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"[/\\]", "_")
    p = F.regexp_replace(F.regexp_replace(p, "_+$", ""), ":+$", "")
    return F.when(path == "/", "__root").otherwise(p)


def period_start(t: Column, unit: str) -> Column:
    """Begin of the hour, day, week (from ``sunday`` or ``monday``), month, quarter or year (SF12)."""
    if unit == "sunday":
        day = F.make_dt_interval(F.lit(1))
        return F.date_trunc("week", t + day).cast("timestamp_ntz") - day
    return F.date_trunc("week" if unit == "monday" else unit, t).cast("timestamp_ntz")


def next_period(t: Column, unit: str) -> Column:
    """Begin of the period after the one ``t`` lies in."""
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    start = period_start(t, unit)
    if months:
        return start + F.make_ym_interval(F.lit(0), F.lit(months))
    hours = {"hour": 1, "day": 24, "sunday": 168, "monday": 168}[unit]
    return start + F.make_dt_interval(F.lit(0), F.lit(hours))


def bucket(value: Column, thresholds: Sequence[int]) -> Column:
    """Number of thresholds below the value (SF13); null for null."""
    return F.when(value.isNotNull(), F.size(F.filter(F.array(*[F.lit(x) for x in thresholds]), lambda x: x < value)))


def next_interval(previous: Column, now: Column, seconds: int) -> Column:
    """Next run of an interval schedule (SF14) in Unix seconds: the previous run plus the interval,
    down to a whole multiple, but not before now."""
    return F.greatest(F.floor((previous + seconds) / F.lit(seconds)) * seconds, now)


def next_time_of_day(now: Column, minutes: Sequence[int]) -> Column:
    """Next of several times of day, as minutes, in Unix seconds of UTC (SF14)."""
    day = F.floor(now / 86_400) * 86_400
    options = [F.when(now > day + m * 60, day + m * 60 + 86_400).otherwise(day + m * 60) for m in minutes]
    return F.least(*options) if len(options) > 1 else options[0]


def cron_next(expression: str, now):
    """Next minute after ``now`` that a five-field cron line names (SF14), or None within 8 years.
    Lists, ranges and steps are known; day of month and day of week are alternatives if both are set."""
    import datetime as dt

    bounds = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    fields = expression.split("#")[0].split()
    if len(fields) != 5:
        raise ValueError(f"not a cron line: {expression!r}")

    def values(field, lo, hi):
        out = set()
        for part in field.split(","):
            body, _, step = part.partition("/")
            if body == "*":
                a, b = lo, hi
            elif "-" in body:
                a, b = map(int, body.split("-"))
            else:
                a = int(body)
                b = hi if step else a
            if not lo <= a <= b <= hi:
                raise ValueError(f"not a cron line: {expression!r}")
            out.update(range(a, b + 1, int(step or 1)))
        return out

    minute, hour, dom, month, dow = (values(f, *b) for f, b in zip(fields, bounds, strict=True))
    dow = {d % 7 for d in dow}
    free = fields[2].startswith("*"), fields[4].startswith("*")
    day = now.date()
    for _ in range(8 * 366):
        by_month, by_week = day.day in dom, day.isoweekday() % 7 in dow
        if day.month in month and (by_month and by_week if any(free) else by_month or by_week):
            for h in sorted(hour):
                for m in sorted(minute):
                    t = dt.datetime.combine(day, dt.time(h, m))
                    if t > now:
                        return t
        day += dt.timedelta(days=1)
    return None


def tags(text: Column) -> Column:
    """``key:value`` lines as a map of ``tag:key`` (MS02); a key twice is an error."""
    return F.map_from_entries(F.transform(text, lambda x: F.struct(F.concat(F.lit("tag:"), F.substring_index(x, ":", 1)), F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x)))))


def watermark_time(blob_id: Column) -> Column:
    """Unix seconds in the id of a deletion watermark, ``xw`` and digits (SF05); null for others."""
    return F.regexp_extract(blob_id, "^xw([0-9]+)", 1).try_cast("bigint")


def relative_path(base: Column, path: Column) -> Column:
    """Path below a folder (SF09): ``.`` for the folder itself, null for what doesn't lie in it."""
    root = F.regexp_replace(base, "(?<=.)[/\\\\]+$", "")
    inside = F.when(root.isin("/", ""), F.concat(F.lit("/"), F.regexp_replace(path, "^/", ""))).otherwise(F.substring(path, F.length(root) + 1, F.length(path)))
    below = F.when(root.isin("/", ""), path.startswith("/")).otherwise(F.startswith(path, root) & inside.rlike("^[/\\\\]"))
    return F.when(path == root, ".").when(below, F.substring(inside, 2, F.length(inside)))


def fnv32a(text: Column) -> Column:
    """32-bit FNV-1a hash of a text's UTF-8 bytes (SF16)."""
    raw = F.hex(F.encode(text, "utf-8"))
    byte = lambda i: F.conv(F.substring(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.when(text.isNotNull(), places), F.lit(2_166_136_261).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16_777_619).bitwiseAND(F.lit(0xFFFFFFFF)))


def next_run(previous, now, interval=None, times=(), cron=(), manual=False, run_missed=False):
    """Next run of a schedule (SF14) as a time, or None: the earliest of the interval's, of the times
    of day (minutes) and of the cron lines, which may be unreadable. With ``run_missed`` a time of day
    or cron line that fell between the previous run and now is made up for at once, unless the next
    run is within half an hour. A source without a previous run counts from 1970."""
    import datetime as dt

    if manual:
        return None
    previous = previous or dt.datetime(1970, 1, 1)

    def named(after):
        found = []
        for m in times:
            t = dt.datetime.combine(after.date(), dt.time(m // 60, m % 60))
            found.append(t + dt.timedelta(days=1) if after > t else t)
        for line in cron:
            try:
                found.append(cron_next(line, after))
            except ValueError:
                continue
        return min((t for t in found if t), default=None)

    options = []
    if interval:
        seconds = int((previous - dt.datetime(1970, 1, 1)).total_seconds() + interval) // interval * interval
        options.append(max(now, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)))
    options += [t for t in [named(now)] if t]
    if not options:
        return None
    nxt = min(options)
    if run_missed:
        missed = named(previous + dt.timedelta(seconds=1))
        if missed and missed < now and nxt > now + dt.timedelta(minutes=30):
            return now
    return nxt
