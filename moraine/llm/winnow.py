"""Evaluation texts in training texts, by winnowing.

Every text becomes a sequence of word hashes. Of every window of ``WINDOW`` consecutive k-grams
of ``K`` words the least hash is kept, in items and documents alike, so that any run of
``K + WINDOW - 1`` = 6 equal words leaves a common fingerprint. A stretch of 18 or more item words
with at most one edit in eight words always holds such a run: e edits leave e + 1 runs, and
7e / (e + 1) exceeds 5 from e = 2 on.

A stretch of 36 or more words can be halved, and one half has at most one edit in eight words
again. So a document holds a case if and only if it holds one of 18 to 35 item words, which takes
at most 39 words of the document. Items are cut into segments and documents into regions that
overlap by that much; every case lies within one segment and one region. Both are of bounded
length, whatever the texts are, and so is the extension of a shared fingerprint, which decides
exactly.

Documents are read once. The fingerprints of the items become a bit field of bounded size; only
regions with a fingerprint in it are kept, with their words. The two sides then meet in a join on
the fingerprint, the document side salted, so that one that a third of all documents have is
spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.words import Vocabulary, folded, words
from moraine.session import materialise, shuffle_partitions, spread

K, WINDOW = 4, 3
#: Fewest consecutive item words of a case, and item words per edit.
LEAST, PER_EDIT = 18, 8
#: Most item words of a case that cannot be halved, its most edits, and its most document words.
MOST = 2 * LEAST - 1
EDITS = MOST // PER_EDIT
SPAN = MOST + EDITS
#: Equal words that every case holds in a row.
RUN = K + WINDOW - 1
#: Words from the start of one segment or region to the next; each is longer by what overlaps.
SEGMENT, REGION = 64, 192
#: Tasks that the documents with one fingerprint, or the regions that meet one segment, are spread over.
SALTS = 16
#: Bits per fingerprint and most bits (16 MB) of the field; beyond it more regions are kept than need be.
BITS_EACH, BITS_MOST = 16, 1 << 27
#: Words of documents that are hashed at once.
BLOCK_WORDS = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` words; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            g = (g ^ h[i : i + n]) * _MULTIPLIER
            g ^= g >> np.uint64(29)
    return g


def fingerprint(g: np.ndarray, valid: np.ndarray | None = None, w: int = WINDOW) -> np.ndarray:
    """Places of the least k-gram of every window, the last one of equals. ``valid`` marks the
    windows that count, by their first k-gram."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for i in range(1, w):
        nxt = g[i : i + n]
        less = nxt <= best
        best[less] = nxt[less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at if valid is None else at[valid])


def fingerprints(lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts of ``lengths`` words whose hashes follow each other in ``h``: places
    in ``h`` and their hashes. Windows across two texts don't count."""
    if len(h) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    g = grams(h)
    at = fingerprint(g, text[: len(h) - RUN + 1] == text[RUN - 1 :])
    return at, g[at]


def bits(fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each fingerprint in a field of ``size`` bits, a power of two."""
    mask = np.uint64(size - 1)
    return (fp & mask).astype(np.int64), ((fp >> np.uint64(32)) & mask).astype(np.int64)


def present(field: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """May the fingerprints be in the bit field (64-bit words)?"""
    out = np.ones(len(fp), bool)
    for b in bits(fp, len(field) * 64):
        out &= (field[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def aligned(doc: np.ndarray, item: np.ndarray, least: int = LEAST, per_edit: int = PER_EDIT) -> bool:
    """Does some stretch of ``doc`` follow ``least`` or more consecutive words of ``item`` with at
    most one edit (replaced, dropped or added word) per ``per_edit`` item words?

    ``now[i, j]`` is the longest run of item words ending before word i that aligns with a
    stretch ending before document word j with e edits. By halving, stretches of fewer than twice
    ``least`` words decide, so e goes no further than theirs.
    """
    n, m = len(item), len(doc)
    if n < least or m == 0:
        return False
    same = item[:, None] == doc[None, :]
    none = np.int32(-(1 << 20))
    before: np.ndarray | None = None
    for e in range(min(n, 2 * least - 1) // per_edit + 1):
        now = np.zeros((n + 1, m + 1), np.int32) if e == 0 else np.full((n + 1, m + 1), none, np.int32)
        if before is not None:
            now[1:, 1:] = before[:-1, :-1] + 1
            np.maximum(now[1:, :], before[:-1, :] + 1, out=now[1:, :])
            np.maximum(now[:, 1:], before[:, :-1], out=now[:, 1:])
        for i in range(n):
            step = np.where(same[i], now[i, :-1] + 1, none)
            np.maximum(now[i + 1, 1:], step, out=now[i + 1, 1:])
        if now.max() >= max(least, per_edit * e):
            return True
        before = now
    return False


def _runs(same: np.ndarray, length: int) -> np.ndarray:
    """Where runs of ``length`` equal words begin: (item word, document word) as a matrix."""
    n, m = same.shape[0] - length + 1, same.shape[1] - length + 1
    if n <= 0 or m <= 0:
        return np.zeros((0, 0), bool)
    out = same[:n, :m].copy()
    for i in range(1, length):
        out &= same[i : i + n, i : i + m]
    return out


def holds(region: np.ndarray, segment: np.ndarray) -> bool:
    """Is there a case in ``region`` of ``segment``? Whole runs are seen at once. Else every case
    lies within ``EDITS`` of the diagonal of one of its runs of six equal words, and each 18 item
    words of it have at most ``EDITS`` without an equal word that near; only item words for which
    that holds are aligned."""
    n, m = len(segment), len(region)
    if n < LEAST:
        return False
    same = segment[:, None] == region[None, :]
    seeds = _runs(same, RUN)
    if not seeds.any():
        return False
    if _runs(same, LEAST).any():
        return True
    i, j = np.nonzero(seeds)
    item, near = np.arange(n)[:, None], np.arange(-EDITS, EDITS + 1)[None, :]
    for d in np.unique(j - i).tolist():
        at = item + near + d
        there = (same[item, np.clip(at, 0, m - 1)] & (at >= 0) & (at < m)).any(1)
        c = np.concatenate(([0], np.cumsum(there)))
        good = np.flatnonzero(c[LEAST:] - c[:-LEAST] >= LEAST - EDITS)
        if len(good):
            lo, hi = int(good[0]), int(good[-1]) + LEAST
            if aligned(region[max(0, lo + d - EDITS) : hi + d + EDITS], segment[lo:hi]):
                return True
    return False


def _item_words(items: DataFrame) -> DataFrame:
    """``item_id, words``: distinct items without an opening instruction.

    The opening is an item's first sentence; it is an instruction if items that go on differently
    share it and it has no number in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, whole, opening = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = folded(t)
                ends = [head.find(x) for x in (". ", ".\n", "! ", "? ") if head.find(x) >= 0]
                first = words(t[: min(ends) + 1]) if ends else []
                every = words(t)
                ids.append(i)
                whole.append(every)
                opening.append(" ".join(first) if first == every[: len(first)] and not any(w.isdigit() for w in first) else "")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole, pa.list_(pa.string())), pa.array(opening, pa.string())], names=["item_id", "words", "opening"])

    rows = items.select(F.col("item_id").cast("bigint"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct().mapInArrow(run, "item_id bigint, words array<string>, opening string")
    rows = materialise(rows, "items")
    # Least and greatest differ if two items differ: partial results instead of all texts of an opening.
    told = F.xxhash64("words")
    shared = rows.filter("opening != ''").groupBy("opening").agg(F.min(told).alias("_a"), F.max(told).alias("_b")).filter("_a != _b").select("opening", F.lit(True).alias("_shared"))
    skip = F.when(F.col("_shared"), F.size(F.split("opening", " "))).otherwise(F.lit(0))
    return rows.join(shared, "opening", "left").select("item_id", F.slice("words", skip + 1, F.greatest(F.size("words"), F.lit(1))).alias("words"))


def item_segments(items: DataFrame) -> DataFrame:
    """``item_id, segment, words, fps``: word hashes and fingerprints of each segment. Fingerprints
    are those of the whole item. ``segment`` tells pieces of an item's texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for i, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = vocabulary.hashes(tokens)
                at, fp = fingerprints(np.array([len(h)]), h)
                for start in range(0, max(1, len(h) - MOST + SEGMENT), SEGMENT):
                    piece = h[start : start + SEGMENT + MOST]
                    lo, hi = np.searchsorted(at, [start, start + len(piece) - K + 1])
                    if len(piece) >= LEAST and hi > lo:
                        for c, v in zip(cols, (i, int(vocabulary.of_bytes(piece)), piece.view(np.int64), np.unique(fp[lo:hi]).view(np.int64)), strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "segment", "words", "fps"])

    return _item_words(items).mapInArrow(run, "item_id bigint, segment bigint, words array<bigint>, fps array<bigint>")


def bit_field(segments: DataFrame) -> np.ndarray:
    """Bits of all fingerprints, at most ``BITS_MOST`` of them, made by partial aggregation; what
    reaches the driver is the field, of bounded size."""
    n = segments.agg(F.sum(F.size("fps"))).first()[0] or 0
    size = 1 << 16
    while size < min(n * BITS_EACH, BITS_MOST):
        size *= 2
    fp = segments.select(F.explode("fps").alias("f"))
    bit = F.explode(F.array(F.col("f").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("f", 32).bitwiseAND(F.lit(size - 1)))).alias("b")
    at = fp.select(bit).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("held"))
    field = np.zeros(size // 64, np.int64)
    rows = at.toPandas()
    field[rows["at"].to_numpy(np.int64)] = rows["held"].to_numpy(np.int64)
    return field.view(np.uint64)


def document_regions(docs: DataFrame, field: np.ndarray) -> DataFrame:
    """``doc_id, region, words, fps``: word hashes of the regions of each document that have a
    fingerprint in the field, and those fingerprints."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def block(ids: list[int], hashes: list[np.ndarray], cols: list[list]) -> None:
        lengths = np.array([len(h) for h in hashes])
        h, starts = np.concatenate(hashes), np.concatenate(([0], np.cumsum(lengths)))
        at, fp = fingerprints(lengths, h)
        hit = present(sent.value, fp)
        at, fp = at[hit], fp[hit]
        of = np.searchsorted(starts, at, "right") - 1
        for d in np.unique(of):
            lo, hi = np.searchsorted(of, [d, d + 1])
            places, own, text = at[lo:hi] - starts[d], fp[lo:hi], hashes[d]
            last = places // REGION
            shared = places[(last > 0) & (places - last * REGION <= SPAN - K)] // REGION - 1
            for r in np.unique(np.concatenate((shared, last))):
                a = int(r) * REGION
                inside = (places >= a) & (places <= a + REGION + SPAN - K)
                piece = text[a : a + REGION + SPAN]
                if len(piece) >= LEAST - EDITS and inside.any():
                    for c, v in zip(cols, (ids[d], int(Vocabulary.of_bytes(piece)), piece.view(np.int64), np.unique(own[inside]).view(np.int64)), strict=True):
                        c.append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            ids, hashes, n = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = vocabulary.hashes(words(t.as_py()))
                if len(h) < RUN:
                    continue
                ids.append(d)
                hashes.append(h)
                n += len(h)
                if n >= BLOCK_WORDS:
                    block(ids, hashes, cols)
                    ids, hashes, n = [], [], 0
            if ids:
                block(ids, hashes, cols)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "region", "words", "fps"])

    return spread(docs).mapInArrow(run, "doc_id bigint, region bigint, words array<bigint>, fps array<bigint>")


def _extended(pairs: DataFrame) -> DataFrame:
    """``doc_id, segment`` of the pairs of a region and a segment that hold a case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for c in (b.column(2), b.column(3)):
                sides += [c.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))))]
            doc, d, item, i = sides
            keep = pa.array([holds(doc[d[k] : d[k + 1]], item[i[k] : i[k + 1]]) for k in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["doc_id", "segment"])

    return pairs.select("doc_id", "segment", "_words", "words").mapInArrow(run, "doc_id bigint, segment bigint")


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id``: documents holding a stretch of an item, distinct.

    Null texts and ids, and items or documents shorter than the least stretch, give nothing. An
    item id with several texts counts for each of them, and so does a document id. Segments of one
    content are one segment until cases are found, however many items hold it.
    """
    segments = materialise(item_segments(items), "segments")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    regions = materialise(document_regions(rows, bit_field(segments)), "regions")
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    held = segments.select("segment", F.explode("fps").alias("fp")).distinct().select("segment", "fp", salts)
    pairs = regions.select("doc_id", "region", F.explode("fps").alias("fp"), salt("doc_id", "region")).join(held, ["fp", "salt"]).select("doc_id", "region", "segment").distinct()
    both = pairs.join(regions.dropDuplicates(["doc_id", "region"]).select("doc_id", "region", F.col("words").alias("_words")), ["doc_id", "region"])
    once = segments.dropDuplicates(["segment"]).select("segment", "words", salts)
    met = both.select("doc_id", "segment", "_words", salt("doc_id", "region")).join(once, ["segment", "salt"])
    # Few bytes, but much work for each: as many tasks as any shuffle has, whatever their size.
    cases = _extended(met.repartition(shuffle_partitions(docs.sparkSession))).distinct()
    named = segments.select("item_id", "segment").distinct().select("item_id", "segment", salts)
    return cases.select("doc_id", "segment", salt("doc_id")).join(named, ["segment", "salt"]).select("doc_id", "item_id").distinct()
