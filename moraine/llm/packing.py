"""Texts of varying token length into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.session import materialise, spread

#: Items of one group on average; groups are packed independently.
GROUP_ITEMS = 20_000
#: Vocabulary file of the default tokenizer, found by the installed package of public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin number of each item. Items are taken by size, largest first (equal ones in the order
    given), each into the first bin with room, by a tournament tree over the room of the bins:
    a node holds the most room below it, so the first fitting bin is one descent away."""
    n = len(sizes)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = [0] * n
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        size = sizes[i]
        if size > capacity:
            raise ValueError(f"an item of {size} exceeds the capacity of {capacity}")
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out[i] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a > b else b
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return out


def _encoder(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of each text that isn't null, whole texts; an empty text has 0 tokens.
    ``vocabulary`` is a file of byte-pair ranks, by name or path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in batches:
            counts = [len(encoder.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pieces(counts: DataFrame, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """``container_id, capacity, doc_id, piece_no, token_from, n_tokens``: a text is one piece
    unless it is longer than the capacity; then it is cut after every ``capacity`` tokens."""
    kinds = F.array(*[F.struct(F.lit(i).cast("bigint").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities])
    rows = counts.select("doc_id", F.col("n_tokens").alias("_n"), F.explode(kinds).alias("_k")).select("doc_id", "_n", "_k.*")
    last = F.greatest(F.ceil(F.col("_n") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    cut = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece_no").cast("bigint") * F.col("capacity")
    return cut.select("container_id", "capacity", "doc_id", "piece_no", start.alias("token_from"), F.least(F.col("capacity"), F.col("_n") - start).alias("n_tokens"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
    pdf["bin_no"] = first_fit_decreasing(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))
    return pdf[["container_id", "group_no", "bin_no", "doc_id", "piece_no", "token_from", "n_tokens"]]


def packed(docs: DataFrame, containers: DataFrame, *, vocabulary: str = VOCABULARY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The container of every text or piece, for each kind of container.

    Columns ``container_id`` (the kind), ``group_no``, ``bin_no`` (together one container),
    ``doc_id, piece_no, token_from, n_tokens``. Pieces are dealt to groups by a hash of document
    and piece, which is random with regard to size, source and copies; groups of about
    ``group_items`` are packed by themselves, so each gives away at most its last containers.
    Null texts have no place, empty ones one with 0 tokens. Kinds with a null or non-positive
    capacity are ignored; there may be at most 1,000.
    """
    rows = containers.select("container_id", "capacity_tokens").filter("container_id is not null and capacity_tokens > 0").distinct().limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("more than 1,000 kinds of containers")
    schema = "container_id bigint, group_no int, bin_no int, doc_id bigint, piece_no int, token_from bigint, n_tokens bigint"
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    counts = materialise(token_counts(docs, vocabulary=vocabulary), "tokens")
    items = pieces(counts, sorted((r.container_id, r.capacity_tokens) for r in rows))
    per_kind = items.groupBy("container_id").agg(F.ceil(F.count(F.lit(1)) / group_items).alias("_groups")).collect()
    groups = F.coalesce(*[F.when(F.col("container_id") == r.container_id, F.lit(int(r._groups))) for r in per_kind], F.lit(1))
    dealt = items.withColumn("group_no", F.pmod(F.xxhash64("doc_id", "piece_no"), groups).cast("int"))
    return dealt.groupBy("container_id", "group_no").applyInPandas(_pack, schema)


def fill(packing: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens and the share of the room that is used."""
    used = packing.groupBy("container_id", "group_no", "bin_no").agg(F.sum("n_tokens").alias("t")).groupBy("container_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    return used.join(containers.select("container_id", "capacity_tokens"), "container_id").select("container_id", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))
