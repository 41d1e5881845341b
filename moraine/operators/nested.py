"""Nested JSON records to linked flat rows, on the structural index of ``functions.jsonindex``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions import jsonindex as J
from moraine.operators.state import state_rows

SECTIONS = ("retention", "scheduling", "files", "osSnapshots")
LISTS = ("ignore", "ignoreDotFiles", "timeOfDay", "cron")

NODE_SCHEMA = "record_id string, node_id int, parent_id int, field_path string, leaf_pos bigint, node_kind string, node_text string"
_ARROW = pa.schema([("record_id", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("field_path", pa.string()), ("leaf_pos", pa.int64()), ("node_kind", pa.string()), ("node_text", pa.string())])
_NAMES = {J.OPEN_OBJ: "object", J.OPEN_ARR: "list", J.STRING: "string"}
#: Bytes of text that are indexed at once; a longer single text is indexed alone.
BLOCK_BYTES = 4 << 20


def _clean(text: str) -> str:
    """Lone surrogates cannot be stored; each becomes U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _unquoted(texts: list[bytes | None]) -> tuple[J.Nodes, list[bytes]]:
    """Index; texts that are one JSON string are replaced by what it holds and indexed again, until
    none is: each time the text gets shorter."""
    now = [t or b"" for t in texts]
    nodes = J.index(now)
    while True:
        roots = np.flatnonzero((nodes.parent == -1) & (nodes.kind == J.STRING))
        if not len(roots):
            return nodes, now
        for i in roots:
            now[nodes.doc[i]] = _clean(nodes.text(i)).encode()
        nodes = J.index(now)


class _Rows:
    """Flat rows under construction: one entry per column."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _ARROW]

    def add(self, *values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW, strict=True)], schema=_ARROW)


def _flatten(ids: list[str], texts: list[bytes | None], sections: Sequence[str] | None, lists: Sequence[str]) -> pa.RecordBatch:
    nodes, _ = _unquoted(texts)
    rows = _Rows()
    n = len(nodes.doc)
    paths: list[str | None] = [None] * n
    places = [-1] * n
    numbers = [0] * n
    links = [-1] * n
    counter: dict[int, int] = {}
    quoted: list[tuple[int, int]] = []  # sections given as strings: (document, node)
    live = _last_of_name(nodes)
    roots_ok = {int(nodes.doc[i]) for i in np.flatnonzero((nodes.parent == -1) & (nodes.kind == J.OPEN_OBJ))}
    for i in range(n):
        d, p = int(nodes.doc[i]), int(nodes.parent[i])
        if d not in roots_ok or not live[i]:
            continue
        key = nodes.key[i]
        if p < 0:
            paths[i] = ""
            numbers[i] = counter[d] = 0
            rows.add(ids[d], 0, None, "", -1, "object", None)
            continue
        if paths[p] is None:
            continue
        top = paths[p] == "" and nodes.parent[p] < 0
        if top and sections is not None and key not in sections:
            continue
        paths[i] = key if top else paths[p] if key is None else f"{paths[p]}.{key}"
        place = int(nodes.place[i])
        if place < 0:
            place = 0 if key in lists and nodes.kind[i] != J.OPEN_ARR else places[p]
        elif nodes.kind[p] == J.OPEN_ARR and nodes.kind[i] == J.OPEN_ARR:
            place = place
        places[i] = place
        if top and sections is not None and nodes.kind[i] == J.STRING:
            quoted.append((d, i))
            continue
        _emit(rows, ids[d], nodes, i, p, paths, places, numbers, counter, d)
    if quoted:
        _sections(rows, ids, nodes, quoted, counter, lists)
    return rows.batch()


def _emit(rows, record, nodes, i, p, paths, places, numbers, counter, d) -> None:
    counter[d] += 1
    numbers[i] = counter[d]
    kind = int(nodes.kind[i])
    if kind == J.ATOM:
        text = nodes.text(i)
        name = "null" if text == "null" else "bool" if text in ("true", "false") else "number"
        rows.add(record, numbers[i], numbers[p], _clean(paths[i]), places[i], name, None if name == "null" else text)
    else:
        rows.add(record, numbers[i], numbers[p], _clean(paths[i]), places[i], _NAMES[kind], _clean(nodes.text(i)) if kind == J.STRING else None)


def _sections(rows, ids, nodes, quoted, counter, lists) -> None:
    """Sections that came as JSON strings: what the string holds takes the section's place; a
    string that isn't JSON is a plain value of that name."""
    held, _ = _unquoted([_clean(nodes.text(i)).encode() for _, i in quoted])
    n = len(held.doc)
    paths: list[str | None] = [None] * n
    places, numbers = [-1] * n, [0] * n
    live = _last_of_name(held)
    for k, (d, i) in enumerate(quoted):
        if not held.valid[k]:
            counter[d] += 1
            rows.add(ids[d], counter[d], 0, _clean(nodes.key[i]), -1, "string", _clean(nodes.text(i)))
    for j in range(n):
        d, i = quoted[int(held.doc[j])]
        p = int(held.parent[j])
        if not live[j] or p >= 0 and paths[p] is None:
            continue
        key = held.key[j]
        paths[j] = nodes.key[i] if p < 0 else paths[p] if key is None else f"{paths[p]}.{key}"
        place = int(held.place[j])
        if place < 0:
            place = (0 if key in lists and held.kind[j] != J.OPEN_ARR else places[p]) if p >= 0 else -1
        places[j] = place
        if p < 0:
            counter[d] += 1
            numbers[j] = counter[d]
            kind = int(held.kind[j])
            text = held.text(j) if kind in (J.ATOM, J.STRING) else None
            name = _NAMES.get(kind) or ("null" if text == "null" else "bool" if text in ("true", "false") else "number")
            rows.add(ids[d], numbers[j], 0, _clean(paths[j]), -1, name, None if name == "null" else text)
        else:
            _emit(rows, ids[d], held, j, p, paths, places, numbers, counter, d)


def _last_of_name(nodes: J.Nodes) -> np.ndarray:
    """Of values with one name in one object only the last one counts."""
    live = np.ones(len(nodes.doc), dtype=bool)
    seen: dict[tuple[int, str], int] = {}
    for i in range(len(nodes.doc)):
        if nodes.key[i] is not None:
            k = (int(nodes.parent[i]), nodes.key[i])
            if k in seen:
                live[seen[k]] = False
            seen[k] = i
    return live


def nested_nodes(df: DataFrame, key: str, text: str, sections: Sequence[str] | None = None, lists: Sequence[str] = ()) -> DataFrame:
    """Every value of every JSON object in ``text`` as a row linked to the one it lies in.

    Columns: ``record_id``, ``node_id`` (0 is the record's root), ``parent_id``, ``field_path``
    (names joined with dots; list elements have their list's path), ``leaf_pos`` (0-based place
    in the nearest list, -1 outside), ``node_kind`` (object, list, string, number, bool, null),
    ``node_text`` (scalars only). ``sections`` limits the names of the first level; one given as
    a quoted JSON string counts as what it holds, and so does a whole text. A bare value named in
    ``lists`` is a list of one. Null, empty, damaged or non-object texts give no rows; of repeated
    names in one object the last counts.
    """
    cols = df.select(F.col(key).cast("string").alias("record_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()
            at = 0
            while at < len(ids):
                to, total = at, 0
                while to < len(ids) and (to == at or total + len(texts[to] or b"") <= BLOCK_BYTES):
                    total += len(texts[to] or b"")
                    to += 1
                yield _flatten(ids[at:to], texts[at:to], sections, lists)
                at = to

    return cols.mapInArrow(run, NODE_SCHEMA)


def policy_nodes(policies: DataFrame) -> DataFrame:
    """Linked rows of the four sections of every live policy (state row by ``modified_at``)."""
    state = state_rows(policies, "policy_id", "modified_at", ["payload"]).filter(~F.col("deleted") & F.col("payload").isNotNull())
    return nested_nodes(state, "policy_id", "payload", SECTIONS, LISTS)


def policy_leaves(nodes: DataFrame) -> DataFrame:
    """Non-null scalar values: ``policy_id, field_path, leaf_pos, leaf_text``, distinct."""
    leaves = nodes.filter(F.col("node_kind").isin("string", "number", "bool"))
    return leaves.select(F.col("record_id").alias("policy_id"), "field_path", "leaf_pos", F.col("node_text").alias("leaf_text")).distinct()
