"""Structural index of many JSON texts at once.

All texts of a batch lie in one byte buffer. Bitmaps of quotes, brackets and delimiters are built
over the whole buffer, string spans come from the parity of a prefix sum over the quotes, nesting
depth from a prefix sum over the brackets, and every text is checked against the JSON grammar by
looking at neighbouring tokens. Nothing walks a text character by character.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

# Token kinds.
OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA_OBJ, COMMA_ARR, KEY, STRING, ATOM = range(10)

_VALUE_START, _VALUE_END = (OPEN_OBJ, OPEN_ARR, STRING, ATOM), (CLOSE_OBJ, CLOSE_ARR, STRING, ATOM)
_NEXT = np.zeros((10, 10), dtype=bool)
for _a, _bs in {OPEN_OBJ: (KEY, CLOSE_OBJ), OPEN_ARR: (*_VALUE_START, CLOSE_ARR), KEY: (COLON,), COLON: _VALUE_START, COMMA_OBJ: (KEY,), COMMA_ARR: _VALUE_START}.items():
    _NEXT[_a, list(_bs)] = True
for _a in _VALUE_END:
    _NEXT[_a, [COMMA_OBJ, COMMA_ARR, CLOSE_OBJ, CLOSE_ARR]] = True

_ATOM = re.compile(rb"true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(rb'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^\\]', re.S)


@dataclass
class Nodes:
    """One row per value, in text order: its text's number, the number of the value it lies in
    (-1 for a whole text), its key, its place in the nearest list (-1 outside lists), its kind
    and the bytes it spans."""

    doc: np.ndarray
    parent: np.ndarray
    key: np.ndarray  # object array: str or None
    place: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buffer: bytes
    valid: np.ndarray  # per text: one whole JSON value

    def text(self, i: int) -> str:
        """A scalar's text: strings unescaped, others as written."""
        raw = self.buffer[self.start[i] : self.end[i]]
        if self.kind[i] != STRING:
            return raw.decode()
        return json.loads(raw) if b"\\" in raw else raw[1:-1].decode()


def _shift(a: np.ndarray, first) -> np.ndarray:
    return np.concatenate(([first], a[:-1])) if len(a) else a


def index(texts: list[bytes]) -> Nodes:
    """Index a batch. Texts that aren't one whole JSON value are marked invalid and have no nodes."""
    n_docs = len(texts)
    buffer = b"\n".join(texts) + b"\n"
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, n_docs)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if n_docs else np.empty(0, np.int64)
    buf = np.frombuffer(buffer, np.uint8) if n_docs else np.empty(0, np.uint8)
    pos = np.arange(len(buf))
    doc_of = np.repeat(np.arange(n_docs), sizes)
    bad = np.zeros(n_docs, dtype=bool)

    # Escapes: a byte is escaped if an odd run of backslashes ends just before it.
    slash = buf == 0x5C
    run_start = np.maximum.accumulate(np.where(~slash, pos, -1))
    escaped = _shift(slash & ((pos - run_start) % 2 == 1), False)
    quote = (buf == 0x22) & ~escaped
    seen = np.cumsum(quote)
    base = np.concatenate(([0], seen))[starts] if n_docs else seen
    inside = (seen - base[doc_of]) % 2 == 1  # from an opening quote to the byte before the closing one
    text = inside | quote
    totals = np.bincount(doc_of[quote], minlength=n_docs)
    bad |= totals % 2 == 1
    bad[doc_of[slash & ~inside]] = True
    bad[doc_of[(buf < 0x20) & inside]] = True

    structural = ~text & np.isin(buf, np.frombuffer(b"{}[]:,", np.uint8))
    blank = np.isin(buf, np.frombuffer(b" \t\r\n", np.uint8))
    atom = ~text & ~structural & ~blank
    atom_start = atom & ~(_shift(atom, False) & (_shift(doc_of, -1) == doc_of))
    opening = quote & inside
    token = structural | opening | atom_start
    at = np.flatnonzero(token)
    doc, byte = doc_of[at], buf[at]
    # Ends: a string ends after its closing quote, an atom before the next other byte.
    end = at + 1
    closing = np.flatnonzero(quote & ~inside)
    is_string, is_atom = opening[at], atom_start[at]
    if len(at):
        where = np.searchsorted(closing, at[is_string])
        end[is_string] = np.append(closing, len(buf) - 1)[where] + 1
        other = np.flatnonzero(~atom)
        end[is_atom] = other[np.searchsorted(other, at[is_atom])]

    # Depth: brackets opened before a token and not yet closed; an open bracket counts from itself.
    is_open, is_close = (byte == 0x7B) | (byte == 0x5B), (byte == 0x7D) | (byte == 0x5D)
    is_open &= ~is_string & ~is_atom
    is_close &= ~is_string & ~is_atom
    depth = np.cumsum(is_open.astype(np.int64) - is_close)
    first = np.searchsorted(doc, np.arange(n_docs))
    floor = np.concatenate(([0], depth))[first]
    depth = depth - floor[doc]
    level = np.where(is_close, depth + 1, depth)  # level of the container a bracket bounds or a token lies in
    bad[doc[level < np.where(is_open | is_close, 1, 0)]] = True
    last = np.searchsorted(doc, np.arange(n_docs), side="right") - 1
    some = last >= first
    bad |= ~some
    bad[some] |= depth[last[some]] != 0

    # Container of each token: the last bracket opened on its level. Sorted by (text, level,
    # place), that is a forward fill.
    n = len(at)
    own = np.arange(n)
    order = np.lexsort((own, level, doc))
    filled = np.maximum.accumulate(np.where(is_open[order], np.arange(n), -1)) if n else order
    same = filled >= 0
    same &= (doc[order][np.maximum(filled, 0)] == doc[order]) & (level[order][np.maximum(filled, 0)] == level[order])
    within = np.full(n, -1)
    within[order] = np.where(same, order[np.maximum(filled, 0)], -1) if n else within
    in_object = np.where(within >= 0, byte[np.maximum(within, 0)] == 0x7B, False) if n else np.empty(0, bool)
    bad[doc[is_close & ((within < 0) | (in_object != (byte == 0x7D)))]] = True

    kind = np.full(n, ATOM)
    kind[is_string] = STRING
    plain = ~is_string & ~is_atom
    for ch, k in ((0x7B, OPEN_OBJ), (0x7D, CLOSE_OBJ), (0x5B, OPEN_ARR), (0x5D, CLOSE_ARR), (0x3A, COLON)):
        kind[plain & (byte == ch)] = k
    comma = plain & (byte == 0x2C)
    kind[comma] = np.where(in_object[comma], COMMA_OBJ, COMMA_ARR)
    bad[doc[comma & (within < 0)]] = True
    is_first = np.zeros(n, dtype=bool)
    is_first[first[some]] = True
    before = _shift(kind, -1)
    is_key = is_string & ~is_first & ((before == OPEN_OBJ) | (before == COMMA_OBJ)) & in_object
    kind[is_key] = KEY
    before = _shift(kind, -1)
    follows = ~is_first & ~_NEXT[np.maximum(before, 0), kind]
    bad[doc[follows]] = True
    bad[doc[is_first & ~np.isin(kind, _VALUE_START)]] = True
    outside = np.where(is_open, depth - 1, np.where(is_close, depth + 1, depth)) == 0
    bad[doc[outside & ~is_first]] = True

    # Scalars: each distinct spelling is checked once.
    spans: dict[bytes, bool] = {}
    for i in np.flatnonzero(is_atom):
        raw = buffer[at[i] : end[i]]
        ok = spans.get(raw)
        if ok is None:
            ok = spans[raw] = _ATOM.fullmatch(raw) is not None
        if not ok:
            bad[doc[i]] = True
    slashes = np.concatenate(([0], np.cumsum(slash)))
    for i in np.flatnonzero(is_string):
        if slashes[end[i]] > slashes[at[i]] and _ESCAPE.sub(b"", buffer[at[i] + 1 : end[i] - 1]):
            bad[doc[i]] = True

    # Values and their links.
    good = ~bad[doc]
    value = good & np.isin(kind, _VALUE_START)
    number = np.cumsum(value) - 1
    v = np.flatnonzero(value)
    holder = np.where(is_open, -1, within)
    outer = np.full(n, -1)
    # An open bracket lies in the bracket that was open one level up just before it.
    opens = np.flatnonzero(is_open & good)
    if len(opens):
        prev = opens - 1
        usable = (prev >= 0) & (doc[np.maximum(prev, 0)] == doc[opens])
        p = np.maximum(prev, 0)
        up = np.where(is_close[p], -2, within[p])
        outer[opens] = np.where(usable & (level[opens] > 1), up, -1)
    holder[opens] = outer[opens]
    parent = np.where(holder[v] >= 0, number[np.maximum(holder[v], 0)], -1)
    has_key = (kind[np.maximum(v - 1, 0)] == COLON) & (v > 0) & ~is_first[v]
    key = np.full(len(v), None, dtype=object)
    names: dict[bytes, str] = {}
    for j in np.flatnonzero(has_key):
        i = v[j] - 2
        raw = buffer[at[i] : end[i]]
        name = names.get(raw)
        if name is None:
            name = names[raw] = json.loads(raw)
        key[j] = name
    # Place in a list: commas of that list seen before.
    place = np.full(len(v), -1, dtype=np.int64)
    in_list = (holder[v] >= 0) & (byte[np.maximum(holder[v], 0)] == 0x5B)
    if in_list.any():
        h = holder[v][in_list]
        starts_of = np.concatenate(([True], np.diff(np.sort(h, kind="stable")) != 0))
        by = np.argsort(h, kind="stable")
        run = np.arange(len(h)) - np.maximum.accumulate(np.where(starts_of, np.arange(len(h)), 0))
        got = np.empty(len(h), np.int64)
        got[by] = run
        place[in_list] = got
    return Nodes(doc[v], parent, key, place, kind[v], at[v], end[v], buffer, ~bad)
