"""Words of a text as they are compared: case, accents, character forms, punctuation, spacing,
markup, entities and escapes do not count."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

#: A tag: up to 300 characters of any kind, or of any length if they are attributes with values.
_TAG = re.compile(r"""</?[A-Za-z](?:[^<>]{0,300}>|[\w:.-]*(?:\s+[\w:.@-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))*\s*/?>)|<!--.*?-->""", re.S)
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile(r"\\[nrt]")
#: Characters that only guide line breaking or shaping: soft hyphen, zero-width space and
#: joiners, direction marks, word joiner, byte order mark.
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f]+")


def unmarked(text: str) -> str:
    """The text without tags, entities and escapes."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
        text = _CONTROL.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _TAG.sub(" ", text) if "<" in text else text


def plain(text: str) -> str:
    """Letters without case, accents and variant forms."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    return text.casefold()


def folded(text: str) -> str:
    return plain(unmarked(text))


def words(text: str) -> list[str]:
    return _WORD.findall(folded(text))


class Vocabulary:
    """64-bit hashes of words, each computed once."""

    #: Words remembered at a time.
    MOST = 2_000_000

    def __init__(self):
        self._of: dict[str, int] = {}

    def hashes(self, tokens: list[str]) -> np.ndarray:
        of = self._of
        if len(of) > self.MOST:
            of.clear()
        out = np.empty(len(tokens), np.uint64)
        for i, t in enumerate(tokens):
            h = of.get(t)
            if h is None:
                h = of[t] = xxhash.xxh64_intdigest(t)
            out[i] = h
        return out

    @staticmethod
    def of_bytes(piece: np.ndarray) -> int:
        """Signed 64-bit hash of a sequence of word hashes."""
        return xxhash.xxh64_intdigest(piece.tobytes()) - (1 << 63)
