"""Ignore patterns as regular expressions, by the published rules of gitignore: ``*``, ``**``, ``?``,
``[a-z]``, ``[!..]``, classes, ``!`` negation, a trailing ``/`` for folders only, ``\\`` escapes. A
pattern without a slash before its end matches at any depth. A pattern is cut at its slashes, each
segment is translated by itself and the results are joined. Compiled once, matched by ``rlike`` in
the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
CLASSES = {"alnum": r"\p{L}\p{Nd}", "alpha": r"\p{L}", "ascii": r"\x00-\x7f", "blank": r"\p{Zs}\t", "cntrl": r"\p{Cc}", "digit": r"\p{Nd}", "graph": r"\p{L}\p{M}\p{N}\p{P}\p{S}", "lower": r"\p{Ll}", "print": r"\p{L}\p{M}\p{N}\p{P}\p{S} ", "punct": r"\p{P}\p{S}", "space": r"\s", "upper": r"\p{Lu}", "xdigit": r"A-Fa-f\p{Nd}"}

#: What a segment consists of, and what a set does.
_PART = re.compile(r"(?P<stars>\*+)|(?P<one>\?)|\[(?P<no>!?)(?P<set>\]?(?:\[:\w*:\]|\\.|[^\\\]])*)\]|\\(?P<escaped>.)|(?P<plain>[^\\\[])", re.S)
_MEMBER = re.compile(r"\[:(?P<name>\w*):\]|(?P<low>\\?.)(?:-(?P<high>\\?[^\]]))?", re.S)
#: Zero or more whole folders, and a pattern for nothing.
ANY_DEPTH, NEVER = "(?:[^/]+/)*", "(?!)"


@dataclass(frozen=True)
class Pattern:
    regex: str
    negated: bool
    folders_only: bool

    def matches(self, path: Column, is_folder: Column) -> Column:
        """Does the rule say yes? A negated rule says yes where its pattern doesn't match."""
        hit = path.rlike(self.regex)
        if self.folders_only:
            hit = hit & is_folder
        return ~hit if self.negated else hit


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def _members(body: str, pattern: str) -> str:
    out = []
    for m in _MEMBER.finditer(body):
        if m["low"] is not None:
            out.append("-".join(_quoted(c[-1]) for c in (m["low"], m["high"]) if c))
        elif m["name"] in CLASSES:
            out.append(CLASSES[m["name"]])
        else:
            raise ValueError(f"unknown class [:{m['name']}:] in {pattern!r}")
    return "".join(out)


def _segment(text: str, pattern: str) -> str:
    """One name of a path: nothing in it matches a slash."""
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r} in {pattern!r}")
        if m["stars"]:
            out.append("[^/]*")
        elif m["one"]:
            out.append("[^/]")
        elif m["set"] is not None:
            out.append(f"[^/{_members(m['set'], pattern)}]" if m["no"] else f"[{_members(m['set'], pattern)}]")
        else:
            out.append(_quoted(m["escaped"] or m["plain"]))
        at = m.end()
    return "".join(out)


def compiled(pattern: str, *, base: str = "", ignore_case: bool = False) -> Pattern:
    """The rule of one line. ``base`` is the folder the pattern belongs to; paths have ``/`` in
    front of their first name. Blanks around a pattern don't count, but for one behind a backslash."""
    line = pattern.lstrip()
    text = line.rstrip()
    if text.endswith("\\") and text != line:
        text += line[len(text)]
    negated, text = text.startswith("!"), text.removeprefix("!")
    folders_only, body = text.endswith("/"), text.removesuffix("/")
    names = body.removeprefix("/").split("/")
    free = "/" not in body
    regex = _quoted(base.rstrip("/")) + "/" + (ANY_DEPTH if free else "")
    for i, name in enumerate(names):
        last = i == len(names) - 1
        if name == "**":
            regex += ".+" if last else ANY_DEPTH
        else:
            regex += _segment(name, pattern) + ("" if last else "/")
    if not body:
        regex = NEVER
    return Pattern(f"(?s{'i' if ignore_case else ''})^(?:{regex})$", negated, folders_only)


def parsed(text: str | None, base: str = "") -> list[Pattern]:
    """Rules of an ignore file of the folder ``base`` (FI12): one a line, without blank lines and
    comments; a line that can't be read is left out."""
    out = []
    for line in (text or "").splitlines():
        if line.strip() and not line.startswith("#"):
            try:
                out.append(compiled(line, base=base))
            except ValueError:
                continue
    return out


def ignored(rules: Sequence[Pattern], path: Column, is_folder: Column, before: Column | None = None) -> Column:
    """Verdict of rules in order, after that of an outer layer (FI10): while a path isn't ignored
    only plain rules count, once it is only negated ones."""
    state = F.lit(False) if before is None else before
    for r in rules:
        state = F.when(~state if not r.negated else state, r.matches(path, is_folder)).otherwise(state)
    return state


def folders_above(path: Column) -> Column:
    """Paths of the folders a path lies in, outermost first: ``/a``, ``/a/b`` of ``/a/b/c``."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def pruned(rules: Sequence[Pattern], path: Column, is_folder: Column) -> Column:
    """Is the path left out, itself or by a folder above it (FI11)?"""
    return ignored(rules, path, is_folder) | F.exists(folders_above(path), lambda p: ignored(rules, p, F.lit(True)))
