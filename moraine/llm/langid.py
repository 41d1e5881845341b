"""Language of documents and of their stretches, by compression.

A text is encoded by zstandard once per language, with a dictionary of raw text of that language;
the smallest result names the language and the distance to the second smallest is its margin.
Sentences are scored one by one, a change of language costs ``SWITCH`` bytes, and the cheapest
sequence over the whole text gives the stretches.

The dictionaries start from labelled samples, per language the ``SAMPLE_TEXTS`` texts of least hash,
and are filled from a bounded sample of labelled documents: per language the ``SAMPLE_DOCS``
documents of least id hash, of which only those are taken that the dictionaries so far find to be
one stretch in the label's language, up to ``DICTIONARY_CHARS`` per language. Each bound is per
language, so no language is left out however many rows the others have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.words import plain, unmarked
from moraine.session import spread

#: Bounds of the sample that the dictionaries are filled from.
SAMPLE_TEXTS, SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_CHARS = 150, 150, 6_000, 40_000
#: Least words of a sampled document, and by what share its size must be below the second smallest.
SAMPLE_WORDS, CLEAR = 30, 0.15
#: Times the sample is judged, each time by the dictionaries filled before.
ROUNDS = 3
#: No dictionary is longer than this many times the shortest: a longer one favours its language.
BALANCE = 2
#: Bytes a change of language costs; bytes of margin below which a stretch has no language of its own.
SWITCH, NARROW = 12, 3
#: Compression with tables that stay in a core's cache for all languages at once; a target length
#: of 1 leaves what doesn't match as it is, so that sizes tell how much of a text matches.
PARAMETERS = {"compression_level": 1, "strategy": zstandard.STRATEGY_FAST, "window_log": 17, "hash_log": 13, "chain_log": 12, "search_log": 1, "min_match": 5, "target_length": 1, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: Least words of prose of a document, and of a stretch in a mixed text.
LEAST_PROSE, LEAST_STRETCH = 8, 15

# Usual names of the languages in labels, region suffixes aside.
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "inglês", "engels"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "duits"],
    "fr": ["fr", "fra", "fre", "french", "français", "französisch", "francés", "francês", "frans"],
    "es": ["es", "spa", "spanish", "español", "castellano", "castilian", "spanisch", "espagnol", "espanhol", "spaans"],
    "pt": ["pt", "por", "portuguese", "português", "portugiesisch", "portugais", "portugués", "portugees"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "niederländisch", "néerlandais", "neerlandés", "holandês"],
}
_CODE = {plain(n): code for code, names in NAMES.items() for n in names}

_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Lines that aren't prose: commands, log lines, records, table rows, headings, code fences.
_OTHER = re.compile(r"\s*(?:[$#%|{\[]|```|~~~|\d{4}-\d\d-\d\d[T ]\d|\[?\d\d:\d\d:\d\d|</?(?:pre|code)\b)")
_FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*$", re.S | re.M)
#: Parts of a line that aren't prose: code, quoted messages and brackets; then, where the line has
#: their mark, addresses, paths and options.
_QUOTED = re.compile(r"`[^`\n]*`|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|\([^()\n]*\)")
_MARKED = (("://", re.compile(r"\b\w+://\S+")), ("/", re.compile(r"(?<!\S)[~.]?/\S+")), ("=", re.compile(r"(?<!\S)--?\w[\w-]*=\S*")))
_END = re.compile(r"[.!?…]\s+")
#: A sentence longer than this many characters is scored in parts.
PART = 400


@lru_cache(10_000)
def label_language(label: str | None) -> str | None:
    """The language a label names in one of its usual forms, or None."""
    if not label:
        return None
    name = plain(label).strip()
    return _CODE.get(name) or _CODE.get(re.split(r"[-_ (]", name, maxsplit=1)[0])


def sentences(text: str) -> list[str]:
    """Sentences of the prose, each as its letters' words in one spelling."""
    text = unmarked(_FENCE.sub("\n", text) if "```" in text or "~~~" in text else text)
    out = []
    for line in re.split(r"[\r\n]+", text):
        line = line.lstrip("> \t")
        if not line or _OTHER.match(line):
            continue
        line = _QUOTED.sub(" ", line)
        for mark, part in _MARKED:
            if mark in line:
                line = part.sub(" ", line)
        for s in _END.split(plain(line)):
            found = _LETTERS.findall(s)
            if not found:
                continue
            whole = " ".join(found)
            if len(whole) < PART:
                out.append(f" {whole} ")
                continue
            part, n = [], 0
            for w in found:
                part.append(w)
                n += len(w) + 1
                if n >= PART:
                    out.append(" " + " ".join(part) + " ")
                    part, n = [], 0
            if part:
                out.append(" " + " ".join(part) + " ")
    return out


class Classifier:
    """One dictionary of raw text per language."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self._of = []
        how = zstandard.ZstdCompressionParameters(**PARAMETERS)
        for lang in self.languages:
            held = zstandard.ZstdCompressionDict(texts[lang].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)  # digested once, not once per text
            self._of.append(zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress)

    def sizes(self, text: str) -> list[int]:
        raw = text.encode()
        return [len(compress(raw)) for compress in self._of]

    def path(self, costs: list[list[int]], switch: int = SWITCH) -> list[int]:
        """Cheapest language of each sentence when a change costs ``switch`` bytes."""
        lowest = {c.index(min(c)) for c in costs}
        if len(lowest) == 1:
            return [*lowest] * len(costs)
        best, back = list(costs[0]), []
        for c in costs[1:]:
            low = min(range(len(best)), key=best.__getitem__)
            limit = best[low] + switch
            back.append([k if best[k] <= limit else low for k in range(len(c))])
            best = [min(b, limit) + x for b, x in zip(best, c, strict=True)]
        k = min(range(len(best)), key=best.__getitem__)
        out = [k]
        for step in reversed(back):
            k = step[k]
            out.append(k)
        return out[::-1]

    def stretches(self, parts: list[str]) -> list[tuple[str, float, int, int]]:
        """``(language, confidence, words, sentences)`` of each stretch. The confidence is the
        margin as a share of the second smallest size; a text whose only stretch has a narrow
        margin gets no language (an empty list)."""
        if not parts:
            return []
        costs = [self.sizes(p) for p in parts]
        runs: list[list] = []  # language, words, sizes per language, sentences
        for k, p, c in zip(self.path(costs), parts, costs, strict=True):
            if runs and runs[-1][0] == k:
                r = runs[-1]
                r[1] += p.count(" ") - 1
                r[2] = [a + b for a, b in zip(r[2], c, strict=True)]
                r[3] += 1
            else:
                runs.append([k, p.count(" ") - 1, list(c), 1])
        while len(runs) > 1:
            weak = [i for i, r in enumerate(runs) if r[1] < LEAST_STRETCH or _margin(r) < NARROW]
            if not weak:
                break
            i = min(weak, key=lambda i: runs[i][1])
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(runs)]
            j = min(near, key=lambda j: runs[i][2][runs[j][0]])
            into, r = runs[j], runs.pop(i)
            into[1:] = [into[1] + r[1], [a + b for a, b in zip(into[2], r[2], strict=True)], into[3] + r[3]]
            k = 1
            while k < len(runs):
                if runs[k][0] == runs[k - 1][0]:
                    a, b = runs[k - 1], runs.pop(k)
                    a[1:] = [a[1] + b[1], [x + y for x, y in zip(a[2], b[2], strict=True)], a[3] + b[3]]
                else:
                    k += 1
        if len(runs) == 1 and _margin(runs[0]) < NARROW:
            return []
        return [(self.languages[r[0]], round(_margin(r) / max(1, min(x for k, x in enumerate(r[2]) if k != r[0])), 4), r[1], r[3]) for r in runs]


def _margin(run: list) -> int:
    return min(x for k, x in enumerate(run[2]) if k != run[0]) - run[2][run[0]]


def _sampled(rows: DataFrame, most: int, by: list[Column]) -> DataFrame:
    """``rows`` with the ``code`` of their label ``lang``, per language the first ``most`` by ``by``.
    The first ``most`` of every label come first, so a label is read few times and labels that
    a third of all rows have are cut down before any shuffle."""
    label = F.udf(lambda x: label_language(x), "string")
    per_label = rows.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("_k") <= most)
    named = per_label.withColumn("code", label("lang")).filter("code is not null")
    return named.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy(*by))).filter(F.col("_k") <= most)


def fit(docs: DataFrame, samples: DataFrame) -> dict[str, str]:
    """Raw text of each language for the dictionaries (see the module's text for the bounds)."""
    texts: dict[str, list[str]] = {}
    known = samples.select("lang", "text").filter("text is not null and lang is not null").distinct()
    for code, text in sorted((r.code, r.text) for r in _sampled(known, SAMPLE_TEXTS, [F.xxhash64("text"), F.col("text")]).collect()):
        texts.setdefault(code, []).extend(sentences(text))
    rows = docs.filter((F.length("text") <= SAMPLE_CHARS) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang")
    picked = {r.doc_id: (r.code, r._k) for r in _sampled(rows, SAMPLE_DOCS, [F.xxhash64("doc_id"), F.col("doc_id")]).collect()}
    held = docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id bigint")), "doc_id").collect() if picked else []
    documents = [(picked[r.doc_id][0], [p for p in sentences(r.text or "") if p.count(" ") > 4]) for r in sorted(held, key=lambda r: (*picked[r.doc_id], r.text or ""))]
    filled = texts
    for _ in range(ROUNDS):
        filled = _filled(Classifier({k: "".join(v) for k, v in filled.items()}), texts, documents)
    return {k: "".join(v) for k, v in filled.items()}


def _filled(judge: Classifier, texts: dict[str, list[str]], documents: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    """``texts`` with the sentences of labelled documents that ``judge`` finds to be one stretch in the
    language of the label, by a clear margin."""
    out = {k: list(v) for k, v in texts.items()}
    room = {k: DICTIONARY_CHARS - sum(map(len, v)) for k, v in out.items()}
    for code, parts in documents:
        if room.get(code, 0) <= 0 or not parts:
            continue
        at = judge.languages.index(code)
        sizes = [judge.sizes(p) for p in parts]
        whole = [sum(s) for s in zip(*sizes, strict=True)]
        rival = min(x for k, x in enumerate(whole) if k != at)
        if set(judge.path(sizes)) == {at} and whole[at] <= (1 - CLEAR) * rival and sum(p.count(" ") - 1 for p in parts) >= SAMPLE_WORDS:
            out[code] += parts
            room[code] -= sum(map(len, parts))
    most = BALANCE * min((sum(map(len, v)) for v in out.values()), default=0)
    for parts in out.values():
        total = 0
        for k, p in enumerate(parts):
            total += len(p)
            if total > most:
                del parts[k:]
                break
    return out


def language_stretches(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, stretch_no, lang, confidence, n_words, n_stretches, label, label_lang``: every
    document's stretches in one language, numbered from 1.

    Null texts, texts without prose and texts whose margin is narrow have no rows. ``label_lang``
    is the language the delivered label names, null if none.
    """
    texts = fit(docs, samples)
    sent = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(sent.value) if sent.value else None
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for d, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = of.stretches(sentences(text)) if of else []
                named = label_language(label)
                for no, (lang, sure, n, _) in enumerate(found, 1):
                    for c, v in zip(cols, (d, no, lang, sure, n, len(found), label, named), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "stretch_no", "lang", "confidence", "n_words", "n_stretches", "label", "label_lang"])

    rows = spread(docs.select(F.col("doc_id").cast("bigint"), "lang", "text").filter("text is not null"))
    return rows.mapInArrow(run, "doc_id bigint, stretch_no bigint, lang string, confidence double, n_words bigint, n_stretches bigint, label string, label_lang string")


def wrong_labels(stretches: DataFrame) -> DataFrame:
    """Stretches of documents in several languages or with a label that isn't their language:
    ``doc_id, stretch_no, true_lang``."""
    wrong = (F.col("n_stretches") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return stretches.filter(wrong & ((F.col("n_stretches") > 1) | (F.col("n_words") >= LEAST_PROSE))).select("doc_id", "stretch_no", F.col("lang").alias("true_lang"))
