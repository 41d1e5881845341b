import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import winnow as W
from moraine.llm.words import words

WORDS = [a + b for a in ("ka", "mo", "ti", "re", "su", "vel", "nor") for b in ("ba", "do", "gu", "li", "pen", "rim", "sto")]


def brute(doc, item, least=18, per=8):
    """Edit distance of every item stretch against the document with free ends."""
    for a in range(len(item) - least + 1):
        row = [0] * (len(doc) + 1)
        for j in range(a, len(item)):
            new = [row[0] + 1]
            for k, w in enumerate(doc):
                new.append(min(row[k] + (w != item[j]), row[k + 1] + 1, new[k] + 1))
            row = new
            n = j - a + 1
            if n >= least and min(row) * per <= n:
                return True
    return False


def edited(rnd, stretch, edits):
    out = list(stretch)
    for _ in range(edits):
        i = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        out[i : i + (kind != 2)] = [rnd.choice(WORDS)] if kind else []
    return out


def test_cases_against_brute_force(spark):
    rnd = random.Random(7)
    docs, items, want = [], [], set()
    for k in range(300):
        item = [rnd.choice(WORDS) for _ in range(rnd.randint(10, 40) if k % 5 else rnd.randint(60, 150))]
        n = rnd.randint(12, 44)
        start = rnd.randrange(max(1, len(item) - n + 1))
        before = rnd.randint(0, 30) if k % 3 else rnd.randint(150, 260)
        doc = [rnd.choice(WORDS) for _ in range(before)] + edited(rnd, item[start : start + n], rnd.randint(0, 5)) + [rnd.choice(WORDS) for _ in range(rnd.randint(0, 30))]
        docs.append((k, " ".join(doc)))
        items.append((k, " ".join(item)))
        if brute(doc, item):
            want.add(k)
    assert 100 < len(want) < 250
    got = W.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).filter("doc_id = item_id").collect()
    assert {r.doc_id for r in got} == want


def test_four_words_replaced_in_a_row():
    item = np.arange(32, dtype=np.uint64)
    doc = item.copy()
    doc[14:18] += np.uint64(1000)
    assert W.holds(doc, item) and not W.holds(np.concatenate((doc[:14], doc[18:22], doc[18:])), item[:31])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=6))
def test_fingerprints_of_many_texts_are_those_of_each(texts):
    arrays = [np.array(t, np.uint64) for t in texts]
    at, fp = W.fingerprints(np.array([len(a) for a in arrays], np.int64), np.concatenate([*arrays, np.empty(0, np.uint64)]))
    want, start = [], 0
    for a in arrays:
        g = W.grams(a)
        want += [(start + int(p), int(g[p])) for p in W.fingerprint(g)]
        start += len(a)
    assert list(zip(at.tolist(), fp.tolist(), strict=True)) == want


def test_long_items_and_repeated_words(spark):
    rnd = random.Random(3)
    long = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(10_000)]
    docs = spark.createDataFrame([(1, " ".join(long[9_000:9_030])), (2, "word " * 3_000), (3, " ".join(long[40:70] + long[5_000:5_017])), (4, " ".join(long[100:115]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(long)), (2, "word " * 200), (3, " ".join(long[:60])), (4, " ".join(long))], "item_id bigint, text string")
    assert {tuple(r) for r in W.leaked(docs, items).collect()} == {(1, 1), (1, 4), (2, 2), (3, 1), (3, 3), (3, 4)}


ITEM = "Explain it in two steps. The vault of Brutam was filled in 671 rounds, yet 149 remain unreadable after a flood. Doubling the guard would halve the daily losses; how long until the corridor is clear?"
OTHER = "Explain it in two steps. Each shelf of Lodra can carry 84 cartons, with 578 of them written in pencil. Nothing older than nine winters may be destroyed; how few would do?"


def test_forms_that_do_not_count_and_no_cases(spark):
    core = ITEM.split(". ", 1)[1]
    shuffled = core.split()
    random.Random(2).shuffle(shuffled)
    docs = [core, core.upper(), core.replace(" ", "\n> "), "<p>" + core.replace("vault", "<b>vault</b>") + "</p>", json.dumps({"q": core.replace("vault", "väult")}), core.replace("671", "６７１").replace(";", " —"), core.replace("yet", "and").replace("guard", "new guard"), " ".join(core.split()[:15]), "Explain it in two steps. Something else entirely was said there.", " ".join(shuffled), "", None, "word " * 100_000 + core, core]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (1, ITEM), (3, None), (None, ITEM), (4, "too short"), (5, "")], "item_id bigint, text string")
    want = {(i, 1) for i in (0, 1, 2, 3, 4, 5, 6, 12, 13)}
    got = [tuple(r) for r in W.leaked(d, items).collect()]
    assert set(got) == want and len(got) == len(want)
    assert W.leaked(d.limit(0), items).count() == 0 and W.leaked(d, items.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("L&#39;été <b>a</b>_b_", "l ete a b"), ("Straße­ Ａ​b", "strasse ab"), ("a\\u00e9\\nb", "ae b")])
def test_words(text, want):
    assert words(text) == want.split()


def test_tags_of_any_length():
    assert words(f"a <x y='{'q ' * 300}' z=\"{'>' * 9}\"/> b < c <d e") == "a b c d e".split()
