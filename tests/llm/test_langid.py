import os

import pytest

from moraine.llm import langid as G

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("label,want", [("en-US", "en"), ("DE", "de"), ("pt_BR", "pt"), ("Français", "fr"), ("dut", "nl"), ("español", "es"), ("xx", None), ("", None), (None, None), ("und", None), ("?", None)])
def test_labels(label, want):
    assert G.label_language(label) == want


def test_prose():
    text = "## Title 3\n$ runctl --a=1 /srv/x\n2025-01-01T00:00:00Z WARN x\n{\"a\": 1}\n| a | 1 |\n> The check `upload failed` passed (node, 3). Was it?\n```\ncode here.\n```\n"
    assert G.sentences(text) == [" the check passed ", " was it "]
    assert G.sentences("") == [] and len(G.sentences("word " * 50_000)) > 100


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    from moraine.sources.tables import table

    return table(spark, SF, "documents"), table(spark, SF, "lang_samples")


def test_held_out_samples_and_planted_switches(spark, tables):
    docs, samples = tables
    rows = sorted((r.sample_id, r.lang, r.text) for r in samples.collect())
    nth = {r[0]: k for lang in {r[1] for r in rows} for k, r in enumerate(x for x in rows if x[1] == lang)}
    train, held = [r for r in rows if nth[r[0]] % 3], [r for r in rows if nth[r[0]] % 3 == 0]
    df = spark.createDataFrame(train, "sample_id bigint, lang string, text string")
    own = [(1_000_000 + i, None, t, 1) for i, _, t in held]
    by = {}
    for _, lang, t in held:
        by.setdefault(lang, []).append(t)
    pairs = [(a, b) for a in by for b in by if a != b]
    mixed = [(2_000_000 + k, a, " ".join(by[a][:2]) + "\n\n" + " ".join(by[b][:2]), 1) for k, (a, b) in enumerate(pairs)]
    odd = [(3, None, "", 1), (4, None, None, 1), (5, "en", "12 34 !!", 1)]
    test = spark.createDataFrame(own + mixed + odd, "doc_id bigint, lang string, text string, confidence int")
    texts = G.fit(docs, df)
    of = G.Classifier(texts)
    right = sum([s[0] for s in of.stretches(G.sentences(t))] == [lang] for _, lang, t in held)
    assert right >= 0.95 * len(held)
    good = sum([s[0] for s in of.stretches(G.sentences(t))] == list(p) for (_, _, t, _), p in zip(mixed, pairs, strict=True))
    assert good >= 0.9 * len(pairs)
    rows = G.language_stretches(docs.select("doc_id", "lang", "text").unionByName(test.drop("confidence")), df).filter("doc_id >= 1000000 or doc_id in (3, 4, 5)").collect()
    assert all(0 < r.confidence <= 1 for r in rows)


def test_empty_tables(spark, tables):
    docs, samples = tables
    assert G.wrong_labels(G.language_stretches(docs.limit(0), samples)).count() == 0
    assert G.language_stretches(docs, samples.limit(0)).count() == 0


def test_many_samples_leave_no_language_out(spark, tables):
    docs, samples = tables
    rows = [(r.lang, r.text) for r in samples.collect()]
    more = [(lang, f"{text} {chr(97 + i % 26) * (i % 9 + 1)}") for i in range(12_000) for lang, text in [rows[i % len(rows)]]]
    df = spark.createDataFrame([("de", t) for lang, t in more if lang == "de"] * 3 + more, "lang string, text string")
    assert set(G.fit(docs.limit(0), df)) == {lang for lang, _ in rows}
