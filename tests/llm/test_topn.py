import random

import pytest

from moraine.llm.topn import top_n

SCHEMA = "g string, v int, k int, _n int, rank string"


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=True)
        out |= {(g, r[2], i) for i, r in enumerate(part[:n], 1)}
    return out


@pytest.mark.parametrize("heavy", [50, 10_000])
@pytest.mark.parametrize("n", [1, 7, 120])
def test_against_sorting(spark, heavy, n):
    rnd = random.Random(n)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice([None, *"abcdef"]), rnd.choice([None, *range(9)]), i, 1, "x") for i in range(2000)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], ["v", "k"], n, heavy=heavy)
    assert sorted(got.columns) == ["_n", "g", "k", "rank", "v"]
    out = [(r.g, r.k, r["rank"]) for r in got.collect()]
    assert set(out) == brute(rows, n) and len(out) == len(set(out))


def test_ties_all_equal_and_empty(spark):
    rows = [("a", 1, 1, 1, "x")] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["rank"] for r in top_n(df, ["g"], ["v", "k"], 5, heavy=20).collect()) == [1, 2, 3, 4, 5]
    assert top_n(df.limit(0), ["g"], ["v"], 5).count() == 0
    assert top_n(df, ["g"], ["v"], 0).count() == 0
