"""The training-data queries on odd tables."""

import os

import pytest

from moraine.llm import queries
from tests import compare, variants

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def odd(request, tmp_path_factory):
    base = variants.make(SF, str(tmp_path_factory.mktemp(request.param)), request.param)
    return base, compare.views(base)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, odd, name):
    base, con = odd
    sql = queries.ORACLE.get(name)
    if sql:
        assert compare.compare(spark, con, queries.QUERIES[name], sql, base).startswith("ok")
    else:
        queries.QUERIES[name](spark, base).collect()


def test_repeats_and_nulls_change_nothing(spark, tmp_path):
    base = variants.make(SF, str(tmp_path / "n"), "nulls")
    plain = {tuple(r) for r in queries.QUERIES["p7_found"](spark, SF).collect()}
    odd = {tuple(r) for r in queries.QUERIES["p7_found"](spark, base).collect()}
    assert plain == odd
