"""Every registered core query against its check SQL on odd tables, and the shape of the package."""

import ast
import os
import pathlib

import pytest

from moraine.plans import registry
from tests import compare, variants

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def odd(request, tmp_path_factory):
    base = variants.make(SF, str(tmp_path_factory.mktemp(request.param)), request.param)
    return base, compare.views(base)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, odd, name):
    base, con = odd
    sql = registry.oracle_sql().get(name)
    if sql:
        assert compare.compare(spark, con, registry.queries()[name], sql, base).startswith("ok")
    else:
        registry.queries()[name](spark, base).collect()


def test_nothing_imports_the_llm_package():
    for p in (ROOT / "moraine").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "moraine").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p


def test_entry_without_check_sql_of_unknown_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
