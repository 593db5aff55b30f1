"""Queries with an SQL form against a second engine; the entry's guard."""

import compare
import pytest

from flakelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    ok, got, want = compare.compare(spark, compare.duck(SF), query, sql, SF)
    assert ok, (got[:2], want[:2], sorted(set(got[3]) ^ set(want[3]))[:4])
    assert got[0] > 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
