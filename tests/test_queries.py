"""Every registered query against its SQL in a second engine, on whole tables."""

import os

import compare
import pytest

from flakelens.queries.catalog import CATALOG

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, duck, name):
    query, sql = CATALOG[name]
    assert sql, "every query has an SQL form"
    ok, got, want = compare.compare(spark, duck, query, sql, SF)
    if not ok:
        extra = [x[:300] for x in got[3] if x not in set(want[3])][:2]
        missing = [x[:300] for x in want[3] if x not in set(got[3])][:2]
        pytest.fail(f"{got[:2]} != {want[:2]}; only Spark {extra}; only SQL {missing}")
    assert got[0] > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_line_form_equals_text_form(spark):
    a = CATALOG["text_verdict"][0](spark, SF)
    b = CATALOG["line_verdict"][0](spark, SF)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
