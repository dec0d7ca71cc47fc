"""Stated cases of the rules: small rows and what they must give. The queries of the same names run over whole tables."""

import duckdb
import pytest

from colophon.queries import ORACLES, QUERIES, STATED


@pytest.mark.parametrize("name", sorted(STATED))
def test_stated_rows(spark, name):
    function, sql = STATED[name]
    df = function(spark, "")
    want = duckdb.sql(sql)
    columns = want.columns
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_every_stated_rule_has_a_query_over_a_table():
    assert set(STATED) <= set(QUERIES) and set(STATED) <= set(ORACLES)
