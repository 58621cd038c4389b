"""Operators that SQL can express, against their SQL."""

import pytest

from stratafold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, sf, name):
    a, b = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLES[name])
    names = [d[0] for d in b.description]
    assert sorted(a.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, a.select(*names).collect()))) == sorted(map(repr, b.fetchall()))


def test_oracles_are_sql():
    assert all(isinstance(q, str) for q in queries.ORACLES.values()) and set(queries.ORACLES) <= set(queries.QUERIES)
