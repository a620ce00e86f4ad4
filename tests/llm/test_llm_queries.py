"""Every registered query of this subpackage against its SQL twin."""

import pytest

import compare
from tremor.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = compare.compare(spark, compare.connect(SF), name, queries.QUERIES[name], queries.ORACLES.get(name), SF)[0]
    assert got.startswith("ok" if name in queries.ORACLES else "rows-only"), got
