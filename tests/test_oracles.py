"""Every query of the library itself against its SQL, on the smallest tables.

The training-text operators have tests of their own in ``tests/llm``.
"""

import pytest

import __spark_entry__ as entry
from oracle import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(entry._QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", list(entry._QUERIES))
def test_query(spark, key):
    equal, rows, _, difference = compare(spark, SF, key)
    assert equal, difference
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "kind", "file", "line"]
    assert df.count() > 0
