"""Every registry query of the subpackage over the whole smallest tables."""

import compare
import pytest

from foldstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    got = compare.spark_rows(queries.QUERIES[name](spark, small))
    if name in queries.SQL:
        assert got == compare.sql_rows(compare.duck(small), queries.SQL[name])
    else:
        assert got[1] or name == "p8_found"


def test_entry_adds_them():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
