"""Every registry query of the core against its SQL, over the whole smallest tables."""

import compare
import pytest

from foldstone.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = compare.spark_rows(QUERIES[name](spark, small))
    if name in SQL:
        assert got == compare.sql_rows(compare.duck(small), SQL[name])
    else:
        assert got[1]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["kv_get", "kv_range", "kv_range_open", "kv_page", "kv_prefix", "engine_get", "engine_range"])
def test_filters_reach_the_scan(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    pushed = [x.split("]")[0] for x in plan.split("PushedFilters: [")[1:]]
    assert pushed and any("key" in x or "collection" in x for x in pushed)
