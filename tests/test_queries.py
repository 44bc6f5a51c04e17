"""Every query over the map against its SQL, on the smallest tables."""

import pytest
from small import SMALL

from cairn.plans import frames, keys, maps, rays, scenes, shapes, space, upkeep, views

QUERIES = keys.QUERIES | maps.QUERIES | scenes.QUERIES | space.QUERIES | frames.QUERIES | rays.QUERIES | shapes.QUERIES | upkeep.QUERIES | views.QUERIES
ORACLE = keys.ORACLE | maps.ORACLE | scenes.ORACLE | space.ORACLE | frames.ORACLE | rays.ORACLE | shapes.ORACLE | upkeep.ORACLE | views.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, same, name):
    same(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
