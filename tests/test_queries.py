import itertools
import os

import pytest
from oracle_check import compare, database

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, db, name):
    f, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        assert f(spark, SF).count() > 0
    else:
        assert compare(spark, db, name, f, sql, SF) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["ex", "s", "prob"] and df.count() > 0
    for name in catalog.queries():
        assert name in e.queries()


def test_hyper_grid_has_few_tasks(spark):
    """It had a task for each combination of four cores: 256 here, 4096 on eight cores."""
    df = catalog.queries()["hyper_grid"](spark, SF)
    assert df.dtypes == [("iters", "bigint"), ("lr", "double"), ("reg", "double"), ("samples", "bigint")]
    assert sorted(map(tuple, df.collect())) == sorted(itertools.product([10, 50, 100], [0.01, 0.1, 1.0], [0.01, 0.1, 1.0], [100]))
    assert df.rdd.getNumPartitions() <= 27
