"""Every query with a SQL twin gives the same values in Spark and in DuckDB."""

import pytest
from compare import connect, difference

from loadcast.catalogue import QUERIES
from loadcast.oracles import ORACLES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", ORACLES)
def test_same_values(spark, con, folder, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], folder) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.count() > 0
