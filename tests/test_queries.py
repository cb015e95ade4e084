import pytest
from oracle import connect, differences

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    assert differences(df, con, catalog.oracle_sql()[name]) == ""
