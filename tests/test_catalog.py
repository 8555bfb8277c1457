"""Every query of the catalog against its SQL; those without SQL must run."""

import oracle
import pytest

from mosaiq.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert oracle.compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_the_catalog(spark):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)
