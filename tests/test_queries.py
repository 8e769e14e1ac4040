"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from stackroom.plans import catalog

from .same import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert_same(df, duck.sql(catalog.ORACLE_SQL[name]))
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
