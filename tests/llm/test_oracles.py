"""Each training-data query against its SQL on the smallest tables, and the shape of the others."""

import pytest

from stackroom.llm import registry

from ..same import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert_same(df, duck.sql(registry.ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_license_scan_is_native(spark):
    plan = registry.QUERIES["op1_license_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
