"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from orrery.plans import registry
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"
registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name], registry.ORACLES[name], spark, FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "flow_risk_topk", "finding_denoise"])
def test_partitions_make_no_difference(spark, name):
    from tests.oracle import rows

    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(registry.QUERIES[name](spark, FOLDER).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
