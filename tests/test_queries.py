"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from quillspark.plans import catalog
from tests.oracle import same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLES[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score"]
    assert df.count() > 0
