"""Every registered query against its SQL twin on the smallest tables; rows-only ones must run and be stable."""

import os

import pytest

from check import compare, connect
from citesieve.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()

pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert message.startswith(("ok", "rows only", "EMPTY")), message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["decision", "review_group", "papers"]
    assert sum(r.papers for r in df.collect()) > 0
