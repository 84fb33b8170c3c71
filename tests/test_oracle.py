"""Every query with oracle SQL, compared on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_one_row_per_run(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and all(0 <= r["pod_mts"] <= 1 for r in rows if r["pod_mts"] is not None)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert check(spark, con, SF, name, queries()[name], ORACLES[name]) is None
