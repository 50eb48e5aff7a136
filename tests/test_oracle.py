"""Every registered query against its SQL oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from openbound.plans.registry import all_oracles, all_queries
from tests.conftest import SF01
from tools.oracle_check import compare, duck

ORACLES = all_oracles()
# queries without a SQL form -> their exact number of rows at sf0.01 (values: test_fit, test_bruteforce, test_layout)
ROWS_ONLY = {"r3_fit": 316, "r3_train_run": 40, "r4_pca": 316, "r4_layout": 316}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF01).toPandas()
    odf = con.execute(ORACLES[name]).df()
    ok, msg = compare(sdf, odf)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries(spark, name):
    assert E.queries()[name](spark, SF01).count() == ROWS_ONLY[name]


def test_every_query_is_checked():
    assert set(all_queries()) == set(ORACLES) | set(ROWS_ONLY)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 3 * 36 and df.columns == ["split", "y", "pred", "n"]
