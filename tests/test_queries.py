"""Every query of the engine against its DuckDB SQL, on the smallest tables."""

import pytest

from quarry.plans import queries as engine
from tests.parity import compare, connect

DIRECTORY = "/root/testdata/sf0.001"
SQL = engine.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, con, name):
    df = engine.queries()[name](spark, DIRECTORY)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.columns and df.count() >= 0


def test_plans(spark):
    """Filters and columns reach the scan; top-k needs no full sort."""
    plan = engine.queries()["cosine_topk"](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
