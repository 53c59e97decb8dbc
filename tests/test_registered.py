"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql
from check import connect, differences
from rillmark.plans.oracles import ORACLES
from rillmark.plans.queries import REGISTERED

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(REGISTERED) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["segment_id", "profile_id"]


# Bounded memories follow each row in turn, which needs Python; nothing else does.
WALKED = {"dedup_bounded", "dedup_sharded"}


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, duck, name):
    frame = REGISTERED[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert name in WALKED or "Python" not in plan and "MapInArrow" not in plan
    got = frame.toPandas()
    assert differences(got, duck.execute(ORACLES[name]).df()) is None
