import pytest

from check import connect, differences
from rillmark.llm.sql import ORACLES


@pytest.fixture
def equals_sql(spark):
    """Compare a query with its SQL on a folder of tables."""

    def compare(query, sf_dir="/root/testdata/sf0.001"):
        problem = differences(query(spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES[query.__name__]).df())
        assert problem is None, problem

    return compare
