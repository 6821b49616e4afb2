"""Every registered query against its SQL twin."""

from pathlib import Path

import oracle
import pytest

from twinsync.checks import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    result = QUERIES[name](spark, data)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    difference = oracle.compare(result, duck, ORACLES[name])
    assert difference is None, difference


def test_library_keeps_to_distributed_means():
    """No local checkpoints, cross joins, row-wise Python functions or frames pulled to the driver."""
    for path in (Path(__file__).parent.parent / "twinsync").rglob("*.py"):
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", "toPandas", "toLocalIterator", "F.udf", ".rdd"):
            assert word not in text, (path, word)
