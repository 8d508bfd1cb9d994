import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

# Slow or covered by another of the same plan; ``python -m checks.compare`` runs them all.
LEFT_OUT = {"kb_stats", "kb_retrieve", "kb_build", "prompt", "bp_text", "knn_recall", "kb_patterns_after_loads"}
# The operators for training data have their own tests.
OTHERS = entry.llm_queries.QUERIES.keys() | {"pipeline"} if entry.llm_queries else set()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert len(entry.entry(spark).limit(1).collect()) == 1


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in LEFT_OUT | OTHERS])
def test_query(spark, con, name):
    message, _, bad = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert not bad, message
