"""The registered queries against SQL, where SQL gives their rows."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection
from querylode.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in q.QUERIES)
    assert numbers == list(range(1, 14)) and set(q.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, name):
    message, _, bad = compare(spark, oracle_connection(SF), SF, name, q.QUERIES[name], q.ORACLES[name])
    assert not bad, message
