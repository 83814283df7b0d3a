import pytest

from airlake.llm.queries import ORACLE, QUERIES
from airlake.plans.check import compare, duck


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, key):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(QUERIES[key](spark, sf), duck(sf), ORACLE[key])
    assert ok, message


def test_queries_are_registered():
    import __spark_entry__
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)]
