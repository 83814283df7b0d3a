"""Every registered query against its DuckDB oracle (the driver's gate),
on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from airlake.plans import registry
from airlake.plans.check import compare, duck
from conftest import SF_SMALL

QUERIES = registry.all_queries()
ORACLE = registry.all_oracle()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    ok, msg = compare(QUERIES[key](spark, SF_SMALL), con, ORACLE[key])
    assert ok, f"{key}: {msg}"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"city", "season", "responsible", "n_days", "share_pct"}
    assert df.count() > 0


SPARK_TO_DUCK = {"DoubleType()": "DOUBLE", "LongType()": "BIGINT", "IntegerType()": "INTEGER",
                 "StringType()": "VARCHAR", "DateType()": "DATE", "BooleanType()": "BOOLEAN",
                 "TimestampNTZType()": "TIMESTAMP"}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle_types_match(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    st = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in df.schema.fields}
    res = con.execute(f"select * from ({ORACLE[key]}) limit 0")
    assert st == {c[0]: str(c[1]) for c in res.description}
