"""Each registered query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import KINDS, TABLES, rows_of
from tests.conftest import SF_DIR
from wardline.plans.registered import QUERIES
from wardline.verification.duckdb_sql import ORACLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert {n: KINDS.get(t, t) for n, t in frame.dtypes} == {d[0]: str(d[1]) for d in cursor.description}
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, cursor.fetchall())


def test_entry_has_rows(spark):
    result = contract.entry(spark)
    assert {"urban_rural", "numerator", "denominator", "rate", "suppressed"} == set(result.columns)
    assert {(r.urban_rural, r.numerator, r.denominator) for r in result.collect()} == {("rural", 3, 24), ("urban", 3, 33)}
