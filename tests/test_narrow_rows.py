"""What is kept of a row in large aggregates and joins, and how often a row is hashed."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.conftest import SF_DIR
from wardline import schemas
from wardline.operators import compare, quality
from wardline.plans import registered


def test_references_are_numbers_beside_their_keys(tables):
    used, known = quality._referenced(tables, schemas.REFERENCES)
    assert dict(used.dtypes) == {"_child": "int", "_parent": "int", "key": "bigint", "rows": "bigint"}
    assert dict(known.dtypes) == {"_parent": "int", "key": "bigint"}


def test_rows_are_hashed_once_for_both_checksums(spark, monkeypatch):
    hashed = []
    plain = registered.ident.record_hash
    monkeypatch.setattr(registered.ident, "record_hash", lambda columns: hashed.append(tuple(columns)) or plain(columns))
    assert contract.queries()["dq_input_checksums"](spark, SF_DIR).count() == 1
    assert len(hashed) == len(set(hashed)) == len(registered.ClinicalTables(spark, SF_DIR))


def test_rows_are_compared_by_hashes_of_32_bytes(spark):
    left = spark.range(50).select("id", F.lit("a").alias("v"))
    diff = compare.entity_diff(left, left.where("id <> 7"), "e")
    assert (diff.first().only_left, diff.first().only_right) == (1, 0)
    assert "unhex" in diff._jdf.queryExecution().optimizedPlan().toString()
