"""Audit runs and manifests on files: written once, looked up by folder, conflicts refused."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import registry
from wardline.plans.lake_run import Conflict, Lake, ObjectVersion
from wardline.sources.audit_store import AuditStore
from wardline.sources.storage import workspace

SCHEMA = "run_id STRING, status STRING, created_at TIMESTAMP_NTZ"


def runs(spark, ids, status="completed", minute=0):
    rows = [(None if n is None else f"run-{n}", status, minute) for n in ids]
    return spark.createDataFrame(rows, "run_id STRING, status STRING, m INT").select(
        "run_id", "status", F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"))


def test_a_retried_append_adds_what_is_missing(spark):
    store = AuditStore(spark, workspace(spark, "audit"), SCHEMA, parts=8)
    assert store.runs().isEmpty() and store.get("run-1").isEmpty()
    assert store.append(runs(spark, [1, 2, 3, 3, None])) == 3
    assert store.append(runs(spark, [1, 2, 3, 4, 5], "retried", 5)) == 2
    assert store.append(runs(spark, [1, 2, 3, 4, 5], "again", 9)) == 0
    assert {(r.run_id, r.status) for r in store.runs().collect()} == {
        ("run-1", "completed"), ("run-2", "completed"), ("run-3", "completed"), ("run-4", "retried"), ("run-5", "retried")}
    again = AuditStore(spark, store.root, SCHEMA, parts=8)
    assert again.get("run-4").first().status == "retried" and again.get("run-9").isEmpty()
    assert [r.run_id for r in again.recent(2).collect()] == ["run-4", "run-5"]
    with pytest.raises(ValueError, match="101"):
        again.recent(registry.AUDIT_BOUND + 1)


def test_half_an_append_is_completed(spark):
    """A writer that died after some of its files: the same append again leaves every run once."""
    store = AuditStore(spark, workspace(spark, "audit"), SCHEMA, parts=4)
    whole = runs(spark, range(50))
    store.append(whole.where("run_id < 'run-3'"))
    store.append(whole)
    assert store.runs().count() == store.runs().select("run_id").distinct().count() == 50


def test_the_first_of_repeated_ids_is_the_earliest(spark):
    store = AuditStore(spark, workspace(spark, "audit"), SCHEMA)
    store.append(runs(spark, [1], "late", 9).unionByName(runs(spark, [1], "early", 1)))
    assert store.get("run-1").first().status == "early"


def test_a_lookup_reads_one_folder(spark):
    store = AuditStore(spark, workspace(spark, "audit"), SCHEMA, parts=8)
    store.append(runs(spark, range(200)))
    plan = store.get("run-17")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan
    files = store.get("run-17").select(F.input_file_name().alias("f")).collect()
    assert len(files) == 1 and "_part=" in files[0].f


def test_a_known_manifest_with_other_content_is_refused(spark, lake_root):
    lake = Lake(spark, lake_root)
    one = ObjectVersion("patients", "object-1", "/a", 5, 0, "0" * 64)
    first = lake._publish("raw", "clinical", "source-to-raw", None, "b", [one], [])
    assert lake._publish("raw", "clinical", "source-to-raw", None, "b", [one], []).snapshot_id == first.snapshot_id
    other = ObjectVersion("patients", "object-1", "/b", 6, 0, "1" * 64)
    with pytest.raises(Conflict, match="other content"):
        lake._publish("raw", "clinical", "source-to-raw", None, "b", [other], [])
    assert lake.snapshots().count() == 2 and lake.manifests().count() == 1
