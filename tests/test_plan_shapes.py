"""What the physical plans must and must not contain, and results that may not depend on partitioning."""

import pytest

import __spark_entry__ as contract
from check import rows_of
from tests.conftest import SF_DIR
from wardline import schemas
from wardline.operators import layers
from wardline.plans import catalogue
from wardline.sources.storage import workspace, write_serving_tables


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_provider_lookup_vanishes_when_unused(tables):
    assert "l_suppkey" not in plan(catalogue.encounter_volume(tables))
    assert "l_suppkey" in plan(catalogue.provider_volume(tables))


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(catalogue.high_cost(tables))
    assert "GreaterThan(o_totalprice,50000.0)" in text
    assert "o_orderpriority" not in text and "TakeOrderedAndProject" in text


def test_dedup_is_limited_before_the_shuffle(tables):
    text = plan(layers.silver_dedup(tables.star.lineitem, ["l_orderkey", "l_linenumber"], tables.star.lineitem.columns))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_no_nested_loop_or_cartesian_product(spark):
    for name in ("q06_comorbidity_cohort", "q07_primary_dx_readmission", "q10_quarter_change", "q15_above_average",
                 "q17_outlier_cost", "derive_readmissions", "m_readmission_30d_rate", "dq_foreign_keys_full"):
        text = plan(contract.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_bucketed_facts_join_without_a_shuffle(spark, tables):
    root = workspace(spark, "buckets")
    database = "b_" + root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/database'")
    write_serving_tables({e: tables[e] for e in ("encounters", "encounter_diagnoses")}, database, root, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table(f"{database}.encounters").join(spark.table(f"{database}.encounter_diagnoses"), "encounter_id")
        assert "Exchange" not in plan(joined)
        assert joined.count() == tables["encounter_diagnoses"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [
    "silver_dedup", "record_hash", "audit_recent", "m_avg_cost", "q16_date_quality", "run_stage_summary", "silver_typing",
    "stream_ingest_bronze"])
def test_independent_of_the_session_zone(spark, name):
    build = contract.queries()[name]
    frame = build(spark, SF_DIR)
    expected = rows_of(frame.columns, frame.collect())
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        again = build(spark, SF_DIR)
        assert rows_of(again.columns, again.collect()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", [
    "q06_comorbidity_cohort", "q13_latest_per_patient", "q17_outlier_cost", "derive_readmissions", "silver_quarantine",
    "dq_foreign_keys_full", "m_median_los", "stat_spearman", "snapshot_history", "content_checksum", "surrogate_key"])
def test_independent_of_partitioning_broadcast_and_aqe(spark, name):
    build = contract.queries()[name]
    frame = build(spark, SF_DIR)
    expected = rows_of(frame.columns, frame.collect())
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "17"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        again = build(spark, SF_DIR)
        assert rows_of(again.columns, again.collect()) == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_bucketed_references_are_counted_where_they_lie(spark, tables, lake_root):
    """Serving tables bucketed by encounter: no exchange of encounter-sized rows, whatever the size of the parent."""
    from wardline.operators import quality
    from wardline.sources import storage

    database = "b_" + lake_root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{lake_root}/database'")
    names = ["encounters", "encounter_diagnoses", "encounter_procedures", "lab_results", "readmissions", "hospitals"]
    storage.write_serving_tables({e: tables[e] for e in names}, database, lake_root, buckets=4)
    served = {e: spark.table(f"{database}.{e}") for e in names}
    by_encounter = [
        ("encounter_diagnoses", "encounter_id"), ("encounter_procedures", "encounter_id"), ("lab_results", "encounter_id"),
        ("readmissions", "index_encounter_id")]
    references = [r for r in schemas.REFERENCES if (r[0], r[1]) in by_encounter]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for reference in references:
            plan = quality.foreign_keys_by_parent(served, [reference])._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange" in line and "SinglePartition" not in line]
            assert not moved and "LeftAnti" in plan, reference
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    checked = [r for r in schemas.REFERENCES if r[0] in served and r[2] in served]
    one, other = quality.foreign_keys_by_parent(served, checked), quality.foreign_keys(served, checked)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    broken = {**served, "encounters": served["encounters"].where("encounter_id > 40")}
    one, other = quality.foreign_keys_by_parent(broken, checked), quality.foreign_keys(broken, checked)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and not all(r.passed for r in one.collect())


def test_serving_tables_grow_by_buckets_and_are_counted_as_written(spark, tables, lake_root, monkeypatch):
    """The buckets follow the rows; an entity is computed once, and rows that are lost after the write are a violation."""
    from wardline.plans import lake_run
    from wardline.sources import storage

    assert [storage.bucket_count(n) for n in (0, 8_000_000, 8_000_001, 216_000_000)] == [8, 8, 9, 216]
    asked = []
    monkeypatch.setattr(storage, "ROWS_IN_BUCKET", 500)
    write = storage.write_serving_tables
    monkeypatch.setattr(storage, "write_serving_tables", lambda t, d, r, buckets, *rest: asked.append(buckets) or write(t, d, r, buckets, *rest))
    result = contract.queries()["sink_serving_tables"](spark, SF_DIR)
    assert set(asked) == {-(-tables.star.lineitem.count() // 500)}
    assert "lineitem.parquet" not in plan(result) and "orders.parquet" not in plan(result)

    database, written = "b_" + lake_root.rsplit("-", 1)[1], {}
    spark.sql(f"CREATE DATABASE {database} LOCATION '{lake_root}/database'")
    names = ["encounters", "encounter_diagnoses", "hospitals"]
    write({e: tables[e] for e in names}, database, lake_root, 4, written)
    assert written == {e: tables[e].count() for e in names}
    empty = {"encounter_procedures": tables["encounter_procedures"].where("encounter_id < 0")}
    write(empty, database, lake_root, 4, written)
    assert written["encounter_procedures"] == 0
    served = {e: spark.table(f"{database}.{e}") for e in names}
    served["encounters"] = served["encounters"].where("encounter_id <> 1")
    lost = lake_run.load_validation(served, spark.createDataFrame([(e, written[e]) for e in names], "entity string, row_count long"))
    assert {r.entity: r.violations for r in lost.where("check = 'row_count'").collect()} == {"encounters": 1, "encounter_diagnoses": 0, "hospitals": 0}
