"""Cases at the edges: sizes, nulls, schemas, zones, depths."""

import itertools
from datetime import date, datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wardline.functions import identity, tails
from wardline.operators import compare, layers, quality, registry, stats
from wardline.plans import metrics
from wardline.sources import storage


@pytest.mark.parametrize("n1, n2", [(1, 1), (2, 5), (3, 4), (4, 6), (8, 3)])
def test_exact_ranks_by_enumeration(n1, n2):
    counts = {}
    for chosen in itertools.combinations(range(n1 + n2), n1):
        u = sum(chosen) - n1 * (n1 - 1) // 2
        counts[u] = counts.get(u, 0) + 1
    total = sum(counts.values())
    for u in counts:
        low = min(u, n1 * n2 - u)
        want = min(Fraction(1), Fraction(2 * sum(c for v, c in counts.items() if v <= low), total))
        assert tails.mann_whitney_exact(u, n1, n2) == pytest.approx(float(want), rel=1e-12)


def test_exact_ranks_do_not_switch_with_size(spark):
    values = [tails.mann_whitney_exact(0, 8, n) for n in (2499, 2501, 3000, 10**9)]
    assert values[0] / values[1] == pytest.approx((2501 / 2499) ** 8, rel=0.01) and values == sorted(values, reverse=True)
    rows = [(float(k), k < 8) for k in range(3008)]
    frame = spark.createDataFrame(rows, "v DOUBLE, first BOOLEAN")
    got = stats.mann_whitney(frame, "v", F.col("first")).first()
    assert got.method == "exact" and got.p_value == pytest.approx(tails.mann_whitney_exact(0, 8, 3000))
    assert stats.mann_whitney(frame, "v", F.col("first"), method="normal").first().method == "normal"


def test_fractions_of_a_second_keep_their_digits(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 06:30:00.25' AS a, TIMESTAMP_NTZ'2024-01-01 06:30:00' AS b, TIMESTAMP_NTZ'2024-01-01 06:30:00.000001' AS c")
    row = frame.select(*[identity.iso_timestamp(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("2024-01-01T06:30:00.250000", "2024-01-01T06:30:00", "2024-01-01T06:30:00.000001")


def test_zoned_times_are_the_same_in_every_session(spark):
    text = ["2023-11-05T06:30:00Z", "2023-11-05T05:30:00Z", "2023-11-05T01:30:00-04:00", "2023-03-12T02:30:00"]
    frame = spark.createDataFrame([(t,) for t in text], "t STRING")
    before, found = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append([r.t for r in frame.select(layers.to_iso_timestamp(F.col("t")).alias("t")).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == found[2] == [
        datetime(2023, 11, 5, 6, 30), datetime(2023, 11, 5, 5, 30), datetime(2023, 11, 5, 5, 30), datetime(2023, 3, 12, 2, 30)]


def test_encounters_of_no_known_hospital_count_by_year(spark):
    tables = {
        "encounters": spark.createDataFrame(
            [(n, 1 if n % 2 else None if n % 4 else 99, date(2024, 1, 1), 1.0, n % 3 % 2) for n in range(40)],
            "encounter_id BIGINT, hospital_id BIGINT, admission_date DATE, total_cost DOUBLE, mortality_flag INT"),
        "hospitals": spark.createDataFrame([(1, "same", "urban"), (2, "same", "urban")], "hospital_id BIGINT, hospital_name STRING, urban_rural STRING"),
    }
    got = {(r.grouping, r.group_value): r.denominator for r in metrics.metric(
        tables, "mortality_rate", ("hospital", "urban_rural", "quarter", "year")).collect()}
    assert got == {("year", "2024"): 40, ("quarter", "2024-01-01"): 40, ("hospital", "same"): 20, ("urban_rural", "urban"): 20}


def test_lists_never_cut_in_silence(spark):
    runs = spark.range(300).selectExpr("id AS run_id", "id AS created_at")
    with pytest.raises(ValueError, match="1 to 100"):
        registry.audit_recent(runs, 500)
    with pytest.raises(ValueError, match="1 to 1000"):
        registry.registry_list(runs, ["run_id"], limit=5000)
    assert registry.audit_recent(runs, 100).count() == 100


def test_deep_and_cyclic_lineage(spark):
    edges = [(f"n{k + 1}", f"n{k}") for k in range(40)] + [("n0", "n3")]
    found = registry.lineage_ancestry(
        spark.createDataFrame(edges, "child_id STRING, parent_id STRING"), spark.createDataFrame([("n40",)], "start_id STRING"))
    assert {r.node_id: r.depth for r in found.collect()} == {f"n{k}": 40 - k for k in range(41)}


def test_one_rule_for_the_active_snapshot(spark):
    at = datetime(2024, 1, 1, 12)
    rows = [("gold", "b", at, 200_000, "validated"), ("gold", "c", at, 3, "validated"), ("gold", "a", datetime(2024, 1, 1, 11, 59, 30), 900_000, "validated")]
    frame = spark.createDataFrame(rows, "layer STRING, snapshot_id STRING, published_at TIMESTAMP_NTZ, sequence BIGINT, status STRING")
    assert registry.snapshot_active(frame).first().snapshot_id == "b"
    history = {r.snapshot_id: (r.replaces_snapshot_id, r.state) for r in registry.snapshot_history(frame).collect()}
    assert history == {"a": (None, "superseded"), "c": ("a", "superseded"), "b": ("c", "active")}


def test_a_batch_adds_each_new_key_once(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "d")], "k INT, v STRING")
    got = storage.incremental_batch(frame.where("k = 1"), frame, ["k"], "b1", "b2").select("k", "v").collect()
    assert sorted(map(tuple, got)) == [(2, "b"), (3, "d")]


def test_schema_differences_are_seen(spark):
    left, wide, other = spark.sql("SELECT 1 AS a, 'x' AS b"), spark.sql("SELECT 1 AS a, 'x' AS b, 2 AS c"), spark.sql("SELECT 1L AS a, 'x' AS b")
    for one, two in ((left, wide), (wide, left), (left, other)):
        row = compare.snapshot_diff({"e": one}, {"e": two}).first()
        assert not row.logical_schema_equal and row.row_counts_equal
    assert compare.snapshot_diff({"e": left}, {"e": left}).first().logical_schema_equal


def test_null_and_absent_parents_are_orphans_in_the_lake(spark):
    encounters = spark.createDataFrame([(1, 1, 1), (2, None, 1), (3, 9, None)], "encounter_id BIGINT, patient_id BIGINT, hospital_id BIGINT")
    patients = spark.createDataFrame([(1,)], "patient_id BIGINT")
    got = {r.check: r.violations for r in quality.foreign_keys_lake({"encounters": encounters, "patients": patients}).collect()}
    assert got["foreign_key:patient_id"] == 2 and got["foreign_key:hospital_id"] == 3


def test_all_metrics_are_written_as_marts(spark, tables, lake_root):
    metrics.write_marts(tables, lake_root)
    written = metrics.read_marts(spark, lake_root)
    assert {r.metric for r in written.select("metric").distinct().collect()} == set(metrics.DEFINITIONS)
    assert metrics.metric_catalog(spark).count() == len(metrics.DEFINITIONS) == 10
