"""Gates on tiny frames, each with one planted fault."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import layers, quality


def encounter(spark, **changes):
    row = dict(
        encounter_id=1, patient_id=1, hospital_id=1, provider_id=1, encounter_type="inpatient",
        admission_date=date(2025, 1, 1), discharge_date=date(2025, 1, 3), discharge_disposition="home", total_cost=10.0,
        mortality_flag=0, complication_flag=0)
    row.update(changes)
    schema = schemas.entity_schema("encounters", typed=True)
    for item in schema.fields:
        item.nullable = True
    return spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)


def verdict(checks, name):
    return {r["check"]: (r["violations"], r["passed"]) for r in checks.collect()}[name]


@pytest.mark.parametrize("change, name", [
    ({"encounter_type": "ward"}, "check:encounter_type"),
    ({"total_cost": -1.0}, "check:total_cost"),
    ({"mortality_flag": 2}, "check:mortality_flag"),
])
def test_one_broken_constraint(spark, change, name):
    checks = quality.check_constraints({"encounters": encounter(spark, **change)}, ["encounters"])
    assert verdict(checks, name) == (1, False)
    assert sum(not r["passed"] for r in checks.collect()) == 1


def test_null_satisfies_a_constraint_but_not_a_domain(spark):
    frame = encounter(spark, encounter_type=None, total_cost=None)
    assert verdict(quality.check_constraints({"encounters": frame}, ["encounters"]), "check:encounter_type") == (0, True)
    assert verdict(quality.categorical_domains({"encounters": frame}), "categorical_domain:encounter_type") == (1, False)


@pytest.mark.parametrize("value, good", [
    ("2025-01-31", True), (None, True), ("2025-99-99", False), ("2025", False), ("2025-1-2", False),
    ("2025-01-31T00:00:00", False), ("", False), ("20250131", False),
])
def test_iso_dates(spark, value, good):
    frame = spark.createDataFrame([(value,)], "birth_date STRING")
    checks = quality.date_parse({"patients": frame}, ["patients"])
    assert verdict(checks, "date_parse:birth_date")[1] is good


@pytest.mark.parametrize("value, good", [
    ("2023-01-01T00:00:00Z", True), ("2023-01-01T08:00:00", True), ("2023-01-01 08:00", True),
    ("2023-01-01T08:00:00+02:00", True), ("2023-01-01T25:00:00", False), ("yesterday", False),
])
def test_iso_timestamps(spark, value, good):
    frame = spark.createDataFrame([(value,)], "created_at STRING")
    assert verdict(quality.date_parse({"patients": frame}, ["patients"]), "date_parse:created_at")[1] is good


def test_timestamp_zone_is_converted(spark):
    frame = spark.createDataFrame([("2023-01-01T08:00:00+02:00",), ("2023-01-01T08:00:00",)], "created_at STRING")
    typed = layers.silver_typing(frame).select(F.date_format("created_at", "HH:mm")).collect()
    assert [r[0] for r in typed] == ["06:00", "08:00"]


def test_typing_flags_lost_values(spark):
    frame = spark.createDataFrame([("2025-99-99", [])], f"birth_date STRING, {schemas.QUALITY_FLAGS} ARRAY<STRING>")
    row = layers.silver_typing(frame).first()
    assert row.birth_date is None and row[schemas.QUALITY_FLAGS] == ["date:birth_date"]


def test_orphans_are_counted_as_rows(spark):
    parents = {"patients": spark.createDataFrame([(1,)], "patient_id BIGINT"),
               "hospitals": spark.createDataFrame([(1,)], "hospital_id BIGINT"),
               "providers": spark.createDataFrame([], "provider_id BIGINT, hospital_id BIGINT")}
    child = encounter(spark, patient_id=9).unionByName(encounter(spark, patient_id=9, provider_id=None))
    references = [r for r in schemas.REFERENCES if r[0] == "encounters"]
    checks = quality.foreign_keys({**parents, "encounters": child}, references)
    assert verdict(checks, "foreign_key:patient_id") == (2, False)
    assert verdict(checks, "foreign_key:hospital_id") == (0, True)
    assert verdict(checks, "foreign_key:provider_id") == (1, False)


def test_repeated_key(spark):
    frame = encounter(spark).unionByName(encounter(spark))
    assert verdict(quality.unique_keys({"encounters": frame}, ["encounters"]), "unique:encounter_id") == (1, False)


def test_identifier_must_be_positive(spark):
    frame = encounter(spark, encounter_id=0)
    assert verdict(quality.identifier_validity({"encounters": frame}), "identifier_validity") == (1, False)


def test_rate_bounds(spark):
    frame = spark.createDataFrame([(1.2, 6, 5), (0.5, 1, 2)], "measure_value DOUBLE, numerator INT, denominator INT")
    assert verdict(quality.quality_rate_bounds({"quality_measures": frame}), "quality_rate_bounds") == (1, False)


def test_gate_needs_every_check(spark):
    rows = [("a", "x", 0, True), ("b", "y", 2, False)]
    result = quality.gate(spark.createDataFrame(rows, "check STRING, entity STRING, violations BIGINT, passed BOOLEAN")).first()
    assert (result.passed, result.failed_checks, result.errors) == (False, 1, ["y/b"])


def test_layer_steps():
    assert schemas.layer_transition("bronze", "silver") == "bronze-to-silver"
    for step in (("raw", "silver"), ("gold", "silver"), ("gold", "gold"), ("raw", "nowhere")):
        with pytest.raises(ValueError):
            schemas.layer_transition(*step)


def test_dedup_keeps_first_line_and_counts(spark):
    rows = [(1, 10, "b"), (2, 10, "a"), (3, None, "c"), (4, 11, "d"), (5, 10, "z")]
    frame = spark.createDataFrame(rows, "line BIGINT, k BIGINT, v STRING").repartition(3)
    kept = layers.silver_dedup(frame, ["k"], ["line"])
    assert sorted((r.k, r.v) for r in kept.collect()) == [(10, "b"), (11, "d")]
    assert dict(map(tuple, layers.rejected_counts(frame, ["k"]).collect())) == {"null_key": 1, "duplicate_key": 2}
    tagged = layers.tag_rejections(frame, ["k"], ["line"], ["line"])
    _, rejected = layers.quarantine(tagged)
    assert sorted((r.line, r[schemas.REJECTION_REASON]) for r in rejected.collect()) == [
        (2, "duplicate_key"), (3, "null_key"), (5, "duplicate_key")]
