"""Cells of batches add up to the marts of one pass over all facts."""

import pytest
from pyspark.sql import functions as F

from wardline.plans import mart_cells, metrics
from wardline.sources import storage


def rows(df):
    return sorted((r.metric, r.grouping, str(r.group_value), r.denominator, None if r.value is None else round(r.value, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def whole(tables):
    return {e: tables[e] for e in ("encounters", "readmissions", "encounter_diagnoses", "hospitals", "diagnoses")}


def cut(tables, **conditions):
    return {**tables, **{e: tables[e].where(c) for e, c in conditions.items()}}


def test_cells_of_one_batch_are_the_marts(spark, whole):
    got = rows(mart_cells.marts(mart_cells.batch_cells(whole), whole, min_n=3))
    parts = [metrics.metric(whole, name, min_n=3) for name in metrics.DEFINITIONS]
    want = sorted(r for p in parts for r in rows(p))
    assert got == want and {r[0] for r in got} == set(metrics.DEFINITIONS)


def test_children_may_come_before_and_after_their_encounters(spark, whole):
    """Three batches in which stays, assessments and codes are dealt out by different keys."""
    deals = [{
        "encounters": f"encounter_id % 3 = {k}", "readmissions": f"index_encounter_id % 5 % 3 = {k}",
        "encounter_diagnoses": f"(encounter_id + diagnosis_id) % 7 % 3 = {k}"} for k in range(3)]
    path, known = storage.workspace(spark, "cells"), None
    for k, deal in enumerate(deals):
        new = cut(whole, **deal)
        mart_cells.append_cells(mart_cells.batch_cells(new, known), path, str(k))
        known = new if known is None else {e: known[e].unionByName(new[e]) if e in deal else known[e] for e in known}
    got = mart_cells.stored_cells(spark, path)
    assert rows(mart_cells.marts(got, whole)) == rows(mart_cells.marts(mart_cells.batch_cells(whole), whole))
    once = mart_cells.batch_cells(whole).select(got.columns)
    assert got.exceptAll(once).isEmpty() and once.exceptAll(got).isEmpty()


def test_a_batch_is_stored_once(spark, whole):
    path = storage.workspace(spark, "cells")
    cells = mart_cells.batch_cells(cut(whole, encounters="encounter_id < 100"))
    mart_cells.append_cells(cells, path, "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        mart_cells.append_cells(cells, path, "1")


def test_median_needs_no_facts(spark, whole):
    """Two halves whose medians differ: their cells give the median of all stays."""
    stays = whole["encounters"].where("encounter_type = 'inpatient' AND discharge_date >= admission_date")
    halves = [cut(whole, encounters=f"datediff(discharge_date, admission_date) {c}") for c in ("< 3", ">= 3")]
    cells = mart_cells.added(*[mart_cells.batch_cells(h).where("metric = 'median_los'") for h in halves])
    got = {r.group_value: r.value for r in mart_cells.marts(cells, whole, ("year",), 1).where("metric = 'median_los'").collect()}
    want = stays.groupBy(F.year("admission_date").cast("string").alias("y")).agg(
        F.percentile(F.datediff("discharge_date", "admission_date"), F.lit(0.5)).alias("m")).collect()
    assert got == {r.y: r.m for r in want}


def test_no_facts(spark, whole):
    none = cut(whole, encounters="false", readmissions="false", encounter_diagnoses="false")
    cells = mart_cells.batch_cells(none)
    assert cells.isEmpty() and mart_cells.marts(cells, whole).isEmpty()
    assert rows(mart_cells.marts(mart_cells.added(cells, mart_cells.batch_cells(whole)), whole)) == rows(
        mart_cells.marts(mart_cells.batch_cells(whole), whole))
