"""Bucketed lead and lag against a plain window, with one patient holding a third of the rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.derive import derive_readmissions
from wardline.operators.neighbours import hot_groups, id_block, neighbours


@pytest.fixture(scope="module")
def stays(spark):
    rng = random.Random(7)
    rows = []
    for n in range(3000):
        patient = 1 if n % 3 == 0 else rng.randint(2, 200)
        day = date(2024, 1, 1) + timedelta(days=rng.randint(0, 40 if patient == 1 else 700))
        stay = rng.choice([None, -1, 0, 1, 5, 20])
        rows.append((n + 1, patient, rng.choice(["inpatient", "emergency"]), day,
                     None if stay is None else day + timedelta(days=stay)))
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, "encounter_id BIGINT, patient_id BIGINT, encounter_type STRING, admission_date DATE, discharge_date DATE")


def expected(stays):
    window = W.partitionBy("patient_id").orderBy("admission_date", "encounter_id")
    return stays.select(
        "encounter_id", F.lead("encounter_id").over(window).alias("after"), F.lag("encounter_id").over(window).alias("before"))


@pytest.mark.parametrize("partitions, hot_rows", [(1, 0), (17, 0), (3, 20), (3, 900), (3, 10**6)])
def test_same_as_one_window(stays, partitions, hot_rows):
    """With every group cut, some, one, or none."""
    assert len(hot_groups(stays, ["patient_id"], 900)) == 1
    source = stays.repartition(partitions).withColumn("_block", id_block("encounter_id", bits=3))
    found = neighbours(
        source, ["patient_id"], ["admission_date", "_block"], ["admission_date", "encounter_id"],
        ["encounter_id", "admission_date"], "_next", "_previous", hot_rows=hot_rows,
    ).select("encounter_id", F.col("_next.encounter_id").alias("after"), F.col("_previous.encounter_id").alias("before"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected(stays).collect()))


@pytest.mark.parametrize("hot_rows", [0, 3, 100])
def test_null_days_and_null_groups_are_values(spark, hot_rows):
    rows = [(1, 1, None), (2, 1, None), (3, 1, date(2024, 1, 1)), (4, None, date(2024, 1, 1)), (5, None, None), (6, None, date(2024, 1, 3)), (7, 1, None)]
    source = spark.createDataFrame(rows, "encounter_id BIGINT, patient_id BIGINT, admission_date DATE")
    cut = source.withColumn("_block", id_block("encounter_id", bits=1))
    found = neighbours(
        cut, ["patient_id"], ["admission_date", "_block"], ["admission_date", "encounter_id"], ["encounter_id"], "_next", "_previous", hot_rows=hot_rows,
    ).select("encounter_id", F.col("_next.encounter_id").alias("after"), F.col("_previous.encounter_id").alias("before"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected(source).collect()))
    assert dict(found.select("encounter_id", "after").collect()) == {1: 2, 2: 7, 7: 3, 3: None, 5: 4, 4: 6, 6: None}


@pytest.mark.parametrize("hot_rows", [900, 10**6])
def test_readmissions_follow_the_next_stay(stays, hot_rows):
    found = {r.index_encounter_id: r for r in derive_readmissions(stays, hot_rows=hot_rows).collect()}
    rows = {r.encounter_id: r for r in stays.collect()}
    links = {r.encounter_id: r.after for r in expected(stays).collect()}
    inpatient = [r for r in rows.values() if r.encounter_type == "inpatient"]
    assert len(found) == len(inpatient)
    for row in inpatient:
        after = rows.get(links[row.encounter_id])
        gap = (after.admission_date - row.discharge_date).days if after and row.discharge_date else None
        within = gap is not None and 0 <= gap <= 30
        mine = found[row.encounter_id]
        assert mine.readmitted_within_30_days == int(within)
        assert mine.days_to_readmission == (gap if within else None)
        assert mine.readmission_encounter_id == (after.encounter_id if within else None)
