"""Entities and row sets derived from encounters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.neighbours import HOT_ROWS, id_block, neighbours

READMISSION_MEASURE = "30-day readmission rate"


def assessed_stays(encounters: DataFrame, window_days: int = 30, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inpatient stays with the readmission columns: was the patient's next stay within ``window_days``?

    The next stay is the following row of the patient by (admission, id), stays
    without an admission day first.  Patients of more than ``hot_rows`` stays are
    cut by admission day and id block, so none has to fit in one task.
    """
    stays = encounters.select("encounter_id", "patient_id", "hospital_id", "encounter_type", "admission_date", "discharge_date")
    stays = stays.withColumn("_block", id_block("encounter_id"))
    followed = neighbours(
        stays,
        group=["patient_id"],
        buckets=["admission_date", "_block"],
        order=["admission_date", "encounter_id"],
        payload=["encounter_id", "admission_date"],
        hot_rows=hot_rows,
    )
    gap = F.datediff(F.col("_next.admission_date"), F.col("discharge_date"))
    within = F.coalesce(gap.between(0, window_days), F.lit(False))
    return followed.filter(F.col("encounter_type") == "inpatient").select(
        F.col("encounter_id").alias("readmission_id"),
        F.col("encounter_id").alias("index_encounter_id"),
        F.when(within, F.col("_next.encounter_id")).alias("readmission_encounter_id"),
        F.when(within, gap).alias("days_to_readmission"),
        within.cast("int").alias("readmitted_within_30_days"),
        "hospital_id",
        "admission_date",
    )


def derive_readmissions(encounters: DataFrame, window_days: int = 30, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One assessment per inpatient stay, as by :func:`assessed_stays`."""
    stays = encounters if "hospital_id" in encounters.columns else encounters.withColumn("hospital_id", F.lit(None).cast("bigint"))
    return assessed_stays(stays, window_days, hot_rows).drop("hospital_id", "admission_date")


def derive_quality_measures(encounters: DataFrame, readmissions: DataFrame) -> DataFrame:
    """Quarterly readmission rate per hospital, from assessments and the stays they belong to."""
    return quarterly_rates(readmissions.join(encounters, F.col("index_encounter_id") == F.col("encounter_id")))


def quarterly_rates(assessed: DataFrame) -> DataFrame:
    """Quality measures of assessed stays that know their hospital and admission day."""
    quarter = F.trunc("admission_date", "quarter")
    counted = (
        assessed.groupBy("hospital_id", quarter.alias("measurement_period_start"))
        .agg(F.sum("readmitted_within_30_days").cast("int").alias("numerator"),
             F.count("*").cast("int").alias("denominator"))
    )
    start = F.col("measurement_period_start")
    return counted.select(
        (F.col("hospital_id") * 100000 + F.year(start) * 10 + F.quarter(start)).alias("quality_measure_id"),
        "hospital_id",
        F.lit(READMISSION_MEASURE).alias("measure_name"),
        "measurement_period_start",
        F.date_sub(F.add_months(start, 3), 1).alias("measurement_period_end"),
        "numerator",
        "denominator",
        (F.col("numerator") / F.col("denominator")).alias("measure_value"),
    )


def lab_abnormal_flag(labs: DataFrame) -> DataFrame:
    """Each result against its own limits: low, normal, high, or unknown without a value."""
    value = F.col("lab_value")
    flag = (
        F.when(value.isNull(), "unknown")
        .when(value < F.col("reference_low"), "low")
        .when(value > F.col("reference_high"), "high")
        .otherwise("normal")
    )
    return labs.withColumn("abnormal_flag", flag)


def diagnosed_encounters(tables, codes: list[str], primary_only: bool = False) -> DataFrame:
    """Distinct encounter ids carrying one of ``codes``."""
    bridge = tables["encounter_diagnoses"]
    if primary_only:
        bridge = bridge.filter(F.col("primary_diagnosis_flag") == 1)
    wanted = tables["diagnoses"].filter(F.col("diagnosis_code").isin(codes)).select("diagnosis_id")
    return bridge.join(wanted, "diagnosis_id", "left_semi").select("encounter_id").distinct()


def cohort(tables, with_codes: list[str], without_codes: list[str] | None = None,
           primary_only: bool = False) -> DataFrame:
    """Encounters that carry a diagnosis of the first list and none of the second."""
    members = tables["encounters"].join(
        diagnosed_encounters(tables, with_codes, primary_only), "encounter_id", "left_semi"
    )
    if without_codes:
        members = members.join(diagnosed_encounters(tables, without_codes), "encounter_id", "left_anti")
    return members
