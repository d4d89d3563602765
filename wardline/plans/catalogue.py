"""The twenty numbered analytical queries over the clinical tables.

Facts are aggregated by key before a dimension is joined, so a join never sees
more than one row per key, whatever the size of the dimension.  Join strategy
is left to Spark, which broadcasts a side only when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.derive import READMISSION_MEASURE, diagnosed_encounters
from wardline.sources.storage import materialize
from wardline.plans.views import Tables, assessed_encounters, hospital_readmission_summary, length_of_stay, ratio

# The codes the cohort queries look for.
HEART_FAILURE = "I50.9"
DIABETES = "E11.9"
KIDNEY_DISEASE = "N18.9"


def admitted_in(year: int) -> Column:
    """Half-open year, written as a range so that it reaches the scan."""
    day = F.col("admission_date")
    return (day >= F.lit(f"{year}-01-01").cast("date")) & (day < F.lit(f"{year + 1}-01-01").cast("date"))


def _named(counted: DataFrame, tables: Tables, how: str = "inner") -> DataFrame:
    names = tables["hospitals"].select("hospital_id", "hospital_name")
    return names.join(counted, "hospital_id", how)


def encounter_volume(tables: Tables) -> DataFrame:
    """q01: encounters by type."""
    return (
        tables["encounters"].groupBy("encounter_type").agg(F.count("*").alias("encounter_count"))
        .orderBy(F.desc("encounter_count"), "encounter_type")
    )


def year_encounters(tables: Tables, year: int = 2025) -> DataFrame:
    """q02: encounters by hospital in one year."""
    counted = tables["encounters"].filter(admitted_in(year)).groupBy("hospital_id").agg(
        F.count("*").alias("encounter_count"))
    return _named(counted, tables).select("hospital_name", "encounter_count").orderBy(
        F.desc("encounter_count"), "hospital_name")


def high_cost(tables: Tables, minimum_cost: float = 50000.0, top: int = 100) -> DataFrame:
    """q03: the dearest encounters above a bound."""
    return (
        tables["encounters"].filter(F.col("total_cost") > minimum_cost).select("encounter_id", "total_cost")
        .orderBy(F.desc("total_cost"), "encounter_id").limit(top)
    )


def provider_volume(tables: Tables) -> DataFrame:
    """q04: encounters per provider; encounters without one do not count."""
    counted = tables["encounters"].filter(F.col("provider_id").isNotNull()).groupBy("provider_id").agg(
        F.count("*").alias("encounters"))
    return (
        tables["providers"].select("provider_id", "specialty").join(counted, "provider_id")
        .select("provider_id", "specialty", "encounters").orderBy(F.desc("encounters"), "provider_id")
    )


def all_hospitals(tables: Tables, since: str = "2025-01-01") -> DataFrame:
    """q05: every hospital with its encounters since a day, zero included."""
    counted = tables["encounters"].filter(F.col("admission_date") >= F.lit(since).cast("date")).groupBy(
        "hospital_id").agg(F.count("*").alias("_n"))
    return _named(counted, tables, "left").select(
        "hospital_name", F.coalesce("_n", F.lit(0)).alias("encounters"))


def comorbidity_cohort(tables: Tables, cohort_code: str = DIABETES, other_code: str = KIDNEY_DISEASE) -> DataFrame:
    """q06: stays of a diagnosis cohort, with and without a second diagnosis.

    Both flags come from one pass over the bridge, grouped by encounter.
    """
    wanted = tables["diagnoses"].filter(F.col("diagnosis_code").isin(cohort_code, other_code)).select(
        "diagnosis_id", "diagnosis_code")
    flags = (
        tables["encounter_diagnoses"].join(wanted, "diagnosis_id").groupBy("encounter_id")
        .agg(F.bool_or(F.col("diagnosis_code") == cohort_code).alias("in_cohort"),
             F.bool_or(F.col("diagnosis_code") == other_code).alias("has_other"))
        .filter("in_cohort")
    )
    return (
        tables["encounters"].filter(F.col("discharge_date") >= F.col("admission_date")).join(flags, "encounter_id")
        .groupBy(F.when(F.col("has_other"), "CKD").otherwise("No CKD").alias("ckd_group"))
        .agg(F.count("*").alias("n"), F.avg(length_of_stay().cast("double")).alias("avg_los"))
    )


def primary_diagnosis_stays(tables: Tables, code: str, year: int | None = None) -> DataFrame:
    """Assessed stays whose primary diagnosis is ``code``."""
    stays = assessed_encounters(tables)
    if year is not None:
        stays = stays.filter(admitted_in(year))
    return stays.join(diagnosed_encounters(tables, [code], primary_only=True), "encounter_id", "left_semi")


def readmission_counts(stays: DataFrame, by: str) -> DataFrame:
    return stays.groupBy(by).agg(
        F.count("*").alias("denominator"), F.sum("readmitted_within_30_days").alias("numerator"))


def primary_diagnosis_readmission(
    tables: Tables, code: str = HEART_FAILURE, min_n: int = 10, by: str = "hospital_name", year: int | None = None,
    rate_name: str = "rate",
) -> DataFrame:
    """q07: readmission rate of a primary diagnosis, by a hospital attribute."""
    counted = readmission_counts(primary_diagnosis_stays(tables, code, year), "hospital_id")
    if by == "hospital_name":
        grouped = _named(counted, tables)
    else:
        grouped = (
            tables["hospitals"].select("hospital_id", by).join(counted, "hospital_id").groupBy(by)
            .agg(F.sum("denominator").alias("denominator"), F.sum("numerator").alias("numerator"))
        )
    return (
        grouped.filter(F.col("denominator") >= min_n)
        .select(by, "numerator", "denominator", ratio("numerator", "denominator").alias(rate_name))
        .orderBy(F.desc(rate_name), by)
    )


def emergency_conversion(tables: Tables) -> DataFrame:
    """q08: share of emergency encounters with a known disposition other than home."""
    return (
        tables["encounters"]
        .filter((F.col("encounter_type") == "emergency") & F.col("discharge_disposition").isNotNull())
        .agg(F.sum((F.col("discharge_disposition") != "home").cast("bigint")).alias("numerator"),
             F.count("*").alias("denominator"))
        .withColumn("rate", ratio("numerator", "denominator"))
    )


def complications_minimum(tables: Tables, min_n: int = 30) -> DataFrame:
    """q09: complication rate of hospitals with enough encounters."""
    counted = tables["encounters"].groupBy("hospital_id").agg(
        F.count("*").alias("n"), F.avg(F.col("complication_flag").cast("double")).alias("complication_rate")
    ).filter(F.col("n") >= min_n)
    return _named(counted, tables).select("hospital_name", "n", "complication_rate").orderBy(
        F.desc("complication_rate"), "hospital_name")


def _quarterly(tables: Tables, measure: str) -> DataFrame:
    return tables["quality_measures"].filter(F.col("measure_name") == measure)


def quarter_change(tables: Tables, measure: str = READMISSION_MEASURE) -> DataFrame:
    """q10: measure against the hospital's quarter before (a hospital has one row per quarter)."""
    by_quarter = W.partitionBy("hospital_id").orderBy("measurement_period_start")
    changes = _quarterly(tables, measure).withColumn("prior_rate", F.lag("measure_value").over(by_quarter)).filter(
        F.col("prior_rate").isNotNull())
    return (
        _named(changes, tables)
        .select("hospital_name", "measurement_period_start", "measure_value", "prior_rate",
                (F.col("measure_value") - F.col("prior_rate")).alias("change"))
        .orderBy("change", "hospital_name", "measurement_period_start")
    )


def cost_rank(tables: Tables) -> DataFrame:
    """q11: hospitals ranked by mean cost; the window runs over one row per hospital."""
    means = tables["encounters"].groupBy("hospital_id").agg(F.avg("total_cost").alias("avg_cost"))
    return _named(means, tables).select(
        "hospital_name", "avg_cost", F.rank().over(W.orderBy(F.desc_nulls_last("avg_cost"))).alias("cost_rank"))


def diagnosis_dense_rank(tables: Tables) -> DataFrame:
    """q12: diagnoses ranked by volume; the window runs over one row per diagnosis."""
    volumes = tables["encounter_diagnoses"].groupBy("diagnosis_id").agg(F.count("*").alias("volume"))
    return tables["diagnoses"].join(volumes, "diagnosis_id").select(
        "diagnosis_name", "volume", F.dense_rank().over(W.orderBy(F.desc("volume"))).alias("volume_rank"))


def latest_per_patient(tables: Tables, top: int = 100) -> DataFrame:
    """q13: newest encounter of each patient, first ``top`` patients.

    A maximum per patient combines on the map side, so a patient with very many
    encounters costs no more than one row per task.
    """
    newest = F.max(F.struct("admission_date", "encounter_id")).alias("_newest")
    return (
        tables["encounters"].groupBy("patient_id").agg(newest)
        .select("patient_id", F.col("_newest.encounter_id").alias("encounter_id"),
                F.col("_newest.admission_date").alias("admission_date"))
        .orderBy("patient_id").limit(top)
    )


def rolling_average(tables: Tables, measure: str = READMISSION_MEASURE, quarters: int = 3) -> DataFrame:
    """q14: rolling mean of a quarterly measure, by hospital."""
    recent = W.partitionBy("hospital_id").orderBy("measurement_period_start").rowsBetween(1 - quarters, 0)
    return _quarterly(tables, measure).select(
        "hospital_id", "measurement_period_start", F.avg("measure_value").over(recent).alias("rolling_rate"))


def above_average(tables: Tables, top: int = 100) -> DataFrame:
    """q15: encounters dearer than the overall mean (a one-row scalar subquery)."""
    encounters = tables["encounters"].select("encounter_id", "total_cost")
    mean = tables["encounters"].agg(F.avg("total_cost")).scalar()
    return encounters.filter(F.col("total_cost") > mean).orderBy(F.desc("total_cost"), "encounter_id").limit(top)


def negative_stays(tables: Tables) -> DataFrame:
    """q16: discharge before admission."""
    return tables["encounters"].filter(F.col("discharge_date") < F.col("admission_date")).select(
        "encounter_id", "admission_date", "discharge_date", length_of_stay().cast("double").alias("los"))


def outlier_cost(tables: Tables, factor: float = 3.0, top: int = 100) -> DataFrame:
    """q17: cost above a multiple of the hospital mean.

    Means are aggregated (one row per hospital) and joined back; a window would
    put each hospital's encounters into one task.  The means are written first,
    so Spark knows their real size and broadcasts them only if that allows;
    otherwise the join is a sort-merge join whose skewed keys AQE splits.
    """
    means = materialize(
        tables["encounters"].groupBy("hospital_id").agg(F.avg("total_cost").alias("hospital_mean")), "means")
    return (
        tables["encounters"].select("encounter_id", "hospital_id", "total_cost").join(means, "hospital_id")
        .filter(F.col("total_cost") > F.lit(factor) * F.col("hospital_mean"))
        .select("encounter_id", "hospital_id", "total_cost", "hospital_mean")
        .orderBy(F.desc("total_cost"), "encounter_id").limit(top)
    )


def readmission_by_location(tables: Tables) -> DataFrame:
    """Assessed and readmitted stays, urban against rural."""
    counted = readmission_counts(assessed_encounters(tables), "hospital_id")
    return tables["hospitals"].select("hospital_id", "urban_rural").join(counted, "hospital_id").groupBy(
        "urban_rural").agg(F.sum("denominator").alias("denominator"), F.sum("numerator").alias("numerator"))


def contingency(tables: Tables) -> DataFrame:
    """q18: readmitted and not readmitted, urban against rural."""
    return readmission_by_location(tables).select(
        "urban_rural", F.col("numerator").alias("readmitted"),
        (F.col("denominator") - F.col("numerator")).alias("not_readmitted"))


def summary_view(tables: Tables) -> DataFrame:
    """q19: the readmission summary, highest rate first, hospitals without a rate last."""
    return hospital_readmission_summary(tables).select(
        "hospital_name", "eligible_encounters", "readmissions", "readmission_rate"
    ).orderBy(F.desc_nulls_last("readmission_rate"), "hospital_name")


def hospital_period_count(tables: Tables, hospital_id: int, start_date: str, end_date: str) -> DataFrame:
    """q20: encounters of one hospital in a half-open period."""
    day = F.col("admission_date")
    return tables["encounters"].filter(
        (F.col("hospital_id") == hospital_id) & (day >= F.lit(start_date).cast("date"))
        & (day < F.lit(end_date).cast("date"))
    ).agg(F.count("*").alias("encounter_count"))
