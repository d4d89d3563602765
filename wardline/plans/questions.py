"""The curated business questions."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.local import union_all
from wardline.plans import catalogue as cat
from wardline.plans.views import Tables, ratio

# Purpose of each table, as listed to users.
TABLE_PURPOSES = {
    "patients": "synthetic patient demographics",
    "hospitals": "facility attributes",
    "providers": "provider specialties and experience",
    "encounters": "clinical and financial encounter facts",
    "diagnoses": "diagnosis vocabulary",
    "encounter_diagnoses": "encounter-to-diagnosis bridge",
    "procedures": "procedure vocabulary",
    "encounter_procedures": "encounter-to-procedure bridge",
    "lab_results": "encounter laboratory observations",
    "readmissions": "30-day readmission assessments",
    "quality_measures": "quarterly hospital quality metrics",
}


def row_counts(tables: Tables, entities=None) -> DataFrame:
    """One (entity, row_count) line per entity."""
    counts = [
        tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("entity"), "row_count")
        for name in (entities or list(tables))
    ]
    return union_all(counts)


def dataset_structure(tables: Tables) -> DataFrame:
    """c01: table, purpose, rows."""
    purpose = F.coalesce(*[F.when(F.col("entity") == name, text) for name, text in TABLE_PURPOSES.items()])
    return row_counts(tables, TABLE_PURPOSES).select(
        F.col("entity").alias("table_name"), purpose.alias("purpose"), "row_count")


def patient_count(tables: Tables) -> DataFrame:
    return tables["patients"].agg(F.count("*").alias("patient_count"))


def hospital_count(tables: Tables) -> DataFrame:
    return tables["hospitals"].agg(F.count("*").alias("hospital_count"))


def volume_by_hospital(tables: Tables, year: int = 2025) -> DataFrame:
    return cat.year_encounters(tables, year)


def heart_failure_readmission(tables: Tables, year: int = 2025, min_n: int = 10) -> DataFrame:
    return cat.primary_diagnosis_readmission(tables, min_n=min_n, year=year, rate_name="readmission_rate")


def cost_by_diagnosis(tables: Tables) -> DataFrame:
    """c06: encounters and cost by primary diagnosis; money is summed exactly."""
    primary = tables["encounter_diagnoses"].filter(F.col("primary_diagnosis_flag") == 1).select(
        "encounter_id", "diagnosis_id")
    totals = tables["encounters"].select("encounter_id", "total_cost").join(primary, "encounter_id").groupBy(
        "diagnosis_id").agg(
        F.count("*").alias("encounter_count"), F.sum(F.col("total_cost").cast("decimal(18,2)")).alias("total_cost"))
    return (
        tables["diagnoses"].join(totals, "diagnosis_id")
        .select("diagnosis_name", "encounter_count", F.round("total_cost", 2).alias("total_cost"))
        .orderBy(F.desc("total_cost"), "diagnosis_name")
    )


def complication_rate(tables: Tables, min_n: int = 30) -> DataFrame:
    counted = tables["encounters"].groupBy("hospital_id").agg(
        F.count("*").alias("denominator"), F.sum("complication_flag").alias("numerator")
    ).filter(F.col("denominator") >= min_n)
    return (
        tables["hospitals"].select("hospital_id", "hospital_name").join(counted, "hospital_id")
        .select("hospital_name", "denominator", "numerator",
                ratio("numerator", "denominator").alias("complication_rate"))
        .orderBy(F.desc("complication_rate"), "hospital_name")
    )


def location_readmission(tables: Tables) -> DataFrame:
    """c08: the two proportions the location comparison tests."""
    return cat.readmission_by_location(tables).withColumn(
        "readmission_rate", ratio("numerator", "denominator")).orderBy("urban_rural")


def dataset_bounds(tables: Tables) -> DataFrame:
    """c09: first and last admission next to the table counts."""
    bounds = tables["encounters"].agg(
        F.min("admission_date").alias("first_admission"), F.max("admission_date").alias("last_admission"))
    return row_counts(tables).select(
        "entity", "row_count",
        F.when(F.col("entity") == "encounters", bounds.select("first_admission").scalar()).alias("first_admission"),
        F.when(F.col("entity") == "encounters", bounds.select("last_admission").scalar()).alias("last_admission"))


def cost_by_ownership(tables: Tables, min_n: int = 10) -> DataFrame:
    """c10: mean cost by ownership, from sums per hospital."""
    sums = tables["encounters"].groupBy("hospital_id").agg(
        F.count("*").alias("_n"), F.count("total_cost").alias("_priced"),
        F.sum(F.col("total_cost").cast("decimal(18,2)")).alias("_cost"))
    return (
        tables["hospitals"].select("hospital_id", "ownership_type").join(sums, "hospital_id").groupBy("ownership_type")
        .agg(F.sum("_n").alias("denominator"), F.sum("_priced").alias("_priced"), F.sum("_cost").alias("_cost"))
        .filter(F.col("denominator") >= min_n)
        .select("ownership_type", "denominator", ratio("_cost", "_priced").alias("average_cost"))
        .orderBy(F.desc("average_cost"), "ownership_type")
    )
