"""The two named views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.sql_names import register_sql_functions

Tables = Mapping[str, DataFrame]


def length_of_stay() -> Column:
    return F.datediff("discharge_date", "admission_date")


def ratio(numerator: str, denominator: str) -> Column:
    """Double ratio; null when the denominator is zero or null."""
    return F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))


def encounter_facts(tables: Tables) -> DataFrame:
    hospitals = tables["hospitals"].select("hospital_id", "hospital_name", "urban_rural")
    encounters = tables["encounters"]
    return encounters.join(hospitals, "hospital_id").select(
        *encounters.columns, "hospital_name", "urban_rural", length_of_stay().alias("length_of_stay")
    )


def assessed_encounters(tables: Tables) -> DataFrame:
    """Encounters joined to their readmission assessment."""
    return tables["readmissions"].join(
        tables["encounters"], F.col("index_encounter_id") == F.col("encounter_id")
    )


def hospital_readmission_summary(tables: Tables) -> DataFrame:
    """Every hospital, also without assessed stays: count 0, sum and rate null."""
    counted = assessed_encounters(tables).groupBy("hospital_id").agg(
        F.count("*").alias("_assessed"), F.sum("readmitted_within_30_days").alias("readmissions")
    )
    return (
        tables["hospitals"].select("hospital_id", "hospital_name").join(counted, "hospital_id", "left")
        .withColumn("eligible_encounters", F.coalesce("_assessed", F.lit(0)))
        .select("hospital_id", "hospital_name", "eligible_encounters", "readmissions",
                ratio("readmissions", "eligible_encounters").alias("readmission_rate"))
    )


def register_views(spark: SparkSession, tables: Tables) -> list[str]:
    """Temp views for the eleven entities and the two named views, and the SQL names Spark lacks."""
    register_sql_functions(spark)
    frames = {name: tables[name] for name in tables}
    frames["encounter_facts"] = encounter_facts(tables)
    frames["hospital_readmission_summary"] = hospital_readmission_summary(tables)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return sorted(frames)
