"""Metric marts from cells that later batches add to.

A cell holds counts and sums of one metric: by hospital and quarter, or by
diagnosis; the median length of stay keeps a cell for each number of days.
Cells of batches add up, so a mart over all batches is made from a few cells
per hospital, quarter and diagnosis, and no fact is read a second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.local import union_all
from wardline.plans.metrics import GROUPINGS, MINIMUM_SAMPLE, _grouped, minimum_sample
from wardline.plans.views import Tables, length_of_stay, ratio

CELL_SCHEMA = (
    "family STRING, metric STRING, hospital_id BIGINT, quarter DATE, diagnosis_id BIGINT, days BIGINT, n BIGINT, total DECIMAL(38,2)")
_KEYS = ["family", "metric", "hospital_id", "quarter", "diagnosis_id", "days"]
#: by hospital and quarter; by diagnosis; carriers of a diagnosis by hospital, quarter and diagnosis
PLACE, DIAGNOSIS, CARRIERS = "place", "diagnosis", "carriers"
WHOLE = ("total_cost", "encounter_volume")


def _measure(metric: str, eligible: Column, value: Column, days: Column | None = None) -> Column:
    return F.when(eligible, F.struct(
        F.lit(metric).alias("metric"), value.cast("decimal(18,2)").alias("value"),
        (F.lit(None) if days is None else days).cast("bigint").alias("days")))


def _of_stay() -> Column:
    """What one encounter says of the metrics it is eligible for."""
    kind, leaves, cost = F.col("encounter_type"), F.col("discharge_disposition"), F.col("total_cost")
    stayed = (kind == "inpatient") & (F.col("discharge_date") >= F.col("admission_date"))
    always = F.lit(True)
    return F.array_compact(F.array(
        _measure("mortality_rate", always, F.col("mortality_flag")),
        _measure("complication_rate", always, F.col("complication_flag")),
        _measure("avg_los", stayed, length_of_stay()),
        _measure("median_los", stayed, F.lit(0), length_of_stay()),
        _measure("emergency_conversion_rate", (kind == "emergency") & leaves.isNotNull(), (leaves != "home").cast("int")),
        _measure("avg_cost", cost >= 0, cost), _measure("total_cost", cost >= 0, cost),
        _measure("encounter_volume", always, F.lit(1))))


def _of_assessment() -> Column:
    return F.array(_measure("readmission_30d_rate", F.lit(True), F.col("readmitted_within_30_days")))


def _joined(new: tuple[DataFrame, DataFrame], known: tuple[DataFrame, DataFrame] | None, on: str) -> DataFrame:
    """What new rows of either side add to the join of both: new with all, and known with what is new beside them."""
    (a, b), all_b = new, new[1]
    if known is None:
        return a.join(b, on)
    all_b = known[1].unionByName(b)
    return a.join(all_b, on).unionByName(known[0].join(b, on))


def batch_cells(new: Tables, known: Tables | None = None, primary_only: bool = True) -> DataFrame:
    """The cells that the facts of ``new`` add to those of ``known``.

    Readmissions and diagnoses may come in another batch than their encounter,
    before or after it: every join counts new rows against all, and known ones
    against new.  Of the facts known, keys and the columns of a measure are read
    where a new row may meet them; sums of what is known already are not redone.
    """
    columns = [
        "encounter_id", "hospital_id", F.trunc("admission_date", "quarter").alias("quarter"), "encounter_type", "admission_date",
        "discharge_date", "discharge_disposition", "total_cost", "mortality_flag", "complication_flag"]

    def facts(tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
        bridge = tables["encounter_diagnoses"]
        if primary_only:
            bridge = bridge.where("primary_diagnosis_flag = 1")
        assessed = tables["readmissions"].select(F.col("index_encounter_id").alias("encounter_id"), "readmitted_within_30_days")
        return tables["encounters"].select(*columns), assessed, bridge.select("encounter_id", "diagnosis_id")

    stays, assessed, bridge = facts(new)
    old = facts(known) if known is not None else None
    judged = _joined((assessed, stays), (old[1], old[0]) if old else None, "encounter_id")
    old_judged = old[1].join(old[0], "encounter_id") if old else None
    coded = _joined((stays, bridge), (old[0], old[2]) if old else None, "encounter_id")
    coded_judged = _joined((judged, bridge), (old_judged, old[2]) if old else None, "encounter_id")
    none = F.lit(None)

    def cells(df: DataFrame, family: str, measures: Column) -> DataFrame:
        placed = family == PLACE
        return df.select(
            F.lit(family).alias("family"), F.inline(measures),
            (F.col("hospital_id") if placed else none).cast("bigint").alias("hospital_id"),
            (F.col("quarter") if placed else none).cast("date").alias("quarter"),
            (none if placed else F.col("diagnosis_id")).cast("bigint").alias("diagnosis_id"))

    carriers = coded.select(
        F.lit(CARRIERS).alias("family"), F.lit("diagnosis_prevalence").alias("metric"), F.lit(0).cast("decimal(18,2)").alias("value"),
        none.cast("bigint").alias("days"), "hospital_id", "quarter", "diagnosis_id")
    rows = union_all([
        cells(stays, PLACE, _of_stay()), cells(judged, PLACE, _of_assessment()), cells(coded, DIAGNOSIS, _of_stay()),
        cells(coded_judged, DIAGNOSIS, _of_assessment()), carriers])
    return rows.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.sum("value").cast("decimal(38,2)").alias("total"))


def added(*cells: DataFrame) -> DataFrame:
    """Cells of several batches as those of all of them."""
    return reduce(DataFrame.unionByName, cells).groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"))


def append_cells(cells: DataFrame, root: str, batch: str) -> None:
    """Store a batch's cells below ``root``; a batch is stored once, and one written again is an error."""
    cells.repartition(1).write.mode("errorifexists").parquet(f"{root}/batch={batch}")  # as few as hospitals x quarters x days


def stored_cells(spark: SparkSession, root: str) -> DataFrame:
    return added(spark.read.schema(f"{CELL_SCHEMA}, batch STRING").parquet(root).drop("batch"))


def marts(cells: DataFrame, dimensions: Tables, groupings: tuple[str, ...] = GROUPINGS, min_n: int = MINIMUM_SAMPLE) -> DataFrame:
    """(metric, grouping, group_value, denominator, value) of all metrics, from cells and the hospitals and diagnoses of today."""
    hospitals = dimensions["hospitals"].select("hospital_id", F.col("hospital_name").alias("hospital"), "urban_rural")
    names = dimensions["diagnoses"].select("diagnosis_id", "diagnosis_name")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(hospitals, "hospital_id", "left").withColumns(
            {"year": F.year("quarter").cast("string"), "quarter": F.col("quarter").cast("string")})

    final = [F.sum("n").alias("denominator"), F.sum("total").alias("_sum"), F.percentile("days", F.lit(0.5), F.col("n")).alias("_median")]
    flat = [g for g in groupings if g != "diagnosis"]
    columns = ["metric", "grouping", "group_value", "denominator", "value"]
    value = (
        F.when(F.col("metric") == "median_los", F.col("_median"))
        .when(F.col("metric").isin(*WHOLE), F.col("_sum").cast("double")).otherwise(ratio("_sum", "denominator")))
    found = []
    place = placed(cells.where(F.col("family") == PLACE))
    volume = place.where("metric = 'encounter_volume'")
    carriers = cells.where(F.col("family") == CARRIERS).join(names, "diagnosis_id")
    if flat:
        found.append(_grouped(place, flat, final, ("metric",)).withColumn("value", value).select(*columns))
        size = _grouped(volume, flat, [F.sum("n").alias("denominator")]).drop("group_value")
        held = _grouped(placed(carriers), flat, [F.sum("n").alias("numerator")], ("diagnosis_id", "diagnosis_name"))
        found.append(held.join(size, ["grouping", "_key"]).select(
            F.lit("diagnosis_prevalence").alias("metric"), "grouping", F.concat_ws(": ", "group_value", "diagnosis_name").alias("group_value"),
            "denominator", ratio("numerator", "denominator").alias("value")))
    if "diagnosis" in groupings:
        by_code = cells.where(F.col("family") == DIAGNOSIS).join(names, "diagnosis_id").groupBy("metric", "diagnosis_id", "diagnosis_name").agg(*final)
        found.append(by_code.withColumns({"grouping": F.lit("diagnosis"), "group_value": F.col("diagnosis_name"), "value": value}).select(*columns))
        whole = volume.agg(F.sum("n").alias("denominator"))
        held = carriers.groupBy("diagnosis_id", "diagnosis_name").agg(F.sum("n").alias("numerator"))
        found.append(held.withColumn("denominator", whole.scalar()).select(
            F.lit("diagnosis_prevalence").alias("metric"), F.lit("diagnosis").alias("grouping"), F.col("diagnosis_name").alias("group_value"),
            "denominator", ratio("numerator", "denominator").alias("value")))
    return minimum_sample(union_all(found), min_n)
