"""Metric registry and its computation over the allowed groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.local import local_table, union_all
from wardline.plans.views import Tables, assessed_encounters, length_of_stay, ratio

# Groupings every metric allows, and the default smallest group.
GROUPINGS = ("hospital", "urban_rural", "quarter", "year", "diagnosis")
MINIMUM_SAMPLE = 10

#: metric -> name, numerator, denominator, eligibility, unit, what nulls do, what to bear in mind.
#: Name, eligibility and unit.
DEFINITIONS = {
    "readmission_30d_rate": (
        "30-day readmission rate", "assessed stays followed by another one after 0 to 30 days", "assessed stays",
        "inpatient index encounters with readmission assessment", "proportion", "a stay without assessment is not counted",
        "planned returns count like others; case mix is not taken into account"),
    "mortality_rate": (
        "mortality rate", "encounters whose mortality flag is 1", "encounters", "all encounters", "proportion",
        "a null flag adds nothing to the numerator", "compares groups of different severity as they are"),
    "complication_rate": (
        "complication rate", "encounters whose complication flag is 1", "encounters", "all encounters", "proportion",
        "a null flag adds nothing to the numerator", "compares groups of different severity as they are"),
    "avg_los": (
        "average length of stay", "days from admission to discharge, added up", "inpatient stays with both days",
        "valid nonnegative stay", "days", "open stays and reversed days are left out", "a few long stays weigh heavily"),
    "median_los": (
        "median length of stay", "middle of the days from admission to discharge", "inpatient stays with both days",
        "valid nonnegative stay", "days", "open stays and reversed days are left out", "exact: stays are counted for each number of days"),
    "emergency_conversion_rate": (
        "emergency admission conversion rate", "emergency encounters that did not end at home",
        "emergency encounters with a disposition", "emergency encounters", "proportion", "no disposition, no count",
        "stands in for admissions, which are not recorded as such"),
    "avg_cost": (
        "average encounter cost", "costs added up", "encounters with a cost", "non-null nonnegative cost", "currency",
        "encounters without cost and negative costs are left out", "charges as recorded, without adjustment"),
    "total_cost": (
        "total encounter cost", "costs added up", "none", "non-null nonnegative cost", "currency",
        "encounters without cost and negative costs are left out", "charges as recorded, not what was paid"),
    "encounter_volume": (
        "encounter volume", "encounters", "none", "all encounters", "count", "nothing can be null", "a patient counts once for each encounter"),
    "diagnosis_prevalence": (
        "diagnosis prevalence", "encounters that carry the diagnosis", "encounters", "encounters in cohort", "proportion",
        "encounters without diagnosis stay in the denominator", "say whether only the primary diagnosis counts"),
}


def _inpatient_stays(tables: Tables) -> DataFrame:
    return tables["encounters"].filter(
        (F.col("encounter_type") == "inpatient") & (F.col("discharge_date") >= F.col("admission_date")))


def _priced(tables: Tables) -> DataFrame:
    return tables["encounters"].filter(F.col("total_cost") >= 0)


def _base(metric: str, tables: Tables) -> tuple[DataFrame, Column]:
    """Eligible encounters and the additive numerator of a metric."""
    if metric == "readmission_30d_rate":
        return assessed_encounters(tables), F.col("readmitted_within_30_days").cast("decimal(18,2)")
    if metric == "mortality_rate":
        return tables["encounters"], F.col("mortality_flag").cast("decimal(18,2)")
    if metric == "complication_rate":
        return tables["encounters"], F.col("complication_flag").cast("decimal(18,2)")
    if metric in ("avg_los", "median_los"):
        return _inpatient_stays(tables), length_of_stay().cast("decimal(18,2)")
    if metric == "emergency_conversion_rate":
        emergencies = tables["encounters"].filter(
            (F.col("encounter_type") == "emergency") & F.col("discharge_disposition").isNotNull())
        return emergencies, (F.col("discharge_disposition") != "home").cast("int").cast("decimal(18,2)")
    if metric in ("avg_cost", "total_cost"):
        return _priced(tables), F.col("total_cost").cast("decimal(18,2)")
    if metric == "encounter_volume":
        return tables["encounters"], F.lit(1).cast("decimal(18,2)")
    raise KeyError(f"Unknown metric: {metric}")


def _cells(tables: Tables, base: DataFrame, extra: list[str], aggregates: list[Column]) -> DataFrame:
    """Counts per hospital and quarter: the one pass over the facts that all time and place groupings share.

    Encounters of no known hospital count in the groupings by time.
    """
    hospitals = tables["hospitals"].select("hospital_id", "hospital_name", "urban_rural")
    cells = base.groupBy("hospital_id", F.trunc("admission_date", "quarter").alias("_quarter"), *extra).agg(*aggregates)
    return cells.join(hospitals, "hospital_id", "left").select(
        "hospital_id", F.col("hospital_name").alias("hospital"), "urban_rural", F.col("_quarter").cast("string").alias("quarter"),
        F.year("_quarter").cast("string").alias("year"), *extra,
        *[c for c in cells.columns if c not in {"hospital_id", "_quarter", *extra}])


#: Hospitals are told apart by id, whatever they are called; those groupings leave out encounters of no known hospital.
_KEYS = {"hospital": ("hospital_id", "hospital")}
_OF_KNOWN_HOSPITALS = ("hospital", "urban_rural")


def _grouped(cells: DataFrame, groupings: list[str], aggregates: list[Column], carried: tuple[str, ...] = ()) -> DataFrame:
    """All requested groupings of the pre-aggregated cells in one pass, with the group's label and value."""
    columns = list(dict.fromkeys(c for g in groupings for c in (*_KEYS.get(g, (g,)), *carried)))
    label = F.coalesce(*[F.when(F.grouping(g) == 0, F.lit(g)) for g in groupings])
    value = F.coalesce(*[F.when(F.grouping(g) == 0, F.col(g)) for g in groupings])
    key = F.coalesce(*[F.when(F.grouping(g) == 0, F.col(_KEYS.get(g, (g,))[0]).cast("string")) for g in groupings])
    sets = [[F.col(c) for c in (*_KEYS.get(g, (g,)), *carried)] for g in groupings]
    out = cells.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        label.alias("grouping"), value.alias("group_value"), key.alias("_key"), *aggregates)
    named = F.col("group_value").isNotNull() | ~F.col("grouping").isin(*_OF_KNOWN_HOSPITALS)
    return out.filter(named).drop(*[c for c in columns if c not in carried])


def _by_diagnosis(tables: Tables, base: DataFrame, primary_only: bool) -> DataFrame:
    bridge = tables["encounter_diagnoses"]
    if primary_only:
        bridge = bridge.filter(F.col("primary_diagnosis_flag") == 1)
    return base.join(bridge.select("encounter_id", "diagnosis_id"), "encounter_id")


def metric(
    tables: Tables, name: str, groupings: tuple[str, ...] = GROUPINGS, min_n: int = MINIMUM_SAMPLE,
    primary_only: bool = True,
) -> DataFrame:
    """(metric, grouping, group_value, denominator, value) for every requested grouping.

    ``denominator`` is the number of eligible encounters of the group; groups
    below ``min_n`` are left out.  By diagnosis, ``primary_only`` says whether
    an encounter counts for its primary diagnosis or for each of its diagnoses.
    """
    unknown = set(groupings) - set(GROUPINGS)
    if unknown:
        raise ValueError(f"Grouping not allowed: {sorted(unknown)}")
    if name == "diagnosis_prevalence":
        return diagnosis_prevalence(tables, min_n=min_n, primary_only=primary_only, groupings=groupings)
    base, numerator = _base(name, tables)
    flat = [g for g in groupings if g != "diagnosis"]
    median = name == "median_los"
    parts = []
    if median:
        extra, first = ["_days"], [F.count("*").alias("_n")]
        base = base.withColumn("_days", length_of_stay())
        final = [F.sum("_n").alias("denominator"),
                 F.percentile("_days", F.lit(0.5), F.col("_n")).alias("value")]
    else:
        extra, first = [], [F.count("*").alias("_n"), F.sum(numerator).alias("_total")]
        final = [F.sum("_n").alias("denominator"), F.sum("_total").alias("_sum")]
    if flat:
        parts.append(_grouped(_cells(tables, base, extra, first), flat, final).drop("_key"))
    if "diagnosis" in groupings:
        counted = _by_diagnosis(tables, base, primary_only).groupBy("diagnosis_id", *extra).agg(*first)
        names = tables["diagnoses"].select("diagnosis_id", "diagnosis_name")
        parts.append(
            counted.join(names, "diagnosis_id").groupBy("diagnosis_id", "diagnosis_name").agg(*final).select(
                F.lit("diagnosis").alias("grouping"), F.col("diagnosis_name").alias("group_value"),
                "denominator", "value" if median else "_sum"))
    merged = union_all(parts)
    if not median:
        whole = F.col("_sum").cast("double")
        merged = merged.withColumn(
            "value", whole if name in ("total_cost", "encounter_volume") else ratio("_sum", "denominator"))
    return minimum_sample(
        merged.select(F.lit(name).alias("metric"), "grouping", "group_value", "denominator", "value"), min_n)


def diagnosis_prevalence(
    tables: Tables, min_n: int = MINIMUM_SAMPLE, primary_only: bool = False,
    groupings: tuple[str, ...] = ("diagnosis",), per_group: bool = False,
) -> DataFrame:
    """Share of encounters carrying each diagnosis.

    One line per diagnosis over all encounters; with ``per_group`` (or groupings
    other than diagnosis) the share is taken inside each group as well.
    """
    names = tables["diagnoses"].select("diagnosis_id", "diagnosis_name")
    encounters = tables["encounters"].select("encounter_id", "hospital_id", "admission_date")
    bridge = tables["encounter_diagnoses"]
    if primary_only:
        bridge = bridge.filter(F.col("primary_diagnosis_flag") == 1)
    parts = []
    if "diagnosis" in groupings:
        total = encounters.agg(F.count("*").alias("_all"))
        counted = bridge.join(encounters.select("encounter_id"), "encounter_id", "left_semi").groupBy(
            "diagnosis_id").agg(F.count_distinct("encounter_id").alias("_n"))
        parts.append(counted.join(names, "diagnosis_id").select(
            F.lit("diagnosis").alias("grouping"), F.col("diagnosis_name").alias("group_value"),
            total.scalar().alias("denominator"), F.col("_n").alias("numerator")))
    flat = [g for g in groupings if g != "diagnosis"]
    if flat:
        keyed = bridge.join(names, "diagnosis_id").join(encounters, "encounter_id")
        carriers = _grouped(
            _cells(tables, keyed, ["diagnosis_id", "diagnosis_name"], [F.count("*").alias("_n")]), flat,
            [F.sum("_n").alias("numerator")], ("diagnosis_id", "diagnosis_name"))
        cohort_size = _grouped(_cells(tables, encounters, [], [F.count("*").alias("_n")]), flat,
                               [F.sum("_n").alias("denominator")])
        parts.append(carriers.join(cohort_size.drop("group_value"), ["grouping", "_key"]).select(
            "grouping", F.concat_ws(": ", "group_value", "diagnosis_name").alias("group_value"),
            "denominator", "numerator"))
    merged = union_all(parts)
    return minimum_sample(
        merged.select(F.lit("diagnosis_prevalence").alias("metric"), "grouping", "group_value", "denominator",
                      ratio("numerator", "denominator").alias("value")), min_n)


def minimum_sample(df: DataFrame, min_n: int = MINIMUM_SAMPLE, flag: bool = False) -> DataFrame:
    """Drop groups below ``min_n``, or keep them with a boolean ``below_minimum``."""
    small = F.col("denominator") < min_n
    return df.withColumn("below_minimum", small) if flag else df.filter(~small)


def write_marts(tables: Tables, path: str, names: Sequence[str] = tuple(DEFINITIONS), groupings: tuple[str, ...] = GROUPINGS) -> None:
    """Write the metrics below ``path``, a folder for each."""
    union_all([metric(tables, name, groupings) for name in names]).write.partitionBy("metric").parquet(path)


def read_marts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "metric STRING, grouping STRING, group_value STRING, denominator BIGINT, value DOUBLE").parquet(path).select(
        "metric", "grouping", "group_value", "denominator", "value")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """The registry as a table: one row per metric."""
    rows = [
        (key, *values, MINIMUM_SAMPLE, list(GROUPINGS)) for key, values in DEFINITIONS.items()
    ]
    return local_table(
        spark, rows,
        "metric STRING, name STRING, numerator STRING, denominator STRING, eligibility STRING, unit STRING, "
        "null_handling STRING, caveats STRING, minimum_sample_size INT, allowed_groupings ARRAY<STRING>")


def with_definition(result: DataFrame) -> DataFrame:
    """Attach unit, eligibility and caveats of the registry (ten rows) to metric results."""
    catalog = metric_catalog(result.sparkSession).select(
        "metric", F.col("name").alias("metric_name"), "unit", "eligibility", "caveats")
    return result.join(F.broadcast(catalog), "metric", "left")
