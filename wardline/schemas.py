"""Declared schemas, keys, references and constraints of the eleven clinical entities.

Nothing here is inferred from data.  Dates stay ISO text in the raw and bronze
layers and become DATE / TIMESTAMP_NTZ from silver on (``typed=True``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, types and nullability of each entity.
ENTITY_FIELDS: dict[str, tuple[tuple[str, str, bool], ...]] = {
    "patients": (
        ("patient_id", "long", False),
        ("birth_date", "string", False),
        ("sex", "string", False),
        ("race_ethnicity", "string", True),
        ("insurance_type", "string", False),
        ("residential_region", "string", True),
        ("created_at", "string", False),
    ),
    "hospitals": (
        ("hospital_id", "long", False),
        ("hospital_name", "string", False),
        ("state", "string", False),
        ("urban_rural", "string", False),
        ("bed_count", "integer", False),
        ("teaching_status", "string", False),
        ("ownership_type", "string", False),
    ),
    "providers": (
        ("provider_id", "long", False),
        ("hospital_id", "long", False),
        ("specialty", "string", False),
        ("years_experience", "integer", False),
    ),
    "encounters": (
        ("encounter_id", "long", False),
        ("patient_id", "long", False),
        ("hospital_id", "long", False),
        ("provider_id", "long", True),
        ("encounter_type", "string", False),
        ("admission_date", "string", False),
        ("discharge_date", "string", True),
        ("discharge_disposition", "string", True),
        ("total_cost", "double", True),
        ("mortality_flag", "integer", False),
        ("complication_flag", "integer", False),
    ),
    "diagnoses": (
        ("diagnosis_id", "long", False),
        ("diagnosis_code", "string", False),
        ("diagnosis_name", "string", False),
        ("diagnosis_category", "string", False),
    ),
    "encounter_diagnoses": (
        ("encounter_id", "long", False),
        ("diagnosis_id", "long", False),
        ("diagnosis_rank", "integer", False),
        ("primary_diagnosis_flag", "integer", False),
    ),
    "procedures": (
        ("procedure_id", "long", False),
        ("procedure_code", "string", False),
        ("procedure_name", "string", False),
        ("procedure_category", "string", False),
    ),
    "encounter_procedures": (
        ("encounter_id", "long", False),
        ("procedure_id", "long", False),
        ("procedure_date", "string", False),
    ),
    "lab_results": (
        ("lab_result_id", "long", True),
        ("encounter_id", "long", False),
        ("lab_name", "string", False),
        ("lab_value", "double", True),
        ("unit", "string", True),
        ("reference_low", "double", True),
        ("reference_high", "double", True),
        ("collected_at", "string", False),
    ),
    "readmissions": (
        ("readmission_id", "long", False),
        ("index_encounter_id", "long", False),
        ("readmission_encounter_id", "long", True),
        ("days_to_readmission", "integer", True),
        ("readmitted_within_30_days", "integer", False),
    ),
    "quality_measures": (
        ("quality_measure_id", "long", False),
        ("hospital_id", "long", False),
        ("measure_name", "string", False),
        ("measurement_period_start", "string", False),
        ("measurement_period_end", "string", False),
        ("numerator", "integer", False),
        ("denominator", "integer", False),
        ("measure_value", "double", False),
    ),
}

# Primary keys.
ENTITY_KEYS: dict[str, tuple[str, ...]] = {
    "patients": ("patient_id",),
    "hospitals": ("hospital_id",),
    "providers": ("provider_id",),
    "encounters": ("encounter_id",),
    "diagnoses": ("diagnosis_id",),
    "encounter_diagnoses": ("encounter_id", "diagnosis_id"),
    "procedures": ("procedure_id",),
    "encounter_procedures": ("encounter_id", "procedure_id"),
    "lab_results": ("encounter_id", "lab_name", "collected_at"),
    "readmissions": ("readmission_id",),
    "quality_measures": ("quality_measure_id",),
}

# Further uniqueness rules of the serving schema.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "hospitals": (("hospital_name",),),
    "procedures": (("procedure_code",),),
    "readmissions": (("index_encounter_id",),),
    "quality_measures": (("hospital_id", "measure_name", "measurement_period_start"),),
}

# Declared references (child entity, child column, parent entity, parent column).
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("encounters", "patient_id", "patients", "patient_id"),
    ("encounters", "hospital_id", "hospitals", "hospital_id"),
    ("encounters", "provider_id", "providers", "provider_id"),
    ("providers", "hospital_id", "hospitals", "hospital_id"),
    ("encounter_diagnoses", "encounter_id", "encounters", "encounter_id"),
    ("encounter_diagnoses", "diagnosis_id", "diagnoses", "diagnosis_id"),
    ("encounter_procedures", "encounter_id", "encounters", "encounter_id"),
    ("encounter_procedures", "procedure_id", "procedures", "procedure_id"),
    ("lab_results", "encounter_id", "encounters", "encounter_id"),
    ("readmissions", "index_encounter_id", "encounters", "encounter_id"),
    ("readmissions", "readmission_encounter_id", "encounters", "encounter_id"),
    ("quality_measures", "hospital_id", "hospitals", "hospital_id"),
)

# The references a silver gate looks at.
LAKE_REFERENCES = tuple(
    r for r in REFERENCES
    if (r[0], r[1]) in {("encounters", "patient_id"), ("encounters", "hospital_id"), ("lab_results", "encounter_id")}
)

# Row constraints, as Spark SQL predicates that must not be false.
CHECKS: tuple[tuple[str, str, str], ...] = (
    ("patients", "sex", "sex IN ('F','M','X')"),
    ("hospitals", "urban_rural", "urban_rural IN ('urban','rural')"),
    ("hospitals", "bed_count", "bed_count > 0"),
    ("providers", "years_experience", "years_experience BETWEEN 0 AND 60"),
    ("encounters", "encounter_type", "encounter_type IN ('inpatient','emergency','outpatient')"),
    ("encounters", "total_cost", "total_cost >= 0"),
    ("encounters", "mortality_flag", "mortality_flag IN (0,1)"),
    ("encounters", "complication_flag", "complication_flag IN (0,1)"),
    ("encounter_diagnoses", "diagnosis_rank", "diagnosis_rank > 0"),
    ("encounter_diagnoses", "primary_diagnosis_flag", "primary_diagnosis_flag IN (0,1)"),
    ("readmissions", "readmitted_within_30_days", "readmitted_within_30_days IN (0,1)"),
    ("readmissions", "days_to_readmission", "days_to_readmission >= 0"),
    ("quality_measures", "denominator", "denominator > 0"),
    ("quality_measures", "measure_value", "measure_value BETWEEN 0 AND 1"),
)

# Categorical domains tested by the silver gate (a null fails).
DOMAINS: dict[str, tuple[str, tuple[str, ...]]] = {
    "patients": ("sex", ("F", "M", "X")),
    "encounters": ("encounter_type", ("inpatient", "emergency", "outpatient")),
}

# Layer order, required gold entities, load order (parents first).
LAYERS = ("raw", "bronze", "silver", "gold")
REQUIRED_GOLD = ("patients", "encounters", "quality_measures")
LOAD_ORDER = (
    "hospitals", "providers", "patients", "diagnoses", "procedures", "encounters",
    "encounter_diagnoses", "encounter_procedures", "lab_results", "readmissions", "quality_measures",
)

# Layout of gold files: year, quarter and period filters run over the admission day.
CLUSTER_KEYS = {"encounters": ("admission_date", "encounter_id")}

# Physical columns each lake row carries.  The source file makes the row order total over several files.
ROW_ORDER = "_lake_row_order"
SOURCE_FILE = "_lake_source_file"
BATCH_ID = "_lake_source_batch_id"
RECORD_HASH = "_lake_record_hash"
QUALITY_FLAGS = "_lake_quality_flags"
REJECTION_REASON = "_lake_rejection_reason"
LAKE_COLUMNS = (SOURCE_FILE, ROW_ORDER, BATCH_ID, RECORD_HASH, QUALITY_FLAGS, REJECTION_REASON)

_SPARK_TYPES = {
    "long": T.LongType(),
    "integer": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def is_date_column(name: str) -> bool:
    return name.endswith("_date") or name.startswith("measurement_period_")


def is_timestamp_column(name: str) -> bool:
    return name.endswith("_at")


def columns(entity: str) -> list[str]:
    return [name for name, _, _ in ENTITY_FIELDS[entity]]


def entity_schema(entity: str, typed: bool = False) -> T.StructType:
    """Logical schema; ``typed`` turns ISO text columns into date / timestamp columns."""
    fields = []
    for name, kind, nullable in ENTITY_FIELDS[entity]:
        data_type = _SPARK_TYPES[kind]
        if typed and is_date_column(name):
            data_type = T.DateType()
        elif typed and is_timestamp_column(name):
            data_type = T.TimestampNTZType()
        fields.append(T.StructField(name, data_type, nullable))
    return T.StructType(fields)


def lake_schema(entity: str, typed: bool = False) -> T.StructType:
    """Logical columns followed by the physical lake columns."""
    return T.StructType(
        entity_schema(entity, typed).fields
        + [
            T.StructField(SOURCE_FILE, T.StringType(), True),
            T.StructField(ROW_ORDER, T.LongType(), False),
            T.StructField(BATCH_ID, T.StringType(), True),
            T.StructField(RECORD_HASH, T.StringType(), False),
            T.StructField(QUALITY_FLAGS, T.ArrayType(T.StringType()), False),
            T.StructField(REJECTION_REASON, T.StringType(), True),
        ]
    )


def layer_transition(source: str, target: str) -> str:
    """Name of the step ``source`` -> ``target``; only neighbouring layers are allowed."""
    if source not in LAYERS or target not in LAYERS or LAYERS.index(target) - LAYERS.index(source) != 1:
        raise ValueError(f"Layer step not allowed: {source} to {target}")
    return f"{source}-to-{target}"
