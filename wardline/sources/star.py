"""Clinical entities read from the star-schema Parquet tables.

Each entity is a lazy DataFrame over the files; Catalyst prunes what a query
does not use (the provider lookup disappears when ``provider_id`` is not read).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.local import local_table
from wardline.operators.derive import assessed_stays, derive_readmissions, quarterly_rates

# Declared schemas of the input files, so that no footer is read for inference.
FILE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Diagnosis and procedure vocabularies.
DIAGNOSES = (
    (1, "I50.9", "Heart failure", "cardiovascular"),
    (2, "E11.9", "Type 2 diabetes", "endocrine"),
    (3, "N18.9", "Chronic kidney disease", "renal"),
    (4, "J18.9", "Pneumonia", "respiratory"),
    (5, "I10", "Hypertension", "cardiovascular"),
    (6, "A41.9", "Sepsis", "infectious"),
    (7, "J44.1", "COPD exacerbation", "respiratory"),
    (8, "S72.0", "Hip fracture", "injury"),
    (9, "R07.9", "Chest pain", "symptom"),
    (10, "X99.?", "Inconsistent test code", "data_quality"),
)
PROCEDURES = (
    (1, "PROC001", "Echocardiogram", "diagnostic"),
    (2, "PROC002", "CT scan", "imaging"),
    (3, "PROC003", "Dialysis", "therapeutic"),
    (4, "PROC004", "Cardiac catheterization", "therapeutic"),
)


class StarTables:
    """The driver's Parquet tables under one directory, by attribute."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FILE_SCHEMAS:
            raise AttributeError(name)
        frame = self.spark.read.schema(FILE_SCHEMAS[name]).parquet(f"{self.directory}/{name}.parquet")
        self.__dict__[name] = frame
        return frame


class ClinicalTables(Mapping[str, DataFrame]):
    """The eleven entities by name, each planned on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.star = StarTables(spark, directory)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, entity: str) -> DataFrame:
        if entity not in self._built:
            self._built[entity] = _BUILDERS[entity](self)
        return self._built[entity]

    def __iter__(self) -> Iterator[str]:
        return iter(_BUILDERS)

    def __len__(self) -> int:
        return len(_BUILDERS)


def _remainder(column: str, divisor: int) -> Column:
    return F.col(column) % F.lit(divisor)


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def _patients(tables: ClinicalTables) -> DataFrame:
    star = tables.star
    places = star.nation.join(star.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    return star.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (key + 1).alias("patient_id"),
        F.date_add(F.lit("1925-01-01").cast("date"), ((key * 7919) % 31025).cast("int")).alias("birth_date"),
        F.when(_remainder("c_custkey", 20) == 0, "X").when(_remainder("c_custkey", 2) == 0, "F").otherwise("M")
        .alias("sex"),
        F.when(_remainder("c_custkey", 50) != 0, F.concat(F.lit("group "), _remainder("c_custkey", 5).cast("string")))
        .alias("race_ethnicity"),
        F.col("c_mktsegment").alias("insurance_type"),
        F.when(_remainder("c_custkey", 25) != 0, F.col("r_name")).alias("residential_region"),
        F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def _hospitals(tables: ClinicalTables) -> DataFrame:
    star = tables.star
    key = F.col("n_nationkey")
    return star.nation.join(star.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (key.cast("bigint") + 1).alias("hospital_id"),
        F.col("n_name").alias("hospital_name"),
        F.col("r_name").alias("state"),
        F.when(F.col("n_regionkey") >= 3, "rural").otherwise("urban").alias("urban_rural"),
        (key * 20 + 100).alias("bed_count"),
        F.when(_remainder("n_nationkey", 3) == 0, "teaching").otherwise("non-teaching").alias("teaching_status"),
        F.when(_remainder("n_nationkey", 3) == 0, "nonprofit").when(_remainder("n_nationkey", 3) == 1, "public")
        .otherwise("for-profit").alias("ownership_type"),
    )


def _providers(tables: ClinicalTables) -> DataFrame:
    return tables.star.supplier.select(
        (F.col("s_suppkey") + 1).alias("provider_id"),
        (F.col("s_nationkey").cast("bigint") + 1).alias("hospital_id"),
        F.concat(F.lit("specialty "), _remainder("s_suppkey", 6).cast("string")).alias("specialty"),
        _remainder("s_suppkey", 41).cast("int").alias("years_experience"),
    )


def _encounters(tables: ClinicalTables) -> DataFrame:
    star = tables.star
    key = F.col("o_orderkey")
    admitted = F.to_date("o_orderdate")
    lead_provider = star.lineitem.groupBy("l_orderkey").agg((F.min("l_suppkey") + 1).alias("provider_id"))
    home_hospital = star.customer.select("c_custkey", (F.col("c_nationkey").cast("bigint") + 1).alias("hospital_id"))
    return (
        star.orders.join(home_hospital, F.col("o_custkey") == F.col("c_custkey"))
        .join(lead_provider, key == F.col("l_orderkey"), "left")
        .select(
            (key + 1).alias("encounter_id"),
            (F.col("o_custkey") + 1).alias("patient_id"),
            "hospital_id",
            "provider_id",
            F.when(F.col("o_orderstatus") == "F", "inpatient").when(F.col("o_orderstatus") == "O", "emergency")
            .otherwise("outpatient").alias("encounter_type"),
            admitted.alias("admission_date"),
            F.when(_remainder("o_orderkey", 101) == 0, F.lit(None))
            .when(_remainder("o_orderkey", 97) == 0, F.date_sub(admitted, 1))
            .otherwise(F.date_add(admitted, _remainder("o_orderkey", 9).cast("int"))).alias("discharge_date"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "skilled nursing")
            .when(F.col("o_orderpriority") == "2-HIGH", "rehabilitation")
            .when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise("home").alias("discharge_disposition"),
            F.col("o_totalprice").alias("total_cost"),
            (_remainder("o_orderkey", 53) == 0).cast("int").alias("mortality_flag"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("complication_flag"),
        )
    )


def _vocabulary(tables: ClinicalTables, rows: tuple, schema: str) -> DataFrame:
    return local_table(tables.spark, rows, schema)


def _diagnoses(tables: ClinicalTables) -> DataFrame:
    return _vocabulary(
        tables, DIAGNOSES,
        "diagnosis_id BIGINT, diagnosis_code STRING, diagnosis_name STRING, diagnosis_category STRING",
    )


def _procedures(tables: ClinicalTables) -> DataFrame:
    return _vocabulary(
        tables, PROCEDURES,
        "procedure_id BIGINT, procedure_code STRING, procedure_name STRING, procedure_category STRING",
    )


def _encounter_diagnoses(tables: ClinicalTables) -> DataFrame:
    """First line of each diagnosis per encounter, ranked by line.

    The ten diagnoses are folded into ten running minima per encounter, so the
    map side already combines and one shuffle by encounter is enough.
    """
    diagnosis = _remainder("l_partkey", 10) + 1
    first_line = {
        d: F.min(F.when(diagnosis == d, F.col("l_linenumber"))).alias(f"line_{d}") for d, _, _, _ in DIAGNOSES
    }
    ranked = F.array_sort(
        F.filter(
            F.array(*[
                F.struct(F.col(f"line_{d}").alias("line"), F.lit(d).cast("bigint").alias("diagnosis_id"))
                for d in first_line
            ]),
            lambda item: item["line"].isNotNull(),
        )
    )
    return (
        tables.star.lineitem.groupBy("l_orderkey").agg(*first_line.values())
        .select((F.col("l_orderkey") + 1).alias("encounter_id"), F.posexplode(ranked).alias("position", "item"))
        .select(
            "encounter_id",
            F.col("item.diagnosis_id").alias("diagnosis_id"),
            (F.col("position") + 1).alias("diagnosis_rank"),
            (F.col("position") == 0).cast("int").alias("primary_diagnosis_flag"),
        )
    )


def _encounter_procedures(tables: ClinicalTables) -> DataFrame:
    return (
        tables.star.lineitem.filter(F.col("l_returnflag") == "R")
        .groupBy((F.col("l_orderkey") + 1).alias("encounter_id"),
                 (_remainder("l_suppkey", 4) + 1).alias("procedure_id"))
        .agg(F.to_date(F.min("l_shipdate")).alias("procedure_date"))
    )


def _lab_results(tables: ClinicalTables) -> DataFrame:
    return (
        tables.star.lineitem.filter(F.col("l_returnflag") == "A")
        .groupBy((F.col("l_orderkey") + 1).alias("encounter_id"), F.col("l_shipdate").alias("collected_at"))
        .agg(F.max(F.col("l_quantity") * 2 + 60).alias("lab_value"))
        .select(
            F.lit(None).cast("bigint").alias("lab_result_id"),
            "encounter_id",
            F.lit("glucose").alias("lab_name"),
            "lab_value",
            F.lit("mg/dL").alias("unit"),
            F.lit(70.0).alias("reference_low"),
            F.lit(110.0).alias("reference_high"),
            "collected_at",
        )
    )


def _readmissions(tables: ClinicalTables) -> DataFrame:
    return derive_readmissions(tables["encounters"])


def _quality_measures(tables: ClinicalTables) -> DataFrame:
    return quarterly_rates(assessed_stays(tables["encounters"]))  # the assessed stay knows hospital and day: no join back


_BUILDERS = {
    "patients": _patients,
    "hospitals": _hospitals,
    "providers": _providers,
    "encounters": _encounters,
    "diagnoses": _diagnoses,
    "encounter_diagnoses": _encounter_diagnoses,
    "procedures": _procedures,
    "encounter_procedures": _encounter_procedures,
    "lab_results": _lab_results,
    "readmissions": _readmissions,
    "quality_measures": _quality_measures,
}
