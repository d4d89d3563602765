"""SQL over the registered views gives what the DataFrame plans give."""

import pytest

from wardline.plans import catalogue as cat
from wardline.plans.views import register_views
from wardline.sources import storage

STATEMENTS = {
    "SELECT encounter_type, count(*) AS encounter_count FROM encounters GROUP BY ALL": (cat.encounter_volume, {}),
    """SELECT encounter_id, admission_date, discharge_date, julianday(discharge_date) - julianday(admission_date) AS los
       FROM encounters WHERE discharge_date < admission_date""": (cat.negative_stays, {}),
    """SELECT hospital_name, eligible_encounters, readmissions, readmission_rate
       FROM hospital_readmission_summary""": (cat.summary_view, {}),
    """SELECT h.hospital_name, count(*) AS encounter_count FROM encounters e JOIN hospitals h USING (hospital_id)
       WHERE strftime('%Y', admission_date) = '1997' GROUP BY ALL""": (cat.year_encounters, {"year": 1997}),
    """SELECT encounter_id, total_cost FROM encounters WHERE total_cost > :bound
       ORDER BY total_cost DESC, encounter_id LIMIT 100""": (cat.high_cost, {}),
}


@pytest.mark.parametrize("statement", STATEMENTS)
def test_statement(spark, tables, statement):
    register_views(spark, tables)
    build, arguments = STATEMENTS[statement]
    written = spark.sql(statement, args={"bound": 50000}) if ":bound" in statement else spark.sql(statement)
    planned = build(tables, **arguments)
    assert sorted(map(str, written.select(*planned.columns).collect())) == sorted(map(str, planned.collect()))


def test_julian_day(spark, tables):
    register_views(spark, tables)
    row = spark.sql("SELECT julianday(DATE'2000-01-01') AS a, julianday(TIMESTAMP_NTZ'2000-01-01 12:00:00') AS b, "
                    "datetime(DATE'2000-01-01') AS c, strftime('%d.%m.%Y', DATE'2000-01-31') AS d").first()
    assert (row.a, row.b, row.c, row.d) == (2451544.5, 2451545.0, "2000-01-01 00:00:00", "31.01.2000")


def test_catalog_lists_keys_and_views(spark, tables):
    register_views(spark, tables)
    rows = {(r.relation, r.column_name): r for r in storage.catalog_listing(spark).collect()}
    assert rows["encounters", "encounter_id"].primary_key and not rows["encounters", "patient_id"].primary_key
    assert rows["encounters", "discharge_date"].nullable and ("encounter_facts", "length_of_stay") in rows


def test_clustered_files_do_not_overlap(spark, tables):
    from pyspark.sql import functions as F

    root = storage.workspace(spark, "cluster")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = storage.write_version(tables["encounters"], root, "gold", "encounters", (), ("admission_date", "encounter_id"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spans = sorted(
        (r.low, r.high) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(
            F.min("admission_date").alias("low"), F.max("admission_date").alias("high")).collect())
    assert len(spans) > 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
