"""SQL names that clinical SQL texts use and Spark lacks, as inlined SQL functions (no Python involved)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Julian day of 1970-01-01 and the letters of strftime with their date_format patterns.
EPOCH_JULIAN_DAY = 2440587.5
FORMAT_LETTERS = (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%j", "DDD"))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary functions ``julianday``, ``datetime`` and ``strftime``."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION julianday(moment TIMESTAMP_NTZ) RETURNS DOUBLE
        RETURN datediff(to_date(moment), DATE'1970-01-01') + {EPOCH_JULIAN_DAY}D
          + (hour(moment) * 3600 + minute(moment) * 60 + second(moment)) / 86400D""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION datetime(moment TIMESTAMP_NTZ) RETURNS STRING
        RETURN date_format(moment, 'yyyy-MM-dd HH:mm:ss')""")
    pattern = "layout"
    for letter, replacement in FORMAT_LETTERS:
        pattern = f"replace({pattern}, '{letter}', '{replacement}')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION strftime(layout STRING, moment TIMESTAMP_NTZ) RETURNS STRING
        RETURN date_format(moment, {pattern})""")
    return ["julianday", "datetime", "strftime"]
