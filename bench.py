"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up and three times for the clock; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "v_encounter_facts", "v_hospital_readmission_summary", "q01_encounter_volume", "q02_year_encounters", "q03_high_cost",
    "q04_provider_volume", "q06_comorbidity_cohort", "q07_primary_dx_readmission", "q10_quarter_change", "q11_rank",
    "q13_latest_per_patient", "q14_rolling_average", "q15_above_average", "q17_outlier_cost", "q18_contingency",
    "c06_cost_by_diagnosis", "c07_complication_rate", "m_readmission_30d_rate", "m_median_los", "m_diagnosis_prevalence",
    "derive_readmissions", "silver_dedup", "silver_quarantine", "dq_check_constraints", "dq_foreign_keys_full",
    "dq_unique_keys", "content_checksum", "snapshot_diff", "snapshot_history", "suppress_small_cells", "classify_risk",
    "stat_mann_whitney", "stat_spearman", "cohort_builder",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wardline.plans.registered import QUERIES

    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs[1:]), 4)
    spark.stop()
    print(json.dumps({
        "metric": "clinical_headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
