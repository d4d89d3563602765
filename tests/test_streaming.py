import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline.sources.storage import workspace
from wardline.streaming.ingest import deduplicated_stream, ingest_lines, keyed_state

SCHEMA = "event_id BIGINT, value DOUBLE, ts TIMESTAMP_NTZ"


def drop(spark, path, rows):
    lines = [(json.dumps(r) if isinstance(r, dict) else r,) for r in rows]
    spark.createDataFrame(lines, "value STRING").coalesce(1).write.mode("append").text(path)


def event(n, day):
    return {"event_id": n, "value": float(n), "ts": f"2024-01-{day:02d} 10:00:00"}


def run(spark, root, files=1):
    ingest_lines(spark, f"{root}/drop", f"{root}/bronze", f"{root}/checkpoint", SCHEMA, ["event_id"], "ts", files)
    return spark.read.schema("event_id BIGINT").parquet(f"{root}/bronze")


@pytest.mark.parametrize("files", [1, 100])
def test_new_files_once_and_no_repeats(spark, files):
    root = workspace(spark, "stream-test")
    drop(spark, f"{root}/drop", [event(1, 5), event(2, 5), event(2, 5), "not json"])
    assert sorted(r.event_id for r in run(spark, root, files).collect()) == [1, 2]
    # A later drop repeats a key and brings a row that is a month late; the late row is kept.
    drop(spark, f"{root}/drop", [event(2, 5), event(3, 20)])
    drop(spark, f"{root}/drop", [event(4, 1), event(3, 20)])
    assert sorted(r.event_id for r in run(spark, root, files).collect()) == [1, 2, 3, 4]
    assert sorted(r.event_id for r in run(spark, root, files).collect()) == [1, 2, 3, 4]
    assert [r.value for r in spark.read.text(f"{root}/bronze_rejected").collect()] == ["not json"]


def test_lines_without_a_whole_key_are_kept_apart(spark):
    root = workspace(spark, "stream-test")
    bad = [{"value": 1.0}, {"event_id": "x1", "value": 2.0}, {"event_id": None}, {"event_id": 2.5}]
    drop(spark, f"{root}/drop", [event(1, 5), *bad])
    assert [r.event_id for r in run(spark, root).collect()] == [1]
    rejected = [json.loads(r.value) for r in spark.read.text(f"{root}/bronze_rejected").collect()]
    assert sorted(map(str, rejected)) == sorted(map(str, bad))


def test_a_trigger_costs_what_it_brings(spark):
    """Each of many triggers looks up, adds and saves its own keys, however many came before."""
    root = workspace(spark, "stream-test")
    for n in range(12):
        drop(spark, f"{root}/drop", [event(10 * n + k, 5) for k in range(10)] + [event(k, 5) for k in range(3)])
    accepted, _ = ingest_lines(spark, f"{root}/drop", f"{root}/bronze", f"{root}/checkpoint", SCHEMA, ["event_id"], "ts", 1)
    states = [p["stateOperators"][0] for p in accepted.recentProgress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in states] == [10] * 12 and states[-1]["numRowsTotal"] == 120
    saved = Counter()
    for file in Path(f"{root}/checkpoint/accepted/state".removeprefix("file:")).rglob("*.changelog"):
        saved[int(file.name.split(".")[0].split("_")[0])] += file.stat().st_size
    assert len(saved) == 12 and max(saved.values()) < 2 * min(saved.values())
    assert spark.read.parquet(f"{root}/bronze").count() == 120


def test_a_batch_that_failed_is_taken_again_whole(spark):
    """A batch whose rows were written but never committed is replayed: nothing is lost or there twice."""
    root = workspace(spark, "stream-test")
    drop(spark, f"{root}/drop", [event(1, 5), event(2, 5)])
    run(spark, root)
    drop(spark, f"{root}/drop", [event(2, 6), event(3, 5), event(4, 7), "broken"])
    run(spark, root)
    for name in ("accepted", "rejected"):
        commits = Path(f"{root}/checkpoint/{name}/commits".removeprefix("file:"))
        last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
        (commits / str(last)).unlink()
        crc = commits / f".{last}.crc"
        if crc.exists():
            crc.unlink()
    drop(spark, f"{root}/drop", [event(5, 5), event(3, 9)])
    assert sorted(r.event_id for r in run(spark, root).collect()) == [1, 2, 3, 4, 5]
    assert [r.value for r in spark.read.text(f"{root}/bronze_rejected").collect()] == ["broken"]


def test_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_bounded_state_variant(spark):
    root = workspace(spark, "stream-test")
    drop(spark, f"{root}/drop", [event(1, 5), event(1, 5), event(2, 5)])
    rows = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP").json(f"{root}/drop")
    query = deduplicated_stream(rows, ["event_id"], "ts", "2 days").writeStream.format("parquet").option(
        "checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    assert spark.read.parquet(f"{root}/out").groupBy("event_id").count().filter(F.col("count") > 1).count() == 0
