"""Batches on top of each other: what they change, what they read, and that they add up to a full run."""

import json

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import registry
from wardline.plans.incremental import Conflict, IncrementalLake, batch_rows
from wardline.plans.lake_run import Lake
from wardline.sources import storage

ENTITIES = ("patients", "hospitals", "encounters", "quality_measures", "lab_results")


@pytest.fixture(scope="module")
def batches(tables):
    """A first batch, and a second one: later encounters and labs with a few new patients, and lines of keys known already."""
    late = F.col("admission_date") >= "1997-01-01"
    stays = tables["encounters"]
    labs = tables["lab_results"]
    late_ids = stays.where(late).select("encounter_id")
    first = {
        "patients": tables["patients"].where("patient_id % 10 <> 3"), "hospitals": tables["hospitals"],
        "quality_measures": tables["quality_measures"], "encounters": stays.where(~late & (F.col("patient_id") % 10 != 3)),
        "lab_results": labs.join(stays.where(~late & (F.col("patient_id") % 10 != 3)), "encounter_id", "left_semi")}
    second = {
        "patients": tables["patients"].where("patient_id % 10 = 3 OR patient_id < 20").withColumn("insurance_type", F.lit("other")),
        "encounters": stays.where(late | (F.col("patient_id") % 10 == 3)),
        "lab_results": labs.join(late_ids, "encounter_id", "left_semi").unionByName(labs.where("encounter_id < 30"))}
    return first, second


def drop(lake, batch, name, extra=None):
    return lake.write_batch(batch, name, extra)


@pytest.fixture(scope="module")
def applied(spark, batches):
    lake = IncrementalLake(spark, storage.workspace(spark, "chain"), rows_in_bucket=40)
    one = lake.apply(drop(lake, batches[0], "batch-1"), "clinical", "batch-1")
    two = lake.apply(drop(lake, batches[1], "batch-2"), "clinical", "batch-2", parent=one["gold"].snapshot_id)
    return lake, one, two


def test_two_batches_equal_one_full_run(spark, batches, applied):
    lake, one, two = applied
    assert all(s.passed for s in (*one.values(), *two.values())), [s.errors for s in two.values()]
    full = Lake(spark, storage.workspace(spark, "full"))
    for n, batch in enumerate(batches, 1):
        drop(full, batch, f"batch-{n}")
    done = full.run({e: f"{full.root}/batches/*/{e}" for e in ENTITIES}, "clinical", "all")
    for layer in schemas.LAYERS:
        chained = {o.entity: (o.row_count, o.hash_sum, o.rejected) for o in two[layer].objects}
        assert chained == {o.entity: (o.row_count, o.hash_sum, o.rejected) for o in done[layer].objects}, layer
    for entity, frame in lake.frames(two["gold"]).items():
        names = schemas.columns(entity)
        whole = full.frames(done["gold"])[entity].select(*names)
        assert frame.select(*names).exceptAll(whole).isEmpty() and whole.exceptAll(frame.select(*names)).isEmpty()


def test_first_batch_wins_and_what_is_left_out_is_kept(applied):
    lake, one, two = applied
    assert lake.frames(two["silver"])["patients"].where("patient_id < 20 AND patient_id % 10 <> 3 AND insurance_type = 'other'").isEmpty()
    reasons = {r.entity: r["count"] for r in lake.rejected(two["silver"]).where("reason = 'duplicate_key'").groupBy("entity").count().collect()}
    assert reasons["patients"] == lake.frames(one["silver"])["patients"].where("patient_id < 20").count()


def test_older_snapshots_and_untouched_entities_stay(applied):
    lake, one, two = applied
    objects = [{o.entity: o for o in s.objects} for s in (one["silver"], two["silver"])]
    assert objects[0]["hospitals"] == objects[1]["hospitals"] and len(lake.parts(objects[1]["hospitals"])) == 1
    assert len(lake.parts(objects[1]["patients"])) == 2
    assert lake.frames(one["silver"])["patients"].count() == objects[0]["patients"].row_count < objects[1]["patients"].row_count
    assert lake.head()["gold"].snapshot_id == two["gold"].snapshot_id
    extended = lake.edges().where("relationship = 'extended_by'")
    assert {(r.parent_id, r.child_id) for r in extended.collect()} == {(one[x].snapshot_id, two[x].snapshot_id) for x in schemas.LAYERS}
    chain = registry.lineage_ancestry(lake.edges(), lake.spark.createDataFrame([(two["gold"].snapshot_id,)], "start_id STRING"))
    assert {r.node_id for r in chain.collect()} == {s.snapshot_id for s in (*one.values(), *two.values())}


def test_a_batch_reads_the_buckets_it_hits_alone(spark, applied):
    lake, one, _ = applied
    patients = next(o for o in one["silver"].objects if o.entity == "patients")
    assert lake.parts(patients)[0]["buckets"] >= 4
    some = lake.state(patients, "silver", [1])
    files = [f.input_file for f in some.select(F.input_file_name().alias("input_file")).distinct().collect()]
    assert files and all("_bucket=1/" in f for f in files)
    assert "PartitionFilters" in some._jdf.queryExecution().executedPlan().toString()


def test_trees_follow_the_rows(applied):
    lake, one, two = applied
    for snapshot in (one["silver"], two["silver"]):
        for o in snapshot.objects:
            top = lake.tree(o).orderBy(F.desc("level")).first()
            assert (top.row_count, top.hash_sum) == (o.row_count, o.hash_sum)
            leaves = {(r.node, r.row_count) for r in lake.tree(o).where("level = 0").collect()}
            assert leaves == {tuple(r) for r in lake.state(o, "silver").groupBy("_bucket").count().collect()}


def test_changes_between_snapshots(applied, batches):
    lake, one, two = applied
    found = lake.changes(one["silver"], two["silver"]).collect()
    assert {r.change for r in found} == {"inserted"} and "hospitals" not in {r.entity for r in found}
    new = {json.loads(r.key)["patient_id"] for r in found if r.entity == "patients"}
    assert new == {r.patient_id for r in batches[1]["patients"].where("patient_id % 10 = 3").collect()}
    assert {r.change for r in lake.changes(two["silver"], one["silver"]).collect()} == {"deleted"}
    assert lake.changes(two["silver"], two["silver"]).isEmpty()


def test_known_batches_and_wrong_parents(spark, batches, applied):
    lake, one, two = applied
    again = lake.apply({e: f"{lake.root}/batches/batch-2/{e}" for e in batches[1]}, "clinical", "batch-2")
    assert {k: s.snapshot_id for k, s in again.items()} == {k: s.snapshot_id for k, s in two.items()}
    with pytest.raises(Conflict, match="other content"):
        lake.apply({"patients": f"{lake.root}/batches/batch-1/patients"}, "clinical", "batch-2")
    with pytest.raises(Conflict, match="head is"):
        lake.apply({"patients": f"{lake.root}/batches/batch-1/patients"}, "clinical", "batch-3", parent=one["gold"].snapshot_id)
    fresh = IncrementalLake(spark, storage.workspace(spark, "chain"))
    with pytest.raises(Conflict, match="empty"):
        fresh.apply({}, "clinical", "b", parent="lake-snapshot-x")


def test_a_failed_batch_leaves_the_head_and_the_next_one_goes_on_from_it(spark, batches):
    lake = IncrementalLake(spark, storage.workspace(spark, "chain"), rows_in_bucket=40)
    one = lake.apply(drop(lake, batches[0], "batch-1"), "clinical", "batch-1")
    line = json.loads(batches[0]["encounters"].limit(1).selectExpr("to_json(struct(*)) AS j").first().j)
    orphan = json.dumps({c: None for c in schemas.columns("encounters")} | line | {"encounter_id": 99_999_999, "patient_id": 88_888_888})
    bad = lake.apply(drop(lake, {"encounters": batches[1]["encounters"].limit(0)}, "bad", {"encounters": [orphan]}), "clinical", "bad")
    assert bad["silver"].errors == ["encounters/foreign_key:patient_id"] and "gold" not in bad
    assert lake.head()["gold"].snapshot_id == one["gold"].snapshot_id
    two = lake.apply(drop(lake, batches[1], "batch-2"), "clinical", "batch-2")
    assert two["gold"].passed
    assert {r.batch_id for r in batch_rows(lake, two).collect()} == {"batch-1", "batch-2"}
    assert lake.frames(two["bronze"])["encounters"].where("encounter_id = 99999999").isEmpty()


def test_new_entities_and_broken_lines(spark, tables, batches):
    lake = IncrementalLake(spark, storage.workspace(spark, "chain"), max_bad_ratio=0.5)
    lake.apply(drop(lake, batches[0], "batch-1"), "clinical", "batch-1")
    second = {"providers": tables["providers"], "hospitals": tables["hospitals"].limit(0)}
    done = lake.apply(drop(lake, second, "batch-2", {"providers": ["{broken"], "hospitals": []}), "clinical", "batch-2")
    lines = {(r.layer, r.entity, r.batch_id): r.row_count for r in batch_rows(lake, done).collect()}
    n = tables["providers"].count()
    assert done["gold"].passed and lines["raw", "providers", "batch-2"] == n + 1 and lines["gold", "providers", "batch-2"] == n
    assert lines["gold", "hospitals", "batch-2"] == 0 and lines["gold", "patients", "batch-1"] > 0
