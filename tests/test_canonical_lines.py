"""Lines in canonical form are read without a variant, and all others as before; what the lake writes stays small."""

import random

from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions import identity as ident
from wardline.operators import layers
from wardline.plans.incremental import IncrementalLake
from wardline.plans.lake_run import Lake
from wardline.sources import lines, storage

PLAIN = '{"hospital_id":3,"provider_id":%d,"specialty":"s %s","years_experience":null}'
STRANGE = [
    "", "junk", "[1]", '{"provider_id":1}', '{"hospital_id":3,"provider_id":1,"provider_id":1,"specialty":"s","years_experience":4}',
    '{"hospital_id":3,"provider_id":"1","specialty":"s","years_experience":4}', PLAIN % (7, "x") + " ", PLAIN % (7, "x") + " tail",
    '{"provider_id":1,"hospital_id":3,"specialty":"s","years_experience":4}', '{"hospital_id":3,"provider_id":1,"specialty":5,"years_experience":4}',
    '{"hospital_id":3,"provider_id":1.0,"specialty":"s","years_experience":4}', '{"hospital_id":3,"provider_id":1,"specialty":"s","years_experience":99999999999}',
    '{"hospital_id":3,"more":1,"provider_id":1,"specialty":"s","years_experience":4}', '{"hospital_id":null,"provider_id":null,"specialty":null,"years_experience":null}',
]
COSTS = ['"NaN"', "1e3", "1000.0", "7", '"Infinity"', "null", "0.1", "NaN", "12345678901234567890.5"]


def cost_line(text):
    values = dict.fromkeys(schemas.columns("encounters"), "null") | {"total_cost": text, "encounter_id": "1"}
    return "{" + ",".join(f'"{k}":{v}' for k, v in sorted(values.items())) + "}"


def read(parsed, entity):
    fields, flags = lines.typed_fields(parsed, entity)
    names = schemas.columns(entity)
    rows = parsed.select("line", "is_object", flags.alias("flags"), *fields)
    return sorted(map(repr, rows.select("line", "is_object", F.when(F.col("is_object"), F.col("flags")).alias("flags"), *names).collect()))


def test_fields_and_flags_are_those_of_the_documents(spark):
    root = storage.workspace(spark, "plain")
    for entity, texts in (("providers", STRANGE + [PLAIN % (n, "\\u00e4ä\\\\ \\\"") for n in range(9)]), ("encounters", [cost_line(c) for c in COSTS])):
        spark.createDataFrame([(t,) for t in texts], "value string").write.text(f"{root}/{entity}")
        fast = lines.read_rows(spark, f"{root}/{entity}", entity)
        assert read(fast, entity) == read(lines.read_documents(spark, f"{root}/{entity}"), entity)
    plain = {r.line for r in fast.where("is_plain").collect()}
    assert plain == {cost_line(c) for c in ("1000.0", "null", "0.1")}


def test_plain_lines_have_the_hash_of_their_fields(spark, tables):
    lake = Lake(spark, storage.workspace(spark, "plain"))
    done = lake.run(lake.write_batch({e: tables[e] for e in ("providers", "patients", "encounters", "quality_measures", "hospitals")}, "b"), "d", "b")
    for entity, frame in lake.frames(done["bronze"]).items():
        assert frame.where(F.col(schemas.RECORD_HASH) != ident.record_hash(schemas.columns(entity))).isEmpty()
    parsed = lines.read_rows(spark, next(o.path for o in done["raw"].objects if o.entity == "encounters"), "encounters")
    assert parsed.where(~F.col("is_plain")).isEmpty()


def test_first_rows_of_a_stored_object(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), f"f{rng.randrange(3)}", n, n) for n in range(400)] + [(1, "f1", n, n) for n in range(400, 900)]
    frame = spark.createDataFrame(rows, f"k long, {schemas.SOURCE_FILE} string, {schemas.ROW_ORDER} long, v long")
    kept, left_out = layers.stored_firsts(frame, ["k"])
    assert sorted(kept.collect()) == sorted(layers.silver_dedup(frame, ["k"]).collect())
    reasons = {r.v: r[schemas.REJECTION_REASON] for r in left_out.collect()}
    kept_ids = {r.v for r in kept.collect()}
    assert reasons == {n: layers.NULL_KEY if k is None else layers.DUPLICATE_KEY for k, _, _, n in rows if n not in kept_ids}
    no_shuffle = layers.stored_firsts(frame.where("k >= 1000"), ["k"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in no_shuffle and "Window" not in no_shuffle


def test_drops_are_compressed_and_hashes_travel_as_bytes(spark, tables):
    lake = IncrementalLake(spark, storage.workspace(spark, "small"))
    paths = lake.write_batch({"encounters": tables["encounters"], "hospitals": tables["hospitals"]}, "b", {"hospitals": ["junk"]})
    for path in paths.values():
        files = spark.read.format("binaryFile").load(path).select("path").collect()
        assert all(r.path.endswith(".gz") for r in files if not r.path.endswith("_SUCCESS"))
    size = spark.read.format("binaryFile").load(paths["encounters"]).agg(F.sum("length")).first()[0]
    text = spark.read.text(paths["encounters"]).agg(F.sum(F.length("value"))).first()[0]
    assert size * 5 < text
