"""Multiset hashes, hash trees and the differences found from them."""

import hashlib
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from wardline.functions import identity as ident
from wardline.operators import compare, hash_tree
from wardline.sources import storage

KEYS = {"a": ("k",), "b": ("k", "name"), "c": ("k",)}


def hashes_of(rows):
    return [hashlib.sha256(repr(r).encode()).hexdigest() for r in rows]


def plain_sum(hashes):
    words = [sum(int(h[16 * k : 16 * k + 16], 16) for h in hashes) % 2**64 for k in range(4)]
    return "".join(f"{w:016x}" for w in words)


def test_multiset_sum_is_that_of_the_words(spark):
    for n in (0, 1, 2, 500):
        hashes = hashes_of(range(n)) + ["f" * 64] * n
        rows = spark.createDataFrame([(h,) for h in hashes], "h string").repartition(7)
        got = rows.agg(ident.multiset_sum("h").alias("s")).first().s
        assert got == plain_sum(hashes) and len(got) == 64
    assert plain_sum([]) == ident.EMPTY_SUM


def test_sums_add_up_and_subtract(spark):
    one, other = hashes_of(range(40)), hashes_of(range(30, 90))
    row = spark.createDataFrame([(plain_sum(one), plain_sum(other), plain_sum(one + other))], "a string, b string, both string")
    got = row.select(ident.multiset_add(F.col("a"), F.col("b")), ident.multiset_subtract(F.col("both"), F.col("b"))).first()
    assert tuple(got) == (plain_sum(one + other), plain_sum(one))
    signed = spark.createDataFrame([(h, 1) for h in one + other] + [(h, -1) for h in other], "h string, sign int")
    assert signed.agg(ident.multiset_sum("h", F.col("sign")).alias("s")).first().s == plain_sum(one)
    parts = spark.createDataFrame([(40, plain_sum(one)), (60, plain_sum(other))], "row_count long, hash_sum string")
    assert tuple(ident.merged_checksums(parts).first()) == (100, plain_sum(one + other))


def test_hashes_that_share_sixty_bits_are_told_apart(spark):
    same = "0123456789abcde"
    left, right = ([(same + c * 49,) for c in pair] for pair in ("12", "34"))
    sums = {spark.createDataFrame(rows, "h string").agg(ident.multiset_sum("h").alias("s")).first().s for rows in (left, right)}
    assert len(sums) == 2


def test_number_text(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.5, -1.5, 0.1, 1e-3, 2.0**53 + 2, -(2.0**52) - 0.5, 2.0**62, 0.1 + 0.2, 0.3, 1e300, float("inf"), float("nan"), None]
    values += [rng.uniform(-1000, 1000) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ident.number_text(F.col("v")).alias("t")).collect()
    texts = {}
    for r in rows:
        if r.v is None:
            assert r.t is None
        elif abs(r.v) < 2.0**63:
            whole, high, low = map(int, r.t.split("+"))
            assert whole + high / 2**53 + low / 2**106 == r.v
            assert texts.setdefault(r.t, r.v) == r.v
        else:
            assert "+" not in r.t


@pytest.fixture(scope="module")
def frames(spark):
    a = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("v"), (F.col("id") / 3).alias("x"))
    b = spark.range(1000).select((F.col("id") % 200).alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    c = spark.range(5).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("v"))
    return {"a": a, "b": b, "c": c}


def stored(spark, frames, rows_in_bucket=50, buckets=None):
    buckets = buckets or hash_tree.layout(frames, rows_in_bucket)
    return hash_tree.write_snapshot(frames, storage.workspace(spark, "keyed"), KEYS, buckets)


def test_every_level_adds_up(spark, frames):
    snapshot = stored(spark, frames)
    assert snapshot.buckets == {"a": 64, "b": 32, "c": 1}
    tree = snapshot.tree.collect()
    for entity in frames:
        hashes = [r._hash for r in snapshot.rows(entity).collect()]
        for level in range(hash_tree.depth(64) + 1):
            nodes = [n for n in tree if n.entity == entity and n.level == level]
            assert sum(n.row_count for n in nodes) == len(hashes)
            assert plain_sum([n.hash_sum for n in nodes]) == plain_sum(hashes)
    assert [n.row_count for n in tree if n.level == hash_tree.depth(64) and n.entity == "a"] == [3000]


def test_planted_changes_are_named_and_only_their_buckets_read(spark, frames):
    left = stored(spark, frames)
    a = frames["a"].where("k <> 17").withColumn("x", F.when(F.col("k").isin(5, 900), F.lit(0.5)).otherwise(F.col("x")))
    a = a.unionByName(spark.createDataFrame([(-4, "new", 1.0), (7000, "new", None)], "k long, v string, x double"))
    right = stored(spark, {**frames, "a": a.repartition(3)}, buckets=left.buckets)
    found = {r.entity: r for r in hash_tree.diff(left, right).collect()}
    assert [(found["a"][c]) for c in ("left_rows", "right_rows", "only_left", "only_right", "inserted", "deleted", "changed")] == [
        3000, 3001, 3, 4, 2, 1, 2]
    assert found["a"].compared and not found["a"].logical_content_hash_equal
    assert not found["b"].compared and found["b"].logical_content_hash_equal and found["c"].left_rows == 5
    named = {(r.k, r.change) for r in hash_tree.changes(left, right, "a").collect()}
    assert named == {(17, "deleted"), (5, "changed"), (900, "changed"), (-4, "inserted"), (7000, "inserted")}
    nodes = hash_tree.changed_buckets(left, right)
    assert list(nodes) == ["a"] and len(nodes["a"]) <= 5
    read = hash_tree.changes(left, right, "a", nodes["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "_bucket" in read.split("PartitionFilters")[1]
    # the hash-by-hash comparison of whole tables agrees
    whole = compare.entity_diff(frames["a"], a, "a").first()
    assert (whole.only_left, whole.only_right) == (3, 4)


def test_equal_objects_need_not_exist_any_more(spark, frames):
    """Entities with equal roots are reported although no row of theirs can be read."""
    left, right = stored(spark, frames), stored(spark, {**frames, "c": frames["c"].where("k < 4")})
    gone = hash_tree.KeyedSnapshot(spark, right.root, right.buckets, right.keys, {**right.schemas, "a": left.schemas["a"]})
    plan = hash_tree.diff(left, gone)._jdf.queryExecution().analyzed().toString()
    files = [f for f in hash_tree.diff(left, gone).inputFiles() if "/a/" in f or "/b/" in f]
    assert files == [] and "Relation" in plan


def test_missing_entities_and_repeated_keys(spark, frames):
    twice = {**frames, "b": frames["b"].unionByName(frames["b"].where("k = 3"))}
    left, right = stored(spark, frames), stored(spark, twice)
    line = next(r for r in hash_tree.diff(left, right).collect() if r.entity == "b")
    assert (line.only_left, line.only_right, line.inserted) == (0, 5, 5)
    part = stored(spark, {"a": frames["a"]}, buckets={"a": 64, "b": 32, "c": 1})
    lines = {r.entity: r for r in hash_tree.diff(part, left).collect()}
    assert lines["b"].inserted == 1000 and not lines["b"].logical_schema_equal and lines["a"].logical_content_hash_equal


def test_other_numbers_of_buckets_are_refused(spark, frames):
    with pytest.raises(ValueError, match="numbers of buckets"):
        hash_tree.diff(stored(spark, frames), stored(spark, frames, rows_in_bucket=10))


def test_empty_entities(spark, frames):
    none = {e: f.limit(0) for e, f in frames.items()}
    left = stored(spark, none)
    assert all(r.left_rows == 0 and r.logical_content_hash_equal for r in hash_tree.diff(left, left).collect())
    assert {r.inserted for r in hash_tree.diff(left, stored(spark, frames, buckets=left.buckets)).collect()} == {3000, 1000, 5}


def test_dataset_hash_sees_every_entity(spark, frames):
    before = ident.dataset_logical_hash(frames).first()
    for entity, frame in frames.items():
        other = {**frames, entity: frame.withColumn("k", F.when(F.col("k") == 3, F.lit(-3)).otherwise(F.col("k")))}
        assert ident.dataset_logical_hash(other).first().hash_sum != before.hash_sum
    swapped = {"a": frames["c"], "c": frames["c"], "b": frames["b"]}
    assert ident.dataset_logical_hash(swapped).first() != ident.dataset_logical_hash({"b": frames["b"], "c": frames["c"]}).first()
