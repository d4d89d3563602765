"""Numbers without a global window, and ancestry in few rounds."""

import pytest
from pyspark.sql import functions as F

from wardline.operators.registry import lineage_ancestry
from wardline.sources import storage


@pytest.mark.parametrize("distinct", [1, 3, 5000])
def test_dense_numbers_in_order(spark, distinct):
    rows = spark.range(5000).select((F.col("id") * 7 % distinct).alias("k"), F.col("id").alias("v"), F.lit("old").alias("n")).repartition(6)
    got = storage.surrogate_key(rows, ["k"], "n", start=10).orderBy("n").collect()
    assert [r.n for r in got] == list(range(10, 5010)) and sorted(r.v for r in got) == list(range(5000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_a_key_that_all_rows_share_is_dealt_over_tasks(spark, monkeypatch):
    kept = []
    write = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, purpose: kept.append(write(df, purpose)) or kept[-1])
    rows = spark.range(80_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        storage.surrogate_key(rows, ["k"], "n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r["count"] for r in kept[0].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 80_000 / 8


def test_no_rows(spark):
    assert storage.surrogate_key(spark.range(0).select(F.col("id").alias("k")), ["k"], "n").collect() == []


def ancestry(spark, edges, starts):
    found = lineage_ancestry(
        spark.createDataFrame(edges, "parent_id STRING, child_id STRING"), spark.createDataFrame([(s,) for s in starts], "start_id STRING"))
    rows = found.collect()
    assert len(rows) == len({(r.start_id, r.node_id) for r in rows})
    return {(r.start_id, r.node_id): r.depth for r in rows}


def plain(edges, starts):
    parents = {}
    for p, c in edges:
        parents.setdefault(c, set()).add(p)
    out = {}
    for s in starts:
        level, depth = {s}, 0
        while level:
            out |= {(s, n): depth for n in level}
            level, depth = {p for n in level for p in parents.get(n, ())} - {n for x, n in out if x == s}, depth + 1
    return out


def test_least_depths(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "d"), ("f", "e"), ("c", "f"), ("g", "f"), ("a", "a"), ("x", "y"), ("b", "a")]
    assert ancestry(spark, edges, ["a", "f", "y", "lonely", "a"]) == plain(edges, ["a", "f", "y", "lonely"])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    write = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, purpose: written.append(purpose) or write(df, purpose))
    edges = [(str(n + 1), str(n)) for n in range(1000)] + [("0", "1000")]  # and back to the start
    got = ancestry(spark, edges, ["0"])
    assert got == {("0", str(n)): n for n in range(1001)}
    assert len(written) <= 2 + 3 * 11
