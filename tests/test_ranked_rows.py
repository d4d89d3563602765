"""Ranks from range-written rows: ties and groups that span files, one value with a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import stats
from wardline.operators.stats import ranked_rows


def plain(rows):
    """Mean rank of the value inside each group, by definition."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = [(v, w) for h, v, _, w in rows if h == g]
        for v, _ in mine:
            below, equal = sum(w for x, w in mine if x < v), sum(w for x, w in mine if x == v)
            out[g, v] = below + (equal + 1) / 2
    return out


def sample(groups, n=1500, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(groups), 7.5 if k % 3 == 0 else rng.choice([rng.randint(0, 9) / 2, rng.random()]), k, rng.randint(1, 4)) for k in range(n)]


@pytest.fixture
def many_files(spark):
    """Writes stay as wide as the session's shuffles, and nothing is broadcast unless it is asked for."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("groups", [[None], ["a", "b", None], [f"g{n}" for n in range(300)]])
def test_mean_ranks(spark, many_files, groups):
    rows = sample(groups)
    frame = spark.createDataFrame(rows, "g STRING, v DOUBLE, k INT, w LONG").repartition(5)
    by = [] if groups == [None] else ["g"]
    want = plain(rows)
    got = ranked_rows(frame, "v", "w", "r", by).collect()
    assert len(got) == len(rows) and all(r.r == want[r.g, r.v] for r in got)


def test_one_value_is_cut_over_files(spark, many_files, monkeypatch):
    kept = []
    write = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df, purpose: kept.append(write(df, purpose)) or kept[-1])
    frame = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") + 0.5).alias("v"), F.col("id").alias("k"), F.lit(1).cast("bigint").alias("w"))
    got = ranked_rows(frame, "v", "w", "r").where("v = 1.0").agg(F.count("*"), F.min("r"), F.max("r")).first()
    assert tuple(got) == (13_334, 6667.5, 6667.5)
    files = kept[0].groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.count_if(F.col("v") == 1.0).alias("hot")).collect()
    assert len(files) == 8 and max(f.n for f in files) < 2 * 40_000 / 8 and sum(f.hot > 0 for f in files) >= 2


def test_no_rows(spark):
    assert ranked_rows(spark.createDataFrame([], "v DOUBLE, w LONG"), "v", "w", "r").collect() == []
