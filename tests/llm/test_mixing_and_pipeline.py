import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.helpers import empty_frame, odd_documents, odd_frame
from wardline.llm import mixing


@pytest.mark.parametrize("seed", range(8))
def test_every_block_stays_in_its_window(seed):
    rng = random.Random(seed)
    weights = {f"s{i}" if i else None: rng.random() ** 3 + 0.001 for i in range(rng.randint(1, 30))}
    slots = mixing.whole_weights(weights, 256)
    assert sum(slots.values()) == 256 and min(slots.values()) >= 1
    plan = mixing.schedule(slots)
    assert [p[4] for p in plan] == list(range(256))
    done = dict.fromkeys(slots, 0)
    for k, j, release, deadline, slot in plan:
        assert release <= slot < deadline and j == done[k] + 1
        done[k] += 1
        for other, n in slots.items():
            assert abs(done[other] - n * (slot + 1) / 256) < 1


def test_whole_weights_of_odd_inputs():
    assert mixing.whole_weights({}) == {} and mixing.whole_weights({"a": 0}) == {}
    assert mixing.whole_weights({"a": 3}) == {"a": mixing.PERIOD}
    many = mixing.whole_weights({str(i): 10.0 ** (i % 5) for i in range(1000)}, 64)
    assert sum(many.values()) == 4000 and min(many.values()) == 1


def many_documents(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400), None if i % 11 == 0 else "big" if i % 3 == 0 else f"s{i % 5}", "clash") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string").repartition(4), rows


def test_prefixes_of_the_mix_follow_the_weights(spark):
    docs, rows = many_documents(spark)
    weights = {"big": 1, "s1": 2, "s2": 2, "s3": 2, "s4": 1, None: 1}  # s0 comes after all
    out = mixing.mix(docs, weights, block_chars=2000, period=90).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
    slots = mixing.whole_weights(weights, 90)
    total = sum(slots.values())
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.block), set()).add((r.slot, r.release, r.deadline))
    assert all(len(v) == 1 for v in blocks.values())
    placed = {k: next(iter(v)) for k, v in blocks.items()}
    assert len({v[0] for v in placed.values()}) == len(placed)
    for (source, block), (slot, release, deadline) in placed.items():
        if source in slots:
            assert release == (block - 1) * total // slots[source] and deadline == -(-block * total // slots[source])
            assert release <= slot < deadline
    shortest = min(max(v[0] for k, v in placed.items() if k[0] == s) for s in slots)
    for t in range(1, shortest):
        for s, n in slots.items():
            assert abs(sum(1 for k, v in placed.items() if k[0] == s and v[0] < t) - n * t / total) < 1
    assert min(v[0] for k, v in placed.items() if k[0] == "s0") > max(v[0] for k, v in placed.items() if k[0] != "s0")
    # blocks begin every 2,000 characters of their source
    for source in {r[2] for r in rows}:
        own = sorted((r.slot, r.place, r.n_chars, r.block) for r in out if r.source == source)
        before = 0
        for _, _, n, block in own:
            assert block == before // 2000 + 1
            before += n


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    docs, _ = many_documents(spark)
    one = sorted(map(tuple, mixing.mix(docs, block_chars=2000).collect()), key=repr)
    monkeypatch.setattr(mixing, "ROWS_IN_BUCKET", 100)
    assert sorted(map(tuple, mixing.mix(docs, block_chars=2000).collect()), key=repr) == one


def test_odd_rows(spark):
    out = mixing.mix(odd_frame(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in odd_documents())
    assert len({(r.slot, r.place) for r in out}) == len(out)
    ordered = mixing.in_mixed_order(odd_frame(spark))
    assert ordered.columns == odd_frame(spark).columns
    assert sorted(map(repr, ordered.collect())) == sorted(map(repr, odd_frame(spark).collect()))
    assert mixing.mix(empty_frame(spark)).collect() == []
    assert mixing.in_mixed_order(empty_frame(spark)).collect() == []


def test_in_mixed_order(spark):
    docs, _ = many_documents(spark)
    at = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs, block_chars=2000).collect()}
    seen = [at[r.doc_id] for r in mixing.in_mixed_order(docs, block_chars=2000).collect()]
    assert seen == sorted(seen)


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "source mixing", "harmonic packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns
        kept = [r.doc_id for r in out.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        if name in ("suffix-array dedup", "source mixing"):
            assert set(kept) == ids
        docs = out
        ids = set(kept)
    packed = contract.queries()["pipeline"](spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == ids
    assert contract.oracle_sql().get("pipeline") is None
