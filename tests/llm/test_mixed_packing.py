import random

import public_tokenizers

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.helpers import prose
from wardline.llm import harmonic, mixing


def test_sequence_ids_follow_the_mix(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60), "big" if i % 10 else "small") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {i: s for i, _, s in rows}
    weights = {"big": 1, "small": 1}  # a tenth of the rows gets half of every prefix until it has run out
    order = mixing.order_of(docs, weights=weights, block_chars=2000)
    out = harmonic.pack_documents(docs, public_tokenizers.path(corpus_pipeline.VOCABULARY), order=order, slots_of_worker=8).collect()
    assert {r.doc_id for r in out} == set(source)
    total = {}
    for r in out:
        total[r.sequence_id >> 40] = total.get(r.sequence_id >> 40, 0) + (r.length if source[r.doc_id] == "small" else 0)
    of_all = {w: sum(r.length for r in out if r.sequence_id >> 40 == w) for w in total}
    small = all_ = 0
    for worker in sorted(total)[:2]:  # 16 slots: eight blocks of each source
        small, all_ = small + total[worker], all_ + of_all[worker]
        assert 0.4 < small / all_ < 0.6
    for worker in sorted(total)[-2:]:
        assert total[worker] == 0  # the small source has run out long before


def test_packing_stage_deals_by_slot(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    slot = {r.doc_id: r.slot for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.packing(spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in out} == set(slot)
    assert all(r.sequence_id >> 40 == slot[r.doc_id] // harmonic.SLOTS_OF_WORKER for r in out)
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in spans.values():  # no gap and no overlap
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
