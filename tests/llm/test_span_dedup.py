import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty_frame, odd_documents, odd_frame, prose
from wardline.llm import span_dedup
from wardline.llm.suffix_groups import suffix_arrays


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 6)):
            s = [rng.randint(2, 1 + rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.3:
                s = s[: rng.randint(1, 5)] * rng.randint(1, 12)
            if rng.random() > 0.7:
                s = s + [1] + s + [1] + s[:-2] + [1]
            texts.append(s + [0])
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = suffix_arrays(np.array([x for t in texts for x in t]), bounds)
        assert got.tolist() == [bounds[i] + k for i, t in enumerate(texts) for k in sorted(range(len(t)), key=lambda k: t[k:])]


def plain_repeats(rows, length=100):
    """rows in order: (id, text) -> (id, bytes, removed, spans, hash), by a set of all strings."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def in_order(spark, rows):
    """Rows of one id by Spark's hash of their texts, as the operator orders them."""
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] is not None], "doc_id long, text string")
    return [(r.doc_id, r.text) for r in frame.selectExpr("*", "xxhash64(text) AS h").orderBy("doc_id", "h", "text").collect()]


@pytest.mark.parametrize("crowded", [span_dedup.CROWDED, 1])
def test_odd_rows(spark, crowded):
    got = span_dedup.repeated_passages(odd_frame(spark), crowded=crowded).collect()
    assert sorted(map(tuple, got)) == sorted(plain_repeats(in_order(spark, odd_documents())))


@pytest.mark.parametrize("crowded", [span_dedup.CROWDED, 2])
def test_passages_in_many_surroundings(spark, crowded):
    rng = random.Random(11)
    passages = [prose(rng, 30) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 40)
            parts += [p[cut:], prose(rng, rng.randint(0, 12))]
        if i % 7 == 0:
            parts.append("ab" * rng.randint(30, 90))
        rows.append((i, " ".join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = span_dedup.repeated_passages(frame, crowded=crowded).collect()
    want = plain_repeats(rows)
    assert sum(w[2] for w in want) > 5000
    assert sorted(map(tuple, got)) == want


def test_cleaned_keeps_columns_and_characters(spark):
    frame = odd_frame(spark)
    out = span_dedup.cleaned(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    removed = {w[0]: w for w in plain_repeats(in_order(spark, odd_documents()))}
    for r in out.where("doc_id IS NOT NULL AND doc_id NOT IN (3, 12)").collect():
        _, size, gone, _, digest = removed[r.doc_id]
        if r.text is None:
            assert size == 0
        elif r.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
        else:
            assert size - gone <= len(r.text.encode()) <= size
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {r[1] for r in odd_documents() if r[0] is None}


def test_cleaned_shuffles_texts_no_more_than_twice(spark):
    """All columns go with the texts to the step that removes spans; nothing is joined to them afterwards."""
    frame = odd_frame(spark).where("doc_id NOT IN (3, 12)").withColumn("more", F.struct(F.array("source", "lang").alias("a.b"), F.lit(1.5).cast("decimal(9,2)")))
    out = span_dedup.cleaned(frame)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
    assert sorted(map(repr, out.drop("text").collect())) == sorted(map(repr, frame.drop("text").collect()))


def test_empty(spark):
    assert span_dedup.repeated_passages(empty_frame(spark)).collect() == []
