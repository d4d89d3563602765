import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import nn_descent, topk

SCHEMA = "vec_id long, embedding array<float>, label int, component_id long, rank int, node long, unit string"


def vectors(width=8, seed=2):
    """Scattered vectors, tight clusters, copies, scaled copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        rows.append((i, rng.standard_normal(width).tolist(), i % 3))
    for c in range(3):
        centre = rng.standard_normal(width)
        rows += [(100 + 50 * c + k, (centre + 0.08 * rng.standard_normal(width)).tolist(), c) for k in range(40)]
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(6)]
    rows += [(310, [2 * x for x in rows[5][1]], rows[5][2]), (311, rows[5][1], 9), (312, rows[5][1], None)]
    rows += [
        (400, None, 1), (401, [0.0] * width, 1), (402, [None] + [1.0] * (width - 1), 1), (403, [math.nan] * width, 1),
        (404, [math.inf] + [0.0] * (width - 1), 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (408, [1e-30] * width, 1),
        (409, [1e30] * width, 1), (5, rows[5][1], rows[5][2]), (50, rows[9][1], 2), (None, rows[5][1], 1)]
    return [(*r, 7, 7, 7, "clash") for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def stored(rows):
    """Components as floats hold them."""
    return [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows if r[0] is not None]


def plain_links(rows, threshold):
    rows = stored(rows)
    ok = [r[2] is not None and usable(r[1]) and any(r[1]) for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].add(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min(rows[j][0] for j in seen)
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out)


@pytest.mark.parametrize("block", [nn_descent.BLOCK])
def test_links(spark, block):
    rows = vectors()
    got = nn_descent.near_vectors(frame(spark, rows), keep=4).collect()
    assert sorted(map(tuple, got)) == plain_links(rows, 0.98)


def test_few_trees_are_refined_and_audited(spark):
    rows = vectors(width=16, seed=8)
    got = nn_descent.near_vectors(frame(spark, rows), keep=3, trees=2).collect()
    assert sorted(map(tuple, got)) == plain_links(rows, 0.98)


def test_audit_goes_on_until_it_meets_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 12))
    x[51] = x[17] + 1e-3  # the only link
    rows = [(n, v.tolist(), "a") for n, v in enumerate(x)]
    good = nn_descent.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), "vec_id", "embedding", "label")
    classes = good.select(F.col("vec_id").alias("node"), "label", "unit", F.xxhash64("vec_id").alias("salted"))
    for size, most in ((8, 16), (8, 4096), (60, 4096)):
        monkeypatch.setattr(nn_descent, "AUDITED", size)
        monkeypatch.setattr(nn_descent, "MOST_AUDITED", most)
        truth, links, audited = nn_descent._audit(classes, classes, 0.98)
        got = {r.node: r.truth for r in truth.collect()}
        assert len(got) == audited == min(most, 60) and links == sum(got.values())
        assert all(got[n] == (n in (17, 51)) for n in got)
        counts = spark.createDataFrame([(n, 0) for n in range(60)], "node long, others long")
        assert nn_descent._recall(truth, counts) == (0 if links else 1)


def test_audit_reports_what_it_cannot_vouch_for():
    with pytest.raises(RuntimeError, match="0.800"):
        nn_descent._report(0.8, 900, 256, 10**6)
    for recall, links in ((0.95, 900), (1.0, 0), (1.0, 199)):
        with pytest.warns(UserWarning, match=f"{links} links"):
            nn_descent._report(recall, links, 256, 10**6)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        nn_descent._report(1.0, 900, 256, 10**6)
        nn_descent._report(1.0, 0, 40, 40)


def test_best_pairs_by_blocks(monkeypatch):
    x = np.random.default_rng(1).standard_normal((150, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    i, j, c = nn_descent.best_pairs(x, 0.3, 5)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    for n in range(len(x)):
        want = sorted((v for v in cosine[n] if v >= 0.3), reverse=True)[:5]
        assert np.allclose(sorted(c[i == n], reverse=True), want)


def test_no_vectors(spark):
    assert nn_descent.near_vectors(frame(spark, [])).collect() == []
    assert topk.top_k(frame(spark, [])).collect() == []


def plain_top(rows, every, top):
    distinct = {(i, tuple(math.floor(256 * x) for x in v)) for i, v, _ in stored(rows) if usable(v)}
    out = []
    for q in {d for d in distinct if d[0] % every == 0}:
        scores = [(-sum(a * b for a, b in zip(q[1], d[1], strict=True)), d[0]) for d in distinct if d[0] != q[0] and len(d[1]) == len(q[1])]
        out += [(q[0], -s, i) for s, i in sorted(scores)[:top]]
    return out


def test_top_k(spark):
    rows = vectors()
    got = topk.top_k(frame(spark, rows), every=5, top=3).collect()
    want = [w for w in plain_top(rows, 5, 3)]
    single = [q for q in {w[0] for w in want} if sum(1 for i, v, _ in stored(rows) if i == q and usable(v)) == 1]
    in_long = lambda s: max(-(2**63), min(2**63 - 1, s))
    by_query = {q: [(-in_long(-s), i) for s, i in sorted((-s, i) for p, s, i in want if p == q)] for q in single}
    for q in single:
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1:] for m in mine] == by_query[q]
    assert {r.query_id for r in got} >= set(single)


def test_numbers_beyond_longs_are_ranked_exactly(spark):
    rng = random.Random(4)
    wide = [[2.0**45, 1.0], [2.0**50, -3.5], [-(2.0**50), 2.0**50], [1e300, 1e300], [-1e307, 7.0], [1.7e308, -1.7e308], [2.0**60, 0.3]]
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(wide + [[rng.uniform(-9, 9) for _ in range(2)] for _ in range(30)])]
    whole = {n: [math.floor(x * 256) if abs(x) < 2**40 else int(x) * 256 for x in v] for n, v in rows}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1, top=4).collect()
    for q, v in whole.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), n) for n, w in whole.items() if n != q)[:4]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(k + 1, n, max(-(2**63), min(2**63 - 1, -s))) for k, (s, n) in enumerate(best)]


def test_order_key_sorts_as_numbers():
    numbers = [0, 1, -1, 9, 10, -9, -10, 99, -99, 2**63, -(2**63), 10**600, -(10**600)]
    assert sorted(numbers) == sorted(numbers, key=topk.order_key)


def test_bound_holds_for_large_and_equal_numbers():
    rng = random.Random(3)
    for scale in (3, 10**6, 10**12):
        v = np.array([[rng.randint(-scale, scale) for _ in range(40)] for _ in range(300)])
        v[100:110] = v[5]
        ids = np.arange(300)[::-1].copy()
        got = topk.branch_and_bound(v[:20], ids[:20], v, ids, 5)
        for n in range(20):
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(v[n], v[m], strict=True)), int(ids[m])) for m in range(300) if m != n)[:5]
            assert [(q, s, i) for q, i, s in got if q == ids[n]] == [(int(ids[n]), -s, i) for s, i in scores]
