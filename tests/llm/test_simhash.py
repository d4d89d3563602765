import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import empty_frame, odd_documents, odd_frame
from wardline.llm import simhash


def plain_fingerprint(text, shingle=4):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, most):
    """prints: [(doc, fingerprint)]; smallest doc reachable over links, by comparing all pairs."""
    component = {i: i for i in range(len(prints))}

    def root(a):
        while component[a] != a:
            a = component[a]
        return a

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= most:
                component[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, x, least[root(i)]) for i, (doc, x) in enumerate(prints)]


@pytest.mark.parametrize("shingle", [4, 5])
def test_fingerprints_and_groups(spark, shingle):
    want = plain_components([(r[0], plain_fingerprint(r[1], shingle)) for r in odd_documents() if r[0] is not None], 4)
    got = simhash.simhash_groups(odd_frame(spark), shingle=shingle).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{x:016x}", c) for d, x, c in want)


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(x) for x in base}
    for x in base.tolist():
        for bits in (1, 2, 3, 4, 5, 6):
            y = x
            for k in rng.permutation(64)[:bits].tolist():
                y ^= 1 << k
            prints.add(y)
    frame = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in prints], "fp long")
    edges = simhash.near_fingerprints(frame, 4).collect()
    mask = (1 << 64) - 1
    assert all(((e.a & mask) ^ (e.b & mask)).bit_count() <= 64 for e in edges)
    found = plain_components([(i, p) for i, p in enumerate(sorted(prints))], 4)
    number = {p: i for i, p in enumerate(sorted(prints))}
    component = {i: i for i in number.values()}

    def root(a):
        while component[a] != a:
            a = component[a]
        return a

    for e in edges:
        component[root(number[e.a & mask])] = root(number[e.b & mask])
    groups, wanted = {}, {}
    for i, _, c in found:
        groups.setdefault(root(i), set()).add(i)
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_crowded_key_keeps_few_links():
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 12, 3000, dtype=np.uint64))  # all within twelve bits of each other
    a, b = simhash.close_pairs(np.zeros(len(fps), np.uint64), fps, 4)
    assert len(a) < len(fps)
    assert len(np.setdiff1d(fps, np.concatenate((a, b)))) == 0


def test_keep_first_and_empty(spark):
    kept = simhash.keep_first(odd_frame(spark))
    assert kept.columns == odd_frame(spark).columns
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(odd_frame(spark)).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in kept.collect()} == set(groups) | {None}
    assert simhash.simhash_groups(empty_frame(spark)).collect() == []
