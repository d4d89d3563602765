import random
from fractions import Fraction

import pytest

from wardline.llm import mixing


@pytest.mark.parametrize("seed", range(4))
def test_shares_never_drift_from_the_given_weights(seed):
    rng = random.Random(seed)
    given = {f"s{i}" if i else None: rng.random() ** 4 + 1e-5 for i in range(12)}
    units = mixing.exact_weights(given)
    whole = sum(map(Fraction, given.values()))
    share = {k: Fraction(w) / whole for k, w in given.items()}
    assert all(Fraction(u, sum(units.values())) == share[k] for k, u in units.items())
    names, slots = list(units), 20 * mixing.PERIOD
    done = dict.fromkeys(names, 0)
    for t, (k, j, release, deadline, slot) in zip(range(slots), mixing.walk(list(units.values()), [slots] * 12, [0] * 12, 0)):
        assert slot == t and release <= slot < deadline and j == done[names[k]] + 1
        done[names[k]] = j
        if t % 97 == 0 or t > slots - 50:
            assert all(abs(done[n] - share[n] * (t + 1)) < 1 for n in names)


def test_mix_keeps_the_given_weights_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS_AT_ONCE", 1000)
    weights = {"big": 0.7, "mid": 0.29963, "tiny": 0.00037}
    docs = spark.range(16000).selectExpr(
        "id doc_id", "repeat('x', 10) text", "CASE WHEN id < 11000 THEN 'big' WHEN id < 15990 THEN 'mid' ELSE 'tiny' END source")
    out = mixing.mix(docs, weights, block_chars=10).collect()
    slots = sorted((r.slot, r.source) for r in out)
    assert len({s for s, _ in slots}) == len(slots) == 16000
    whole = sum(map(Fraction, weights.values()))
    done = dict.fromkeys(weights, 0)
    for t, (slot, source) in enumerate(slots[:15000]):
        assert slot == t
        done[source] += 1
        assert all(abs(done[k] - Fraction(w) / whole * (t + 1)) < 1 for k, w in weights.items())
