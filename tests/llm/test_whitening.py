import math

import numpy as np
import pytest

from wardline.llm import whitening
from wardline.llm.whitening import Spectrum

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, x string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, 7, 7, "clash") for r in rows], SCHEMA).repartition(parts)


def scatter(rows):
    off = rows - rows.mean(axis=0)
    return off.T @ off


def close(s, rows):
    want = scatter(rows)
    got = s.vectors @ np.diag(s.values) @ s.vectors.T
    assert s.n == len(rows) and np.allclose(s.mean, rows.mean(axis=0))
    assert np.abs(got - want).max() <= 1e-11 * max(np.abs(want).max(), 1e-300)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(s.width)).max() < 1e-11


def samples():
    rng = np.random.default_rng(3)
    yield rng.standard_normal((50, 6)) * [1e3, 1, 1, 1e-3, 1e-6, 0]
    yield np.repeat(rng.standard_normal((3, 5)), 4, axis=0)  # few directions, repeated rows
    yield np.zeros((4, 3))
    yield np.eye(4)[[0, 1, 2, 3, 0, 1, 2, 3]]  # equal eigenvalues
    yield rng.integers(-3, 4, (200, 8)).astype(float)
    yield rng.standard_normal((2, 7))
    yield rng.standard_normal((300, 1))


def test_rank_one_updates():
    for rows in samples():
        for at_once in (1, 3, 1000):
            s = Spectrum(rows.shape[1])
            for at in range(0, len(rows), at_once):
                s.add_rows(rows[at : at + at_once])
            close(s, rows)


def test_combined_spectra():
    for rows in samples():
        parts = [rows[k::3] for k in range(3)]
        total = Spectrum(rows.shape[1])
        for p in parts:
            s = Spectrum(rows.shape[1])
            s.add_rows(p)
            total.add_spectrum(s)
        close(total, np.concatenate(parts))


def test_roots_lie_between_the_poles():
    rng = np.random.default_rng(6)
    d, z = np.sort(rng.standard_normal(30)), rng.standard_normal(30) * 10.0 ** rng.integers(-4, 3, 30)
    origin, offset = whitening.secular_roots(d, z)
    roots = d[origin] + offset
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)))
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()


def vectors(n=700, width=12, seed=1):
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((n, width)) @ (rng.standard_normal((width, width)) * np.linspace(0.02, 1, width)) + rng.standard_normal(width)
    rows = [(i, v.tolist()) for i, v in enumerate(out)]
    return rows + [(0, rows[0][1]), (5, rows[9][1])]  # a repeated row, an id with two vectors


ODD = [
    (900, None), (901, [None] + [1.0] * 11), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (None, [1.0] * 12),
    (905, [3e38] * 12)]


def whole_numbers(rows):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], object)


def check(got, rows, components):
    x = whole_numbers(rows)
    n, sums = len(x), x.sum(axis=0)
    off = ((n * x - sums) / n).astype(float)
    values, basis = np.linalg.eigh(off.T @ off / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == n * components
    deviations = sorted((i, int(sum(int(c) ** 2 for c in n * r - sums))) for (i, _), r in zip(rows, x, strict=True))
    assert sorted((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == deviations
    assert {r.n for r in got} == {n}
    for k in range(components):
        want = off @ basis[:, k] / math.sqrt(values[k])
        mine = sorted((r.vec_id, round(abs(r.whitened), 7)) for r in got if r.component == k + 1)
        assert np.allclose([m[1] for m in mine], [w[1] for w in sorted((i, round(abs(w), 7)) for (i, _), w in zip(rows, want, strict=True))], atol=1e-6)
        assert all(abs(r.explained - values[k] / values.sum()) < 1e-9 for r in got if r.component == k + 1)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("at_once", [1, 64, whitening.ROWS_AT_ONCE])
def test_against_a_dense_decomposition(spark, at_once):
    rows = vectors(n=200 if at_once == 1 else 700)
    got = whitening.whiten(frame(spark, rows + ODD, 37), components=8, rows_at_once=at_once).collect()
    check(got, rows, 8)


def test_signs_are_those_of_one_basis(spark):
    rows = vectors()
    got = whitening.whiten(frame(spark, rows), components=3).collect()
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == k] for k in (1, 2, 3)])
    assert np.abs(np.cov(w, bias=True) - np.eye(3)).max() < 1e-9


def test_lengths_are_fitted_apart(spark):
    rows, short = vectors(), [(i, v[:3]) for i, v in vectors(n=50, seed=2)]
    got = whitening.whiten(frame(spark, rows + short)).collect()
    check([r for r in got if r.n == len(rows)], rows, 8)
    check([r for r in got if r.n == len(short)], short, 3)


def test_directions_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(r.explained, 9) for r in got} == {1.0, 0.0} and got[0].identity_error < 1e-9
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        got = whitening.whiten(frame(spark, rows)).collect()
        assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, 0.0, None)}


def test_large_entries_stay_exact(spark):
    rows = [(i, [2.0**40 * i, 1.0]) for i in range(-20, 21)]
    found = whitening.whiten(frame(spark, rows))
    x = whole_numbers(rows)
    want = {i: int((41 * r[0] - x[:, 0].sum()) ** 2) for (i, _), r in zip(rows, x, strict=True)}
    assert {r.vec_id: int(r.deviation) for r in found.collect()} == want
    assert {r.vec_id: r.deviation for r in whitening.digest(found).collect()} == {i: (d if d < 2**63 else None) for i, d in want.items()}


def test_no_vectors(spark):
    found = whitening.digest(whitening.whiten(frame(spark, [])))
    assert found.collect() == [] and dict(found.dtypes)["deviation"] == "bigint"
    assert whitening.whiten(frame(spark, ODD[:6])).collect() == []
