"""Whitening of embeddings by incremental eigendecomposition.

Every partition keeps a count, a mean and the spectrum of its scatter matrix,
and takes in rows as centred rank-one updates: the secular equation gives the
new eigenvalues, deflation keeps what does not change.  Spectra of partitions
are combined by the rank-one updates of one of them, a few at a time until one
is left.  A last distributed pass measures the scatter in that basis and
rotates it (Rayleigh-Ritz), which leaves rounding errors only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.local import union_all
from wardline.llm.common import Batches, emit, give_back_memory, long_id, materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS_AT_ONCE = 2048  # of a block that is first rotated to at most as many rows as it has columns
SPECTRA_AT_ONCE = 16
MOST_WIDTHS = 256

_EPS = np.finfo(float).eps


# --- one symmetric matrix under rank-one updates -----------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i**2 / (d_i - x) for ascending, different d and nonzero z.

    One root lies above each d_i and below the next one.  Returned as the index
    of the nearer d of each root and the root's offset from it, by bisection in
    the offset, so that differences from close poles keep their digits.
    """
    n, squares = len(d), z * z
    gap = np.append(np.diff(d), squares.sum())
    middle = d + gap / 2
    value = 1 + (squares / (d[None, :] - middle[:, None])).sum(axis=1)
    upper = (value < 0) & (np.arange(n) < n - 1)  # nearer to the next pole
    origin = np.arange(n) + upper
    shifted = d[None, :] - d[origin][:, None]
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, np.where(np.arange(n) < n - 1, gap / 2, gap))
    for _ in range(60):
        x = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            value = 1 + (squares / (shifted - x[:, None])).sum(axis=1)
        below = value < 0
        low, high = np.where(below, x, low), np.where(below, high, x)
    x = (low + high) / 2
    return origin, np.where(x == 0, np.where(upper, -1, 1) * np.finfo(float).tiny, x)


@dataclass
class Spectrum:
    """n rows of mean ``mean`` whose scatter (sum of centred squares) is ``vectors @ diag(values) @ vectors.T``."""

    width: int
    n: int = 0
    mean: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)
    vectors: np.ndarray = field(init=False)

    def __post_init__(self):
        self.mean, self.values, self.vectors = np.zeros(self.width), np.zeros(self.width), np.eye(self.width)

    def add(self, v: np.ndarray) -> None:
        """Scatter + v v.T."""
        size = float(np.abs(v).max(initial=0))
        if size == 0:
            return
        order = np.argsort(self.values, kind="stable")
        d, q = self.values[order].copy(), self.vectors[:, order].copy()
        z = q.T @ v
        bound = 8 * _EPS * max(float(np.abs(d).max(initial=0)), float(z @ z))
        # equal values share a plane in which one direction can be turned away from v
        last = 0
        for i in range(1, len(d)):
            if d[i] - d[last] <= bound and z[last]:
                r = float(np.hypot(z[last], z[i]))
                c, s = z[i] / r, z[last] / r
                z[last], z[i] = 0.0, r
                q[:, [last, i]] = q[:, [last, i]] @ np.array([[c, s], [-s, c]])
            last = i
        moved = np.flatnonzero(np.abs(z) * np.sqrt(float(z @ z)) > bound)
        if len(moved):
            dm, zm = d[moved], z[moved]
            origin, offset = secular_roots(dm, zm)
            # poles minus roots, and from them the z to which these roots belong exactly: orthogonal vectors
            apart = (dm[:, None] - dm[origin][None, :]) - offset[None, :]
            k = np.arange(len(dm))
            between = dm[None, :] - dm[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(k[:, None] == k[None, :], -apart, -apart / between)
            exact = np.sqrt(np.maximum(np.abs(np.prod(ratio, axis=1)), np.finfo(float).tiny)) * np.sign(zm)
            new = exact[:, None] / apart
            new /= np.linalg.norm(new, axis=0)
            q[:, moved] = q[:, moved] @ new
            d[moved] = dm[origin] + offset
        self.values, self.vectors = d, q

    def add_rows(self, rows: np.ndarray) -> None:
        """Rows of doubles; a block is centred and, if it is taller than wide, rotated to an equal scatter of ``width`` rows."""
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        block = rows - mean
        if len(block) > self.width:
            block = np.linalg.qr(block, mode="r")
        self._joined(len(rows), mean, block)

    def add_spectrum(self, other: Spectrum) -> None:
        """What ``other`` has seen as well: one rank-one update for each of its directions, one for the distance of the means."""
        if other.n:
            self._joined(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def _joined(self, n: int, mean: np.ndarray, updates: np.ndarray) -> None:
        for v in updates:
            self.add(v)
        if self.n:
            self.add(np.sqrt(self.n / (self.n + n) * n) * (mean - self.mean))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n


# --- over a table ------------------------------------------------------------------------------------------------


def scaled(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x): entries floor(1024 * c) + 100000 as longs, of rows whose entries are all finite and fit."""
    chosen = vectors.select(long_id(id_column, "vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * F.lit(float(SCALE)) < 2.0**62))
    entry = lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT)
    return chosen.where("vec_id IS NOT NULL AND x IS NOT NULL").where(whole).select("vec_id", F.transform("x", entry).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _array(values: np.ndarray) -> list[list[float]]:
    return [np.asarray(values, np.float64).ravel().tolist()]


_SPECTRUM = pa.schema([
    ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())),
    ("eigen", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
_SPECTRUM_DDL = "part long, n long, sums array<string>, mean array<double>, eigen array<double>, vectors array<double>"


def _spectrum_row(part: int, sums: list[int], s: Spectrum) -> dict:
    """Sums are whole numbers of any size, as text; the spectrum is in doubles around SHIFT."""
    return {"part": part, "n": s.n, "sums": [str(x) for x in sums], "mean": s.mean.tolist(), "eigen": s.values.tolist(),
            "vectors": s.vectors.ravel().tolist()}


def _spectrum_of(row, width: int) -> Spectrum:
    s = Spectrum(width)
    s.n, s.mean, s.values = int(row["n"]), np.array(row["mean"], float), np.array(row["eigen"], float)
    s.vectors = np.array(row["vectors"], float).reshape(width, width)
    return s


def _whole_sums(x: np.ndarray) -> list[int]:
    largest = int(np.abs(x).max(initial=0))
    return [int(v) for v in (x.sum(axis=0) if largest * len(x) < 2**63 else x.astype(object).sum(axis=0))]


def fit_spectrum(rows: DataFrame, width: int, rows_at_once: int = ROWS_AT_ONCE) -> tuple[list[int], Spectrum] | None:
    """Exact sums by dimension and the spectrum of all rows (None without any); it holds width**2 doubles."""
    def partition(batches: Batches) -> Batches:
        s, sums, held = Spectrum(width), [0] * width, []

        def take(block):
            nonlocal sums
            sums = [a + b for a, b in zip(sums, _whole_sums(block), strict=True)]
            s.add_rows((block - SHIFT).astype(float))

        for batch in batches:
            held.append(_matrix(batch.column("x"), width))
            if sum(map(len, held)) >= rows_at_once:
                block = np.concatenate(held)
                cut = len(block) - len(block) % rows_at_once
                for at in range(0, cut, rows_at_once):
                    take(block[at : at + rows_at_once])
                held = [block[cut:]]
        if held:
            take(np.concatenate(held))
        if s.n:
            yield pa.RecordBatch.from_pylist([_spectrum_row(TaskContext.get().partitionId(), sums, s)], schema=_SPECTRUM)
        give_back_memory()

    def combined(key, group: pd.DataFrame) -> pd.DataFrame:
        total, sums = Spectrum(width), [0] * width
        for row in group.sort_values("part").to_dict("records"):
            total.add_spectrum(_spectrum_of(row, width))
            sums = [a + int(b) for a, b in zip(sums, row["sums"], strict=True)]
        return pd.DataFrame([_spectrum_row(int(key[0]), sums, total)])

    spectra = materialize(rows.select("x").mapInArrow(partition, _SPECTRUM_DDL), "spectra")
    while (count := spectra.count()) > 1:
        by = F.floor(F.col("part") / SPECTRA_AT_ONCE).cast("long")
        spectra = materialize(spectra.groupBy(by.alias("group")).applyInPandas(combined, _SPECTRUM_DDL), "spectra")
    if not count:
        return None
    row = spectra.first()
    return [int(x) for x in row["sums"]], _spectrum_of(row, width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit where that is sure to fit, else whole numbers of any size."""
    most = max([int(np.abs(x).max(initial=0)) * n, *map(abs, sums)]) if len(x) else 0
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _summed_matrix(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum over all rows of what ``part(batches)`` returns for a partition: a size x size matrix."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def step(batches: Batches) -> Batches:
        total = part(batches)
        i, j = np.nonzero(total)
        yield emit(schema, i=i.astype(np.int32), j=j.astype(np.int32), value=total[i, j])

    out = np.zeros((size, size))
    for r in rows.mapInArrow(step, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = r["value"]  # size**2 numbers
    return out


def rayleigh_ritz(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the rows' covariance and unit eigenvectors (columns), from its projection on ``basis``."""
    width = len(basis)

    def part(batches: Batches) -> np.ndarray:
        total = np.zeros((width, width))
        for batch in batches:
            y = (_centred(_matrix(batch.column("x"), width), n, sums) / n).astype(float) @ basis
            total += y.T @ y
        return total

    measured = _summed_matrix(rows.select("x"), width, part) / n
    values, turn = np.linalg.eigh((measured + measured.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], np.linalg.qr(basis @ turn[:, order])[0]


_OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())])


def _whiten_width(rows: DataFrame, width: int, components: int, rows_at_once: int) -> DataFrame | None:
    fitted = fit_spectrum(rows, width, rows_at_once)
    if fitted is None:
        return None
    sums, spectrum = fitted
    n, top = spectrum.n, min(components, width)
    values, vectors = rayleigh_ritz(rows, n, sums, np.linalg.qr(spectrum.vectors)[0])
    trace = float(np.maximum(values, 0).sum())
    live = values[:top] > trace * width * 8 * _EPS
    weights = vectors[:, :top][:, live] / np.sqrt(values[:top][live])
    shown = np.flatnonzero(live)

    def projected(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums) / n).astype(float) @ weights

    def measure(batches: Batches) -> np.ndarray:  # products in the upper block, sums beside it
        total = np.zeros((len(shown) + 1, len(shown) + 1))
        for batch in batches:
            w = projected(_matrix(batch.column("x"), width))
            total[:-1, :-1] += w.T @ w
            total[:-1, -1] += w.sum(axis=0)
        return total

    error = None
    if len(shown):
        total = _summed_matrix(rows.select("x"), len(shown) + 1, measure)
        mean = total[:-1, -1] / n
        error = float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(shown))).max())

    def out(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            off = _centred(x, n, sums)
            small = off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * width < 2**63
            squares = (off * off if small else off.astype(object) ** 2).sum(axis=1)
            kind = pa.decimal128(38, 0)
            deviation = pa.array(squares).cast(kind) if small else pa.array([d if d < 10**38 else None for d in squares], kind)
            whitened = np.full((len(x), top), np.nan)
            whitened[:, shown] = projected(x)
            flat = whitened.ravel()
            yield emit(
                _OUT, vec_id=np.repeat(np.asarray(batch.column("vec_id")), top), component=np.tile(np.arange(1, top + 1, dtype=np.int32), len(x)),
                deviation=deviation.take(pa.array(np.repeat(np.arange(len(x)), top))),
                whitened=pa.array(flat, mask=np.isnan(flat)))

    found = rows.mapInArrow(out, "vec_id long, component int, deviation decimal(38,0), whitened double")
    explained = F.element_at(F.array(*[F.lit(float(max(v, 0) / trace) if trace else 0.0) for v in values[:top]]), F.col("component"))
    return found.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """One row for each usable vector and each of the first ``components`` directions of largest variance.

    vec_id, component (from 1, by falling variance), n (vectors fitted),
    deviation (squared distance from the mean times n**2, exact; null from
    10**38 on), whitened (projection over the standard deviation), explained
    (share of the total variance), identity_error (largest entry of the whitened
    covariance minus the identity, measured over all rows).

    Left out are rows without id or vector and vectors with a null, non-finite
    or no longer countable entry (|1024 c| of 2**62 and more).  Repeated rows
    each count.  Vectors of different lengths are fitted apart from each other;
    those of no entry give no row, nor does an empty table.  A direction without
    variance (fewer different vectors than components) has whitened null and
    plays no part in identity_error.  Equal variances leave a choice of
    directions; one is taken for all rows.

    ``rows_at_once``: rows whose scatter is rotated into at most as many rank-one
    updates as there are dimensions; 1 updates row by row.
    """
    rows = scaled(vectors, id_column, vector_column)
    widths = [r["w"] for r in rows.select(F.size("x").alias("w")).distinct().limit(MOST_WIDTHS + 1).collect()]
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"more than {MOST_WIDTHS} different lengths of vectors; fit them in several calls")
    fits = [_whiten_width(rows.where(F.size("x") == w), w, components, rows_at_once) for w in sorted(widths) if w]
    fits = [f for f in fits if f is not None]
    if not fits:
        kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], kinds)
    return union_all(fits)


def digest(found: DataFrame) -> DataFrame:
    """``whiten``'s rows with the deviation as a long (null where it does not fit)."""
    fits: Column = F.when(F.col("deviation") <= F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("deviation")).cast("long")
    return found.withColumn("deviation", fits)
