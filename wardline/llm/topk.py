"""Exact top-k search by inner product over quantised vectors: columnar branch and bound.

Candidates lie in vertical blocks (one row per dimension).  A query's scores
grow one dimension block at a time, and after each block only those candidates
stay whose partial score plus the largest score that their remaining
dimensions can add reaches the query's k-th best so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import long_id

SCALE = 256
TOP = 5
DIMENSIONS_AT_ONCE = 16
QUERIES_IN_CELL = 1024
CANDIDATES_IN_CELL = 8192


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) / scale as doubles, whatever their size; ``scale`` is a power of two.

    Rows take no part if the id or vector is null, or a component is null or
    not finite.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two, so that doubles divide by it exactly")
    chosen = vectors.select(long_id(id_column, "vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    by = F.lit(float(scale))
    # doubles of 2**53 and more are whole numbers already
    floor = lambda c: F.when(F.abs(c) < 2.0**53 / scale, F.floor(c * by).cast("double") / by).otherwise(F.when(F.abs(c) < 2.0**53, F.floor(c)).otherwise(c))
    return chosen.where("vec_id IS NOT NULL AND x IS NOT NULL").where(whole).select("vec_id", F.transform("x", floor).alias("v"))


def _block(values: pd.Series, width: int, scale: int) -> np.ndarray:
    """Rows of whole numbers ``scale * v``: doubles where all are below 2**53, else Python's integers."""
    v = np.array(values.tolist(), np.float64).reshape(len(values), width)
    if np.abs(v).max(initial=0) < 2.0**53 / scale:
        return v * scale
    return np.array([int(x) * scale if abs(x) >= 2.0**53 else int(x * scale) for x in v.ravel().tolist()], object).reshape(v.shape)


def branch_and_bound(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int,
) -> list[tuple[int, int, int]]:
    """(query id, id, score) of every query's best ``top`` in one block; equal scores go to the smaller id.

    Sums are exact: in doubles while every partial sum stays below 2**53, else
    in Python's integers.  Dimensions are taken by falling energy of the
    block, and the candidates ahead after the first of them are completed
    first, since their scores open the bound.
    """
    width = vectors.shape[1]
    largest = int(max(np.abs(queries).max(initial=0), 1)) * int(max(np.abs(vectors).max(initial=0), 1)) * max(width, 1)
    kind = np.float64 if largest < 2**53 else object
    order = np.argsort(ids, kind="stable")  # so that a stable sort by score leaves smaller ids first
    whole = lambda rows: rows.astype(kind) if kind is np.float64 or rows.dtype == object else rows.astype(np.int64).astype(object)
    ids, columns, asked = ids[order], whole(vectors[order].T), whole(queries)
    if kind is np.float64:
        energy = np.argsort(-(columns**2).sum(axis=1), kind="stable")
        columns, asked = np.ascontiguousarray(columns[energy]), np.ascontiguousarray(asked[:, energy])
    cuts = list(range(0, width, DIMENSIONS_AT_ONCE)) + [width]

    def mass(rows):  # of the dimensions from each cut on, never too small; of numbers beyond doubles, without bound
        with np.errstate(over="ignore"):
            squares = np.array([[_near(v) for v in r] for r in rows]) if rows.dtype == object else rows
            squares = squares.reshape(rows.shape).astype(np.float64) ** 2
            return [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) + 1e-9 for c in cuts]

    own, other = mass(asked.T), mass(columns)

    def part(q, lo, hi, which):
        taken = columns[lo:hi] if len(which) == len(ids) else columns[lo:hi, which]
        return q[lo:hi] @ taken if kind is np.float64 else (q[lo:hi, None] * taken).sum(axis=0)

    out = []
    for n, q in enumerate(asked):
        live = np.flatnonzero(ids != query_ids[n])
        if not len(live):
            continue
        score, least = np.zeros(len(live), kind), None
        for step, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            score = score + part(q, lo, hi, live)
            if hi == width or len(live) <= top:
                continue
            if least is None:  # the k-th best of a few whole scores
                ahead = np.argsort(-score, kind="stable")[: 4 * top]
                least = _near(sorted((score[ahead] + part(q, hi, width, live[ahead])).tolist())[-top])
            reached = score if kind is np.float64 else np.array([_near(v) for v in score], np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                reach = reached + own[step + 1][n] * other[step + 1][live]
                stays = ~(reach * (1 + 1e-9 * np.sign(reach)) + 1 < least - abs(least) * 1e-9)
            live, score = live[stays], score[stays]
        best = np.argsort(-score, kind="stable")[:top]
        out.extend((int(query_ids[n]), int(ids[live[b]]), int(score[b])) for b in best)
    return out


def _near(value: int | float) -> float:
    """The number as a double; beyond their range, infinite."""
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def _search(q: pd.DataFrame, c: pd.DataFrame, width: int, top: int, scale: int) -> list[tuple[int, int, int]]:
    """Best rows of a cell, whose few vectors of large numbers meet the others apart, so that these stay in doubles."""
    narrow = lambda rows: rows["v"].map(lambda v: max(map(abs, v), default=0.0) < 2.0**26 / max(width, 1) ** 0.5 / scale).to_numpy(bool)
    found = []
    for some_q in (q[narrow(q)], q[~narrow(q)]):
        for some_c in (c[narrow(c)], c[~narrow(c)]):
            if len(some_q) and len(some_c):
                found += branch_and_bound(
                    _block(some_q["v"], width, scale), some_q["vec_id"].to_numpy(), _block(some_c["v"], width, scale),
                    some_c["vec_id"].to_numpy(), top)
    return found


def order_key(score: int) -> str:
    """Text that sorts as the whole number does, of up to 9,999 digits."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50, top: int = TOP,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` rows of highest inner product for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id.  Vectors meet only vectors of the
    same length.  Of rows that repeat id and vector one counts; rows that share
    an id but not the vector all count as candidates, and as one query each
    under that id, of which the best scores are returned once per row found.
    Empty tables give no row.  Scores are ranked exactly whatever their size;
    one beyond the range of a long is returned as the nearest long.

    Queries and candidates are dealt into a grid of cells, each with a bounded
    number of either, so every pair meets in exactly one cell and no side is
    broadcast; each cell returns at most ``top`` rows a query.
    """
    whole = quantised(vectors, id_column, vector_column).distinct().withColumn("width", F.size("v"))
    asked = whole.where(F.col("vec_id") % every == 0)
    counts = whole.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    down, across = max(1, -(-counts.q // QUERIES_IN_CELL)), max(1, -(-counts.n // CANDIDATES_IN_CELL))

    def cells(df, own, of_own, of_other, query):
        own_cell = F.pmod(F.xxhash64("vec_id", "v"), F.lit(of_own)).cast("int")
        every_cell = F.explode(F.sequence(F.lit(0), F.lit(of_other - 1)))
        placed = df.withColumn("own", own_cell).withColumn("other", every_cell)
        row, column = ("own", "other") if query else ("other", "own")
        return placed.select("width", F.col(row).alias("down"), F.col(column).alias("across"), "vec_id", "v", F.lit(query).alias("query"))

    both = cells(asked, "down", down, across, True).unionByName(cells(whole, "across", across, down, False))

    def search(key, cell: pd.DataFrame) -> pd.DataFrame:
        rows = _search(cell[cell["query"]], cell[~cell["query"]], int(key[0]), top, SCALE)
        near = [(q, i, max(-(2**63), min(2**63 - 1, s)), order_key(s)) for q, i, s in rows]
        return pd.DataFrame(near, columns=["query_id", "vec_id", "score", "key"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    found = both.groupBy("width", "down", "across").applyInPandas(search, "query_id long, vec_id long, score long, key string")
    order = W.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(every: int = 50, top: int = TOP, scale: int = SCALE) -> str:
    """The same rows by comparing every pair, as DuckDB SQL."""
    return f"""
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
      WHERE q.vec_id % {every} = 0
    )
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
    WHERE n <= {top}"""
