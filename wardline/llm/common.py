"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.storage import materialize, workspace

__all__ = [
    "Batches", "PolynomialHash", "bucket_count", "column_bytes", "components", "documents", "emit", "give_back_memory", "long_id",
    "materialize", "may_be_among", "mix64", "partition_count", "rows_of_batches", "small_batches", "sorted_runs", "star_edges", "table", "take_columns",
    "where_found", "workspace",
]

TEXTS_IN_BATCH = 1000

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let batches between Spark and Python hold a few MB of texts instead of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_IN_BATCH))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def take_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under their working names, so that no other column of ``df`` can clash."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in wanted.items()])


def partition_count(df: DataFrame) -> int:
    """Shuffle width of the session; the cluster sizes it to its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(items: int, per_bucket: int, least: int) -> int:
    """Buckets that hold about ``per_bucket`` items each."""
    return max(least, -(-items // per_bucket))


def long_id(name: str, at: str | None = None):
    return F.col(f"`{name}`").cast("long").alias(at or name)


# --- bytes of a batch --------------------------------------------------------------------------------------------


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values' UTF-8 bytes end to end, and the n + 1 offsets of the values in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    n = len(wide)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(at)
    if wide.null_count:  # bytes below a null, if any, belong to no value
        lengths = np.where(np.asarray(wide.is_valid()), lengths, 0)
        if lengths.sum() != at[-1] - at[0]:
            parts = [flat[a : a + k] for a, k in zip(at[:-1].tolist(), lengths.tolist(), strict=True) if k]
            flat, at = (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), np.zeros(1, np.int64)
    return flat[at[0] : at[0] + int(lengths.sum())], np.concatenate(([0], np.cumsum(lengths)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PolynomialHash:
    """Hashes of any stretches of one byte string from its prefix sums, modulo 2**64."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(known: np.ndarray, base: int, n: int) -> np.ndarray:
        out = np.empty(max(n, 2 * len(known)), np.uint64)
        out[: len(known)] = known
        k = len(known)
        while k < len(out):
            m = min(k, len(out) - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self._up) < n:
            self._up, self._down = self._powers(self._up, self.base, n), self._powers(self._down, self.inverse, n)
        out = np.empty(n, np.uint64)
        out[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[: n - 1], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self._down[start] + (end - start).astype(np.uint64))


# --- groups of a sorted partition --------------------------------------------------------------------------------


def rows_of_batches(batches: Iterable[pa.RecordBatch], rows: int = 0, size: int = 8 << 20) -> Iterator[pa.Table]:
    """The batches gathered to tables of about ``size`` bytes (and at least ``rows`` rows, if given)."""
    held: list[pa.RecordBatch] = []
    n = b = 0
    for batch in batches:
        while batch.num_rows:
            step = max(1, min(batch.num_rows, int(batch.num_rows * size / max(1, batch.nbytes)) or 1))
            part, batch = batch.slice(0, step), batch.slice(step)
            held.append(part)
            n, b = n + step, b + part.nbytes
            if b >= size and n >= rows:
                yield pa.Table.from_batches(held)
                held, n, b = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    del held
    give_back_memory()


def give_back_memory() -> None:
    """Return what a Python worker has freed to the machine; workers outlive tasks and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str], size: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables that never split a run of equal ``keys``, from a partition sorted by them."""
    left: pa.Table | None = None
    for part in rows_of_batches(batches, size=size):
        part = pa.concat_tables([left, part]) if left is not None else part
        last = part.slice(part.num_rows - 1)
        same = np.ones(part.num_rows, bool)
        for k in keys:
            same &= np.asarray(pa.compute.equal(part[k], last[k][0]).combine_chunks().fill_null(last[k][0].as_py() is None))
        cut = part.num_rows - (int(np.argmin(same[::-1])) if not same.all() else part.num_rows)
        left = part.slice(cut)
        if cut:
            yield part.slice(0, cut)
    if left is not None and left.num_rows:
        yield left


# --- rows that may be among some ids -----------------------------------------------------------------------------

FILTER_BITS = 16  # for each id
MOST_FILTER_BITS = 1 << 27  # 16 MB; beyond 8 million ids more rows pass in vain


def _filter_places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(ids.astype(np.int64).view(np.uint64))
    return mixed % np.uint64(bits), mix64(mixed + np.uint64(1)) % np.uint64(bits)


def may_be_among(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """For tasks: which of an array's longs may be in the one column of ``ids``; all that are, and few others.

    It saves a join the shuffle of rows it would not find; the join itself
    still has to follow.  The ids become a bit filter of bounded size, of which
    tasks send the bits that are set, combined by word; the driver holds the
    words and broadcasts them.
    """
    spark, name = ids.sparkSession, ids.columns[0]
    ids = ids.where(F.col(f"`{name}`").isNotNull())
    bits = min(MOST_FILTER_BITS, max(64, 1 << (FILTER_BITS * ids.count()).bit_length()))

    def step(batches: Batches) -> Batches:
        for part in batches:
            at = np.concatenate(_filter_places(np.asarray(part.column(0)), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    found = ids.mapInArrow(step, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[np.asarray(found["word"])] = np.asarray(found["bits"])
    shared = spark.sparkContext.broadcast(words.tobytes())

    def found_in(values: np.ndarray) -> np.ndarray:
        held = np.frombuffer(shared.value, np.uint64)
        found = np.ones(len(values), bool)
        for at in _filter_places(values, bits):
            found &= (held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    return found_in


def where_found(column: Column, found_in: Callable[[np.ndarray], np.ndarray]) -> Column:
    """The condition on a column of longs; null counts as zero."""
    @F.arrow_udf("boolean")
    def passes(values: pa.Array) -> pa.Array:
        return pa.array(found_in(np.asarray(values)))

    return passes(F.coalesce(column, F.lit(0).cast("long")))


# --- connected components ----------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b; longs); component: the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones.  Each step is a
    minimum by node (combined before the shuffle) joined back to the edges, a
    join whose hot keys Spark can split; the edges are written to the shared
    folder after each round.  Self-links are dropped; an empty input gives an
    empty result.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        # large star: larger neighbours of a node go to the smallest node around it
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        current = materialize(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def star_edges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect what the given ones connect: every node with the smallest one of its component."""
    nodes, flat = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


Batches = Iterator[pa.RecordBatch]


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
