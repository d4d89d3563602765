"""Interleaving of sources to target weights by Pfair scheduling.

Time is cut into slots and each slot takes one block of one source.  A source
of weight w has the windows of Pfair scheduling: its j-th block (from 1) is
released at slot floor((j - 1) / w) and due by slot ceil(j / w).  In every slot
the released block with the earliest deadline goes; its source's share then
differs from w * t by less than one block at every time t.

Weights are exact: a float is a whole number over a power of two, and windows
come from those whole numbers, so no error adds up.  A source that has run out
takes no further part.  The driver walks over the blocks once and keeps the
state every ``BLOCKS_AT_ONCE`` of them; tasks walk the stretches again and
hand out the slots.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Batches, emit, long_id, materialize

PERIOD = 1024
BLOCK_CHARS = 64_000
TEMPER = 0.7
ROWS_IN_BUCKET = 5_000
MOST_SOURCES = 100_000
BLOCKS_AT_ONCE = 1 << 16


def whole_weights(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of each source in a period, by largest remainder; every positive weight gets one at least.

    The period grows to four times the number of sources where that is larger.
    """
    live = {k: float(w) for k, w in weights.items() if w > 0}
    if not live:
        return {}
    period = max(period, 4 * len(live))
    total = sum(live.values())
    share = {k: w / total * period for k, w in live.items()}
    slots = {k: max(1, int(s)) for k, s in share.items()}
    name = lambda k: (k is not None, k or "")
    while (missing := period - sum(slots.values())) != 0:
        sign = 1 if missing > 0 else -1
        ranked = sorted((k for k in live if sign > 0 or slots[k] > 1), key=lambda k: (sign * (slots[k] - share[k]), name(k)))
        for k in ranked[: abs(missing)]:
            slots[k] += sign
    return slots


def schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, number within the period from 1, release, deadline, slot) of one period, earliest deadline first.

    Equal deadlines go to the smaller source name, null before all.  Weights
    are rational and fill the period, so every block is placed in its window.
    """
    period = sum(slots.values())
    name = lambda k: (k is not None, k or "")
    waiting = sorted(((0, name(k), k, 1) for k in slots), key=lambda x: x[:2])
    ready: list = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, tie, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // slots[k]), tie, k, j, release))
        deadline, tie, k, j, release = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        out.append((k, j, release, deadline, slot))
        if j < slots[k]:
            heapq.heappush(waiting, (j * period // slots[k], tie, k, j + 1))
    return out


def exact_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportions of the positive weights."""
    live = {k: Fraction(w) for k, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in live.values()))
    units = {k: int(w * scale) for k, w in live.items()}
    common = math.gcd(*units.values()) or 1
    return {k: u // common for k, u in units.items()}


def walk(units: list[int], blocks: list[int], done: list[int], slot: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the source, block from 1, release, deadline, slot) of the blocks after ``done``, from ``slot`` on.

    Earliest deadline first, equal deadlines by number.  Slots in which no
    source with blocks left has one released stay empty.
    """
    total = sum(units)
    waiting = [(done[k] * total // units[k], k, done[k] + 1) for k in range(len(units)) if done[k] < blocks[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // units[k]), k, j, release))
        deadline, k, j, release = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        yield k, j, release, deadline, slot
        slot += 1
        if j < blocks[k]:
            heapq.heappush(waiting, (j * total // units[k], k, j + 1))


_PLAN = pa.schema([("source", pa.string()), ("block", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())])


def planned(spark: SparkSession, units: Mapping[str | None, int], blocks: Mapping[str | None, int]) -> DataFrame:
    """source, block, release, deadline, slot: the first ``blocks`` of each source, at its exact share of the slots."""
    names = sorted(units, key=lambda k: (k is not None, k or ""))
    of, most = [units[k] for k in names], [blocks[k] for k in names]
    done, states = [0] * len(names), []
    for n, (k, j, _, _, slot) in enumerate(walk(of, most, done, 0)):
        if n % BLOCKS_AT_ONCE == 0:
            states.append((slot, list(done)))
        done[k] = j
    n_states = max(1, len(states))

    def step(batches: Batches) -> Batches:
        for part in batches:
            for row in part.to_pylist():
                found = [x for x, _ in zip(walk(of, most, row["done"], row["at"]), range(BLOCKS_AT_ONCE), strict=False)]
                k, block, release, deadline, slot = zip(*found, strict=True)
                yield emit(_PLAN, source=[names[i] for i in k], block=block, release=release, deadline=deadline, slot=slot)

    states = spark.createDataFrame(states, "at long, done array<long>").repartition(n_states)
    return states.mapInArrow(step, "source string, block long, release long, deadline long, slot long")


def source_sizes(docs: DataFrame, source_column: str, text_column: str) -> DataFrame:
    return docs.groupBy(F.col(f"`{source_column}`").cast("string").alias("source")).agg(
        F.sum(F.coalesce(F.length(f"`{text_column}`"), F.lit(0)).cast("long")).alias("chars"), F.count("*").alias("rows"))


def tempered(sizes: Mapping[str | None, int], power: float = TEMPER) -> dict[str | None, float]:
    """Target weights in proportion to size ** power, which lifts small sources; empty sources weigh as one character."""
    return {k: max(1, n) ** power for k, n in sizes.items()}


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", block_chars: int = BLOCK_CHARS, period: int | None = None, power: float = TEMPER,
) -> DataFrame:
    """doc_id, source, n_chars, block (from 1), release, deadline, slot, place: every row, once.

    A source's documents, in an order shuffled by a hash of the id, are strung
    together and a block begins every ``block_chars`` characters.  The order of
    the mix is (slot, place); ``place`` counts from 1 inside a slot.  Without
    ``weights`` those of :func:`tempered` hold; sources that ``weights`` leaves
    out, or gives nothing, come after all others (their slot counts on from
    there).  A source that has run out leaves its slots to the others, whose
    windows stay.  With ``period`` the weights are first rounded to whole slots of it.  Null texts have no length, a null source is a source, rows
    without an id keep a null id, repeated rows are placed side by side, an
    empty table gives no row.

    The driver sees one line per source (``MOST_SOURCES`` at most, else it
    raises) and the state of the schedule once in ``BLOCKS_AT_ONCE`` blocks.
    """
    sizes_row = source_sizes(docs, source_column, text_column).limit(MOST_SOURCES + 1).collect()
    if len(sizes_row) > MOST_SOURCES:
        raise ValueError("more sources than a schedule is meant for")
    sizes = {r["source"]: r["chars"] for r in sizes_row}
    n_rows = sum(r["rows"] for r in sizes_row)
    targets = tempered(sizes, power) if weights is None else {k: w for k, w in weights.items() if k in sizes}
    chosen = exact_weights(targets) if period is None else whole_weights(targets, period)
    spark = docs.sparkSession
    total = sum(chosen.values())
    blocks = {k: sizes[k] // block_chars + 1 for k in chosen}
    late = sorted((k for k in sizes if k not in chosen), key=lambda k: (k is not None, k or ""))
    buckets = max(1, -(-n_rows // ROWS_IN_BUCKET))

    # characters before each row of its source: whole buckets first, then the rows before it in its bucket
    spread = F.xxhash64(F.lit("mix"), "doc_id", "text")
    rows = docs.select(
        long_id(id_column, "doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        F.col(f"`{text_column}`").cast("string").alias("text")).select(
        "doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), spread.alias("spread"))
    rows = rows.withColumn("bucket", _bucket("spread", buckets))
    of_bucket = rows.groupBy("source", "bucket").agg(F.sum("n_chars").alias("chars"))
    before = of_bucket.select(
        "source", "bucket", F.coalesce(F.sum("chars").over(
            W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("spread", "doc_id", "n_chars")
    rows = rows.withColumn("own", F.coalesce(F.sum("n_chars").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("in_bucket", F.row_number().over(inside))
    rows = rows.alias("r").join(
        before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")),
    ).select("r.*", "b.before")
    rows = rows.withColumn("block", F.expr(f"(before + own) div {block_chars} + 1"))

    rows = rows.alias("r").join(
        planned(spark, chosen, blocks).alias("p"),
        F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.block") == F.col("p.block")), "left",
    ).select("r.*", "p.release", "p.deadline", F.col("p.slot").alias("at"))
    last = max((-(-blocks[k] * total // chosen[k]) for k in chosen), default=0)
    after: dict[str | None, int] = {}
    for k in late:
        after[k] = last
        last += sizes[k] // block_chars + 1
    late_from = F.lit(None).cast("long")
    for k, at in after.items():
        late_from = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(at)).otherwise(late_from)
    slot = F.coalesce("at", late_from + F.col("block") - 1)
    release, deadline = F.coalesce("release", slot), F.coalesce("deadline", slot + 1)
    timed = rows.select(
        "doc_id", "source", "n_chars", "block", release.alias("release"), deadline.alias("deadline"), slot.alias("slot"), "bucket",
        "in_bucket", "spread")
    place = F.row_number().over(W.partitionBy("slot", "source").orderBy("bucket", "in_bucket"))
    return timed.select("doc_id", "source", "n_chars", "block", "release", "deadline", "slot", place.cast("long").alias("place"))


def _bucket(spread: str, buckets: int) -> Column:
    """The signed hash's range in ``buckets`` equal parts, so that buckets keep the hash's order."""
    return F.floor((F.col(spread).cast("double") / 2.0**64 + 0.5) * buckets).cast("long")


def order_of(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """_id, _at (slot and place): the first place of each id in the mix, written to the shared folder."""
    order = mix(docs, id_column=id_column, **options).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("_at"))
    return materialize(order.select(F.col("doc_id").alias("_id"), "_at"), "mix")


def in_mixed_order(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """All rows of ``docs`` with their own columns, range-partitioned and sorted by their place in the mix.

    Rows of a repeated id take the first place of that id.
    """
    order = order_of(docs, id_column, **options)
    placed = docs.join(order, docs[id_column].cast("long").eqNullSafe(order["_id"]))
    return placed.repartitionByRange("_at", "_id").sortWithinPartitions("_at", "_id").select(*[docs[c] for c in docs.columns])
