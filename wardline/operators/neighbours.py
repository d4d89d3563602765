"""Lead and lag inside groups, some of which may hold a large share of all rows.

A plain window puts a whole group into one task.  Here groups of very many rows
are found by a count, combined before the shuffle, and only they are cut into
order-preserving buckets: neighbours are looked up inside each bucket, and the
rows at the ends of a bucket ask for an end of the bucket next to it.  The
bucket ends are linked the same way, one bucket column coarser.  All other
groups go through one window, in the same shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def id_block(column: str, bits: int = 16) -> Column:
    """Order-preserving block of a unique integer id: a block holds at most ``2**bits`` rows."""
    return F.shiftright(F.col(column), bits)


def _window_neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[str], payload: Sequence[str], following: str,
    preceding: str | None,
) -> DataFrame:
    window = W.partitionBy(*group).orderBy(*order)
    item = F.struct(*payload)
    out = df.withColumn(following, F.lead(item).over(window))
    return out.withColumn(preceding, F.lag(item).over(window)) if preceding else out


HOT_ROWS = 1 << 22  # rows of a group that one task still takes


def hot_groups(df: DataFrame, group: Sequence[str], rows: int = HOT_ROWS) -> list[tuple]:
    """Groups of more than ``rows`` rows: a job of its own, whose result has at most one group for each ``rows`` of the table."""
    return [tuple(r) for r in df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*group).collect()]


def _among(group: Sequence[str], values: Sequence[tuple]) -> Column:
    if len(group) == 1:
        column, plain = F.col(group[0]), [v[0] for v in values if v[0] is not None]
        found = F.coalesce(column.isin(plain), F.lit(False)) if plain else F.lit(False)
        return found | column.isNull() if len(plain) < len(values) else found
    return reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).eqNullSafe(x) for c, x in zip(group, v, strict=True)]) for v in values])


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    following: str = "_next",
    preceding: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add struct ``following`` (and ``preceding``) with the ``payload`` of the row after (before) in the group.

    ``buckets`` are columns of ``df``, coarse to fine, that never decrease along
    ``order``.  Nulls in group and bucket columns are values of their own; in an
    ascending order they come first.  Groups of more than ``hot_rows`` rows are
    looked for while the plan is built, and cut.
    """
    hot = hot_groups(df, group, hot_rows)
    if not hot:
        return _window_neighbours(df, group, order, payload, following, preceding)
    is_hot = _among(group, hot)
    marked = df.withColumn("_hot", is_hot)
    cell = [f"_cell_{c}" for c in buckets]
    cut = marked.withColumns({c: F.when(F.col("_hot"), F.col(b)) for c, b in zip(cell, buckets, strict=True)})
    found = _linked(cut, [*group, "_hot"], cell, order, payload, following, preceding, F.col("_hot"))
    return found.select(*df.columns, following, *([preceding] if preceding else []))


def _linked(
    df: DataFrame, group: Sequence[str], buckets: Sequence[str], order: Sequence[str], payload: Sequence[str], following: str,
    preceding: str | None, only: Column | None = None,
) -> DataFrame:
    """Neighbours by buckets; ``only`` says which rows are in more than one bucket at all."""
    cell = [*group, *buckets]
    inside = _window_neighbours(df, cell, order, payload, following, preceding)
    if not buckets:
        return inside

    # Only what varies inside a cell is compared; a single number keeps the aggregate hash-based.
    varying = [c for c in dict.fromkeys([*order, *payload]) if c not in cell]
    compared = F.struct(*varying) if len(varying) > 1 else F.col(varying[0])

    def end(extreme: Callable[[Column], Column], name: str) -> Column:
        return extreme(compared).alias(name)

    def rebuilt(name: str) -> Column:
        part = {c: (F.col(f"{name}.{c}") if len(varying) > 1 else F.col(name)) for c in varying}
        return F.struct(*[part.get(c, F.col(c)).alias(c) for c in payload]).alias(name)

    cut = df.where(only) if only is not None else df
    ends = cut.groupBy(*cell).agg(end(F.min, "_first"), *([end(F.max, "_last")] if preceding else [])).select(
        *cell, rebuilt("_first"), *([rebuilt("_last")] if preceding else []))
    linked = _linked(
        ends, group, buckets[:-1], buckets, ["_first", "_last"] if preceding else ["_first"],
        "_after", "_before" if preceding else None)

    def picked(link: str, name: str) -> Column:
        return F.when(F.col(link).isNotNull(), F.col(f"{link}.{name}"))

    linked = linked.select(
        *[F.col(c).alias(f"_of_{c}") for c in cell],
        picked("_after", "_first").alias("_next_end"),
        *([picked("_before", "_last").alias("_previous_end")] if preceding else []))
    # ``inside`` is already hashed by the bucket columns, so only the ends move.
    joined = inside.join(linked, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell], "left")
    return joined.select(
        *df.columns,
        F.coalesce(F.col(following), F.col("_next_end")).alias(following),
        *([F.coalesce(F.col(preceding), F.col("_previous_end")).alias(preceding)] if preceding else []))
