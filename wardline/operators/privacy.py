"""Small-cell suppression, result plausibility checks and result shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.identity import iso_timestamp

# Columns that count observations, the default smallest visible cell, the row bound.
COUNT_COLUMNS = ("n", "count", "denominator", "eligible_encounters", "encounter_count")
CELL_THRESHOLD = 10
ROW_BOUND = 1000


def _numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def suppress_small_cells(df: DataFrame, threshold: int = CELL_THRESHOLD) -> DataFrame:
    """Null the numbers of rows that rest on fewer than ``threshold`` observations.

    The count of a row is its first non-null numeric count column.  A boolean
    ``suppressed`` column is always added.
    """
    counts = [f.name for f in df.schema if f.name.lower() in COUNT_COLUMNS and isinstance(f.dataType, T.NumericType)]
    if not counts:
        return df.withColumn("suppressed", F.lit(False))
    n = F.coalesce(*[F.col(c).cast("double") for c in counts])
    small = F.coalesce((n > 0) & (n < threshold), F.lit(False))
    hidden = [f.name for f in df.schema if _numeric(f) and f.name.lower() not in COUNT_COLUMNS]
    return df.select(
        *[F.when(~small, F.col(c)).alias(c) if c in hidden else F.col(c) for c in df.columns],
        small.alias("suppressed"),
    )


def suppression_summary(df: DataFrame, threshold: int = CELL_THRESHOLD) -> DataFrame:
    """Number of suppressed groups and the warning to show (null when there is none)."""
    counted = df.agg(F.count_if("suppressed").alias("suppressed_groups"))
    text = F.format_string(f"Suppressed %d group(s) with fewer than {threshold} observations.", "suppressed_groups")
    return counted.withColumn("warning", F.when(F.col("suppressed_groups") > 0, text))


def _present(df: DataFrame, *names: str) -> Column | None:
    by_lower = {c.lower(): c for c in df.columns}
    return next((F.col(by_lower[n]) for n in names if n in by_lower), None)


def validate_results(df: DataFrame, label: Sequence[str]) -> DataFrame:
    """Implausible values as (row_label, message); one line with a null label for an empty result."""
    numerator, denominator = _present(df, "numerator", "readmissions"), _present(df, "denominator", "eligible_encounters")
    rules: list[tuple[Column, str]] = []
    if denominator is not None:
        rules.append((denominator <= 0, "nonpositive denominator"))
        if numerator is not None:
            rules.append((~numerator.between(0, denominator), "numerator outside [0, denominator]"))
    for field in df.schema:
        name = field.name.lower()
        if not isinstance(field.dataType, T.NumericType):
            continue
        if "rate" in name:
            rules.append((~F.col(field.name).between(0, 1), f"invalid rate {name}"))
        if name.endswith("count") or name in ("n", "count"):
            rules.append((F.col(field.name) < 0, "negative count"))
    messages = F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(c, F.lit(m)) for c, m in rules])))
    found = df.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in label]).alias("row_label"),
        F.explode(messages).alias("message"),
    )
    empty = df.limit(1).agg(F.count("*").alias("_n")).filter(F.col("_n") == 0).select(
        F.lit(None).cast("string").alias("row_label"), F.lit("Query returned no rows.").alias("message"))
    return found.unionByName(empty)


def distinct_messages(messages: Column) -> Column:
    """Warnings without repeats, first occurrence kept in place."""
    return F.array_distinct(messages)


def bounded_result(df: DataFrame, order: Sequence[Column | str], max_rows: int = ROW_BOUND) -> DataFrame:
    """At most ``max_rows`` rows in ``order`` and a ``truncated`` flag; never handles more than one row beyond."""
    taken = df.orderBy(*order).limit(max_rows + 1)
    everything = W.partitionBy(F.lit(0))
    return (
        taken.withColumn("truncated", F.count("*").over(everything) > max_rows)
        .orderBy(*order).limit(max_rows)
    )


def collect_bounded(df: DataFrame, max_rows: int = ROW_BOUND) -> tuple[list, bool]:
    """Driver-side rows and the truncation flag."""
    rows = df.take(max_rows + 1)
    return rows[:max_rows], len(rows) > max_rows


def normalize_result(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps as ISO text; nested values included by cast."""
    return df.select(*[_normalized(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def _normalized(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return column.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _normalized(item, kind.elementType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_normalized(column[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(column.isNotNull(), inner)
    return column


def count_label_pick(df: DataFrame) -> DataFrame:
    """Headline figure: the single ``*_count`` column as (label, value)."""
    names = [f.name for f in df.schema if f.name.lower().endswith("_count") and isinstance(f.dataType, T.NumericType)]
    if len(names) != 1:
        raise ValueError(f"Expected one *_count column, found {names}")
    label = names[0].removesuffix("_count").replace("_", " ")
    return df.select(F.lit(label).alias("label"), F.col(names[0]).cast("bigint").alias("value"))
