"""Row transforms of the raw, bronze, silver and gold layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions.identity import iso_timestamp, record_hash
from wardline.operators.quality import ISO_DATE, ISO_TIMESTAMP

NULL_KEY = "null_key"
DUPLICATE_KEY = "duplicate_key"


def lake_row_metadata(
    df: DataFrame, batch_id: str | None, columns: Sequence[str] | None = None, source_file: Column | None = None,
    row_order: Column | None = None, flags: Column | None = None, known_hash: Column | None = None,
) -> DataFrame:
    """``columns`` (default: all) with source file, row order, batch id, record hash, quality flags, no rejection.

    ``known_hash`` is the row's hash where its canonical text was hashed already, else null.
    """
    names = list(columns or df.columns)
    return df.select(
        *names,
        (F.lit(None).cast("string") if source_file is None else source_file).alias(schemas.SOURCE_FILE),
        (F.monotonically_increasing_id() if row_order is None else row_order).alias(schemas.ROW_ORDER),
        F.lit(batch_id).cast("string").alias(schemas.BATCH_ID),
        (record_hash(names) if known_hash is None else F.coalesce(known_hash, record_hash(names))).alias(schemas.RECORD_HASH),
        (F.array().cast("array<string>") if flags is None else flags).alias(schemas.QUALITY_FLAGS),
        F.lit(None).cast("string").alias(schemas.REJECTION_REASON),
    )


def _has_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(k).isNull() for k in keys])


def null_key_filter(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(~_has_null(keys))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by ``order``.

    ``row_number() = 1`` is also limited before the shuffle, so each task sends
    at most one row per key: a key held by a third of the rows does no harm.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", first).filter(F.col("_place") == 1).drop("_place")


def silver_dedup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = (schemas.SOURCE_FILE, schemas.ROW_ORDER),
) -> DataFrame:
    """Rows with a whole key, the first of each key in line order."""
    return first_per_key(null_key_filter(df, keys), keys, order)


def stored_firsts(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``silver_dedup`` of a stored object, and the rows it leaves out with their reason.

    Rows go through no shuffle: keys alone are counted, and only the rows of
    repeated keys, which are written first so that their size is known, are put
    in line order.
    """
    from wardline.sources.storage import materialize

    whole = null_key_filter(df, keys)
    repeated = materialize(
        whole.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "repeated")
    in_order = F.row_number().over(W.partitionBy(*keys).orderBy(schemas.SOURCE_FILE, schemas.ROW_ORDER))
    ranked = whole.join(repeated, list(keys), "left_semi").withColumn("_place", in_order)
    single = whole if repeated.isEmpty() else whole.join(repeated, list(keys), "left_anti").unionByName(
        first_per_key(whole.join(repeated, list(keys), "left_semi"), keys, [schemas.SOURCE_FILE, schemas.ROW_ORDER]))
    left_out = ranked.where("_place > 1").drop("_place").withColumn(schemas.REJECTION_REASON, F.lit(DUPLICATE_KEY)).unionByName(
        df.where(_has_null(keys)).withColumn(schemas.REJECTION_REASON, F.lit(NULL_KEY)))
    return single, left_out


def rejected_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(reason, rejected) for null and repeated keys, from one aggregate by key."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    counted = per_key.agg(
        F.coalesce(F.sum(F.when(_has_null(keys), F.col("_rows"))), F.lit(0)).alias("_nulls"),
        F.coalesce(F.sum(F.when(~_has_null(keys), F.col("_rows") - 1)), F.lit(0)).alias("_repeats"))
    return counted.select(F.inline(F.array(
        F.struct(F.lit(NULL_KEY).alias("reason"), F.col("_nulls").alias("rejected")),
        F.struct(F.lit(DUPLICATE_KEY).alias("reason"), F.col("_repeats").alias("rejected")))))


def tag_rejections(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fill the rejection reason of every row that silver leaves out.

    The winners are found per key with map-side limiting; rows then meet the
    winners on their own unique ``row_id``, never on the possibly hot key.
    """
    winners = silver_dedup(df, keys, order).select(*row_id, F.lit(True).alias("_kept"))
    reason = F.when(_has_null(keys), NULL_KEY).when(F.col("_kept").isNull(), DUPLICATE_KEY)
    return df.join(winners, list(row_id), "left").select(
        *[c for c in df.columns if c != schemas.REJECTION_REASON], reason.alias(schemas.REJECTION_REASON))


def quarantine(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with their reason)."""
    reason = F.col(schemas.REJECTION_REASON)
    return tagged.filter(reason.isNull()), tagged.filter(reason.isNotNull())


def to_iso_date(column: Column) -> Column:
    return F.when(column.rlike(ISO_DATE), column.try_cast("date"))


def to_iso_timestamp(column: Column) -> Column:
    """Zone-free UTC timestamp; a zone suffix is converted, none means UTC."""
    zoned = column.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    moment = column.try_cast("timestamp")  # an instant; its microseconds since 1970 name no local time, so no hour is told twice
    in_utc = F.timestamp_add("MICROSECOND", F.unix_micros(moment), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.when(column.rlike(ISO_TIMESTAMP), F.when(zoned, in_utc).otherwise(column.try_cast("timestamp_ntz")))


def silver_typing(df: DataFrame) -> DataFrame:
    """ISO text columns as dates and timestamps.

    Text of another form becomes null; where the frame carries quality flags,
    such a value is flagged ``date:<column>``.
    """
    casts: dict[str, Column] = {}
    for name, kind in df.dtypes:
        if kind == "string" and schemas.is_timestamp_column(name):
            casts[name] = to_iso_timestamp(F.col(name))
        elif kind == "string" and schemas.is_date_column(name):
            casts[name] = to_iso_date(F.col(name))
    lost = [F.when(F.col(name).isNotNull() & cast.isNull(), f"date:{name}") for name, cast in casts.items()]

    def out(name: str) -> Column:
        if name == schemas.QUALITY_FLAGS and lost:
            return F.concat(F.col(name), F.array_compact(F.array(*lost))).alias(name)
        return casts[name].alias(name) if name in casts else F.col(name)

    return df.select(*[out(name) for name in df.columns])


def as_iso_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps back to the text form of the raw and bronze layers."""
    def text(name: str, kind: str) -> Column:
        if kind == "date":
            return F.col(name).cast("string").alias(name)
        if kind.startswith("timestamp"):
            return iso_timestamp(F.col(name)).alias(name)
        return F.col(name)

    return df.select(*[text(name, kind) for name, kind in df.dtypes])


def transition_allowed(source: Column, target: Column) -> Column:
    """Column form of ``schemas.layer_transition``: is ``target`` the layer right after ``source``?"""
    order = F.array(*[F.lit(layer) for layer in schemas.LAYERS])
    place_of_source, place_of_target = F.array_position(order, source), F.array_position(order, target)
    return F.coalesce((place_of_source > 0) & (place_of_target - place_of_source == 1), F.lit(False))


def gold_transform(silver: DataFrame) -> DataFrame:
    """Gold keeps the silver rows unchanged; its gate looks at them again."""
    return silver
