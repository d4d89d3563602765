"""Content identity: canonical text, record hashes, order-free checksums, stable ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.local import union_all
from wardline.schemas import RECORD_HASH


def canonical_json(columns: Sequence[str]) -> Column:
    """Row as JSON with sorted keys, compact, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def iso_timestamp(column: Column) -> Column:
    """ISO text by the value's own text form, so that no session zone takes part; a fraction has six digits, as Python writes it."""
    text = column.cast("string")
    return F.translate(F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text), " ", "T")


def record_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def stable_identity(prefix: str, content: Column) -> Column:
    """``prefix-`` and the first 20 hex digits of the content's SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(content, 256), 1, 20))


# --- multisets of rows -------------------------------------------------------------------------------------------
# A multiset's hash is the sum of its rows' SHA-256, taken as four words of 64 bits which are each summed modulo 2**64.
# Sums over parts add up, and what has left a set is subtracted again, so no row is ever read twice for it.

WORDS = 4
EMPTY_SUM = "0" * 16 * WORDS


def _word(hash_column: Column, k: int) -> Column:
    return F.conv(F.substring(hash_column, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")


def _joined_words(words: Sequence[Column]) -> Column:
    """Whole numbers (of any sign) modulo 2**64, as 64 hex digits."""
    modulus = F.lit(str(2**64)).cast("decimal(20,0)")
    return F.concat(*[
        F.lower(F.lpad(F.conv(F.pmod(w, modulus).cast("string"), 10, 16), 16, "0")) for w in words])


def multiset_sum(hash_column: Column | str, sign: Column | int = 1) -> Column:
    """Aggregate: the sum of 64-digit hashes (of rows, or of multisets), each added or, with ``sign`` -1, subtracted.

    Pieces of 16 bits are summed as longs, which holds for 2**47 rows and stays
    in primitive aggregation buffers, and put together once at the end.
    """
    column = F.col(hash_column) if isinstance(hash_column, str) else hash_column
    factor = sign if isinstance(sign, Column) else None if sign == 1 else F.lit(sign)

    def total(piece: Column, bits: int) -> Column:
        summed = F.coalesce(F.sum(piece if factor is None else piece * factor), F.lit(0)).cast("decimal(38,0)")
        return (summed * F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("decimal(38,0)")

    words = []
    for k in range(WORDS):
        halves = [F.conv(F.substring(column, 16 * k + at, 8), 16, 10).cast("bigint") for at in (1, 9)]
        pieces = [(F.shiftright(halves[0], 16), 48), (halves[0].bitwiseAND(F.lit(0xFFFF)), 32),
                  (F.shiftright(halves[1], 16), 16), (halves[1].bitwiseAND(F.lit(0xFFFF)), 0)]
        words.append(reduce(Column.__add__, [total(*p) for p in pieces]).cast("decimal(38,0)"))
    return _joined_words(words)


def multiset_add(left: Column, right: Column) -> Column:
    return _joined_words([_word(left, k) + _word(right, k) for k in range(WORDS)])


def multiset_subtract(left: Column, right: Column) -> Column:
    return _joined_words([_word(left, k) - _word(right, k) for k in range(WORDS)])


def added_sums(left: str, right: str) -> str:
    """``multiset_add`` of two known sums."""
    return "".join(f"{(int(left[k : k + 16], 16) + int(right[k : k + 16], 16)) % 2**64:016x}" for k in range(0, 16 * WORDS, 16))


def checksum_columns(hash_column: str = RECORD_HASH) -> list[Column]:
    """Aggregates that depend on the multiset of rows, not on their order or partitioning: row_count and hash_sum."""
    return [F.count("*").alias("row_count"), multiset_sum(hash_column).alias("hash_sum")]


def stored_sum(hash_column: Column | str = RECORD_HASH) -> Column:
    """Aggregate: as ``multiset_sum``, but of four hashes of 64 bits that are taken of each 64-digit hash with seeds of their own.

    It names the same multisets without reading hex digits as numbers, which is
    ten times as dear as all else in a pass over stored hashes.  Sums add up
    and are put together like the others, but compare only with each other.
    Pieces of 21 and 22 bits hold for 2**41 rows.
    """
    words = []
    for k in range(WORDS):
        word = F.xxhash64(F.lit(k), hash_column)  # the seed first, so that no word follows from another
        pieces = [(F.shiftright(word, 42), 42), (F.shiftright(word, 21).bitwiseAND(F.lit(0x1FFFFF)), 21), (word.bitwiseAND(F.lit(0x1FFFFF)), 0)]
        words.append(reduce(Column.__add__, [
            (F.coalesce(F.sum(piece), F.lit(0)).cast("decimal(38,0)") * F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("decimal(38,0)")
            for piece, bits in pieces]).cast("decimal(38,0)"))
    return _joined_words(words)


def stored_checksum(hash_column: Column | str = RECORD_HASH) -> list[Column]:
    """``checksum_columns`` for objects of a lake: row_count and the ``stored_sum`` as hash_sum."""
    return [F.count("*").alias("row_count"), stored_sum(hash_column).alias("hash_sum")]


def content_checksum(df: DataFrame, hash_column: str = RECORD_HASH) -> DataFrame:
    """One row: row_count and hash_sum (all 256 bits, as 64 hex digits) of the stored record hashes."""
    return df.agg(*checksum_columns(hash_column))


def merged_checksums(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Checksums of unions: row_count and hash_sum of parts that hold no row twice, added up for each ``by``."""
    return parts.groupBy(*by).agg(F.sum("row_count").alias("row_count"), multiset_sum("hash_sum").alias("hash_sum"))


def number_text(column: Column) -> Column:
    """A double as exact text that any engine can write alike: whole part and two pieces of 53 bits of the fraction.

    Engines print doubles in forms of their own.  The pieces are exact for all
    of 2**-54 and more (zeros of both signs are one); from 2**63 on, where no
    whole part fits, and for values that are no numbers, Spark's form is used.
    """
    whole = F.floor(column)
    fraction = column - whole.cast("double")
    high = F.floor(fraction * 2.0**53)
    low = F.floor((fraction * 2.0**53 - high.cast("double")) * 2.0**53)
    pieces = F.concat_ws("+", whole.cast("string"), high.cast("string"), low.cast("string"))
    return F.when(F.abs(column) < 2.0**63, pieces).otherwise(column.cast("string"))


def logical_line(df: DataFrame, entity: str) -> Column:
    """A row's text for hashes that engines share: the entity, then the fields as sorted JSON with doubles as ``number_text``."""
    fields = [number_text(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes)]
    return F.concat(F.lit(f"{entity}:"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def hashed(df: DataFrame, columns: Sequence[str] | None = None, out: str = RECORD_HASH) -> DataFrame:
    return df.withColumn(out, record_hash(columns or df.columns))


def dataset_logical_hash(tables: Mapping[str, DataFrame], entities: Sequence[str] | None = None) -> DataFrame:
    """One checksum over all entities; a row's hash also covers the entity's name."""
    return merged_checksums(entity_hashes(tables, entities))


def entity_hashes(tables: Mapping[str, DataFrame], entities: Sequence[str] | None = None) -> DataFrame:
    """(entity, row_count, hash_sum) of each entity; they add up to the dataset's."""
    parts = []
    for entity in entities or list(tables):
        frame = tables[entity]
        hashes = frame.select(F.sha2(logical_line(frame, entity), 256).alias(RECORD_HASH))
        parts.append(hashes.agg(*checksum_columns()).select(F.lit(entity).alias("entity"), "row_count", "hash_sum"))
    return union_all(parts)


# Logical fields that identify a dataset manifest; timestamps and load events do not take part.
MANIFEST_FIELDS = (
    "dataset_id", "generator_version", "schema_version", "fixture_profile", "random_seed", "generation_parameters",
    "entity_row_counts", "stable_summaries", "source_type", "clinical_use_disclaimer", "manifest_schema_version",
)
# Fields that identify a materialised snapshot; the load time does not take part.
SNAPSHOT_FIELDS = (
    "dataset_id", "manifest_id", "backend_name", "schema_version", "loader_name", "loader_version",
    "storage_identity", "materialization_parameters", "snapshot_schema_version",
)


def manifest_identity(manifests: DataFrame) -> DataFrame:
    return _identified(manifests, "manifest", "manifest_id", MANIFEST_FIELDS)


def snapshot_identity(snapshots: DataFrame) -> DataFrame:
    return _identified(snapshots, "snapshot", "snapshot_id", SNAPSHOT_FIELDS)


def _identified(df: DataFrame, prefix: str, out: str, fields: Sequence[str]) -> DataFrame:
    present = [f for f in fields if f in df.columns]
    return df.withColumn(out, stable_identity(prefix, canonical_json(present)))
