"""Shared working folder, versioned Parquet objects, serving tables, catalog and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions.local import local_table

CHECKPOINT_SETTING = "spark.checkpoint.dir"
ROWS_IN_BUCKET = 1_000_000
CODEC = "zstd"  # hashes as hex digits take half the room they do under codecs without entropy coding
OBJECT_OPTIONS = {"compression": CODEC, "parquet.compression.codec.zstd.level": "1"}  # hashes take no less room at a higher level


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, a local one only under a local master."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder shared by all executors.")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_SETTING, named)
    return named.rstrip("/")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new folder path of its own under the shared root."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def materialize(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, purpose)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_entity(spark: SparkSession, path: str, entity: str, typed: bool = False, physical: bool = True) -> DataFrame:
    """Declared-schema Parquet scan of one entity."""
    schema = schemas.lake_schema(entity, typed) if physical else schemas.entity_schema(entity, typed)
    return spark.read.schema(schema).parquet(path)


def write_version(
    df: DataFrame, root: str, layer: str, entity: str, sort_key: Sequence[str] = (), cluster_by: Sequence[str] = (),
) -> str:
    """Write a new immutable object version and return its path.

    ``cluster_by`` spreads the rows over files by value range, so that a scan
    with a filter on the leading column skips most files by their statistics;
    further columns split a value that many rows share.  Otherwise rows keep the
    partitioning the plan ends with, and ``sort_key`` orders each file.
    """
    path = f"{root}/objects/{layer}/{entity}/{uuid.uuid4().hex}"
    if cluster_by:
        df, sort_key = with_hex_hash(with_binary_hash(df).repartitionByRange(*cluster_by)), cluster_by
    out = df.sortWithinPartitions(*sort_key) if sort_key else df
    out.write.mode("errorifexists").options(**OBJECT_OPTIONS).parquet(path)
    return path


def with_binary_hash(df: DataFrame) -> DataFrame:
    """The record hash as 32 bytes: what a row should carry through a shuffle."""
    return df.withColumn(schemas.RECORD_HASH, F.unhex(schemas.RECORD_HASH)) if schemas.RECORD_HASH in df.columns else df


def with_hex_hash(df: DataFrame) -> DataFrame:
    return df.withColumn(schemas.RECORD_HASH, F.lower(F.hex(schemas.RECORD_HASH))) if schemas.RECORD_HASH in df.columns else df


def without_keys(df: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``held`` lacks.

    Only keys meet in the large join; those that both sides have are written
    first, so Spark knows their size and sends few of them to the rows.
    """
    common = materialize(held.select(*keys).join(df.select(*keys), list(keys), "left_semi"), "known")
    return df.join(common, list(keys), "left_anti")


def object_inventory(spark: SparkSession, path: str, entity_depth: int = 2) -> DataFrame:
    """Rows and bytes per entity below ``path``; the entity is a folder name counted from the file upward.

    Rows are counted from the scan of no column at all, so only footers are read.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    per_file = rows.groupBy("file").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
    return per_file.groupBy(
        F.element_at(F.split("file", "/"), -1 - entity_depth).alias("entity")
    ).agg(F.count("*").alias("files"), F.sum("rows").alias("row_count"), F.sum("bytes").alias("size_bytes"))


def bucket_count(rows: int, least: int = 8) -> int:
    """Buckets of a bounded number of rows, so that tables grow by tasks and not by the size of a task."""
    return max(least, -(-rows // ROWS_IN_BUCKET))


def write_serving_tables(
    tables: Mapping[str, DataFrame], database: str, root: str, buckets: int = 0, written: dict[str, int] | None = None,
) -> list[str]:
    """Save the entities as catalog tables, parents first.

    With ``buckets`` the encounter facts are bucketed and sorted by encounter,
    so joins between them need no shuffle.  ``written`` takes the rows that each
    table's writer was handed, counted on the way, so that an entity which is
    dear to compute is not computed again for its count.
    """
    by_encounter = {
        "encounters": "encounter_id", "encounter_diagnoses": "encounter_id", "encounter_procedures": "encounter_id",
        "lab_results": "encounter_id", "readmissions": "index_encounter_id",
    }
    saved = []
    for entity in schemas.LOAD_ORDER:
        if entity not in tables:
            continue
        frame = tables[entity]
        key = by_encounter.get(entity) if buckets else None
        frame = frame.repartition(buckets, key) if key else frame
        seen = Observation()  # after the shuffle: a task that is run again there counts once
        frame = frame.observe(seen, F.count("*").alias("rows")) if written is not None else frame
        writer = frame.write.format("parquet").mode("errorifexists").option("path", f"{root}/serving/{entity}")
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{entity}")
        if written is not None:
            written[entity] = seen.get["rows"]
        saved.append(entity)
    return saved


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Incoming rows whose key is not in ``target``, one per key (the first by ``order``).

    Repeats are cut before the lookup, so a key that arrives very often is one row in it.
    """
    from wardline.operators.layers import first_per_key

    once = first_per_key(incoming, keys, order or [c for c in incoming.columns if c not in keys])
    return once.join(target.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def incremental_batch(parent: DataFrame, incoming: DataFrame, keys: Sequence[str], parent_batch: str, batch: str) -> DataFrame:
    """New rows of an incremental batch, one per key, tagged with their batch and its parent."""
    fresh = insert_ignore(parent, incoming, keys)
    return fresh.select(
        *incoming.columns, F.lit(batch).alias("batch_id"), F.lit(parent_batch).alias("parent_batch_id"),
        F.lit("incremental").alias("batch_kind"))


def surrogate_key(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Dense numbers in ascending ``order``; rows that are equal in it are numbered in no particular order.

    Rows are written by ranges of (order, place), so that even a value that all
    rows share is dealt over many tasks.  A row's number is its place in its
    file after the rows of the files before; only the files' row counts meet in
    one task, and they are what is joined back (a line for each file).
    """
    from pyspark.sql import Window as W

    names = [c for c in df.columns if c != out]
    placed = df.select(*names, F.monotonically_increasing_id().alias("_place"))
    stored = materialize(placed.repartitionByRange(*order, "_place").sortWithinPartitions(*order, "_place").drop("_place"), "numbered")
    rows = stored.select(*names, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_file", before.alias("_offset"))
    return rows.join(F.broadcast(offsets), "_file").select(*names, (F.col("_offset") + F.col("_row") + start).alias(out))


def catalog_listing(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(relation, kind, position, column, data_type, nullable, primary_key) of all tables and views."""
    rows = []
    for table in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        name = table.name
        qualified = f"{database}.{name}" if database and not table.isTemporary else name
        keys = schemas.ENTITY_KEYS.get(name, ())
        declared = {n: nullable for n, _, nullable in schemas.ENTITY_FIELDS.get(name, ())}
        for position, field in enumerate(spark.table(qualified).schema):
            rows.append((
                name, "view" if table.tableType in ("TEMPORARY", "VIEW") else "table", position, field.name,
                field.dataType.simpleString(), declared.get(field.name, field.nullable), field.name in keys))
    return local_table(
        spark, rows,
        "relation STRING, kind STRING, position INT, column_name STRING, data_type STRING, nullable BOOLEAN, "
        "primary_key BOOLEAN")


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON; reports are small, so one file."""
    df.coalesce(1).write.mode("errorifexists").json(path)
