"""Snapshots stored by key buckets with a tree of hashes, and differences found from the trees.

A row belongs to the bucket of its key.  A leaf of the tree holds the rows and
the multiset hash of one bucket, a node those of sixteen nodes below it, so two
snapshots are compared from the roots down and only buckets whose leaves differ
are ever read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.identity import checksum_columns, logical_line, merged_checksums
from wardline.functions.local import local_table, union_all
from wardline.sources import storage

ROWS_IN_BUCKET = 1 << 20
MOST_BUCKETS = 1 << 16
FAN_OUT = 16
BUCKET, HASH = "_bucket", "_hash"
NODES = "level INT, node INT, row_count BIGINT, hash_sum STRING"


def bucket_of(keys: Sequence[str | Column], buckets: int) -> Column:
    """Bucket of a key, the same for every table whose key columns have the same types."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def buckets_for(rows: int, rows_in_bucket: int = ROWS_IN_BUCKET) -> int:
    return min(MOST_BUCKETS, 1 << max(0, -(-rows // rows_in_bucket) - 1).bit_length())


def layout(tables: Mapping[str, DataFrame], rows_in_bucket: int = ROWS_IN_BUCKET) -> dict[str, int]:
    """Number of buckets of each entity: a power of two, from its rows today; it then stays as it is."""
    counts = union_all([f.agg(F.count("*").alias("n")).withColumn("entity", F.lit(e)) for e, f in tables.items()]).collect()
    return {r["entity"]: buckets_for(r["n"], rows_in_bucket) for r in counts}


def depth(buckets: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while buckets > 1:
        buckets, levels = -(-buckets // FAN_OUT), levels + 1
    return levels


def leaves(rows: DataFrame, by: Sequence[str] = (), checksum: Sequence[Column] = ()) -> DataFrame:
    """(by, node, row_count, hash_sum) of each bucket that has rows; ``checksum``: both as aggregates, if not those of ``HASH``."""
    return rows.groupBy(*by, F.col(BUCKET).alias("node")).agg(*(checksum or checksum_columns(HASH)))


def grown(bottom: DataFrame, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """All levels (0: the leaves; the last: the root), each added up from the one below."""
    level, levels = bottom.select(*by, "node", "row_count", "hash_sum"), []
    for n in range(depth(buckets) + 1):
        if n:
            above = level.withColumn("node", F.floor(F.col("node") / FAN_OUT).cast("int"))
            level = merged_checksums(above, [*by, "node"])
        levels.append(level.select(*by, F.lit(n).alias("level"), "node", "row_count", "hash_sum"))
    return union_all(levels)


def differing(left: DataFrame, right: DataFrame, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, node) of the leaves that differ, met by descending below differing nodes only; a missing node is empty."""
    suspects = None
    for n in range(depth(buckets), -1, -1):
        one, other = (
            tree.where(F.col("level") == n).select(*by, "node", F.struct("row_count", "hash_sum").alias(name))
            for tree, name in ((left, "_left"), (right, "_right")))
        if suspects is not None:
            one, other = (
                df.withColumn("_above", F.floor(F.col("node") / FAN_OUT).cast("int")).join(
                    suspects.withColumnRenamed("node", "_above"), [*by, "_above"], "left_semi").drop("_above")
                for df in (one, other))
        both = one.join(other, [*by, "node"], "full")
        suspects = both.where(~F.col("_left").eqNullSafe(F.col("_right"))).select(*by, "node")
    return suspects


def key_changes(left: DataFrame, right: DataFrame, keys: Sequence[str], hash_column: str = HASH) -> DataFrame:
    """(keys, only_left, only_right, change) of every key whose rows differ; change: inserted, deleted or changed.

    Rows are signed and added up by key and hash, so equal ones cancel on the
    map side and no join is needed, however often a key repeats.
    """
    digest = F.unhex(hash_column).alias(hash_column)
    signed = left.select(*keys, digest, F.lit(-1).alias("_sign")).unionAll(right.select(*keys, digest, F.lit(1)))
    net = signed.groupBy(*keys, hash_column).agg(F.sum("_sign").alias("_net"))
    found = net.where("_net <> 0").groupBy(*keys).agg(
        F.sum(F.greatest(-F.col("_net"), F.lit(0))).alias("only_left"), F.sum(F.greatest("_net", F.lit(0))).alias("only_right"))
    change = F.when(F.col("only_left") == 0, "inserted").when(F.col("only_right") == 0, "deleted").otherwise("changed")
    return found.withColumn("change", change)


@dataclass(frozen=True)
class KeyedSnapshot:
    """Entities below ``root``, each in folders by bucket, and their tree.

    Every entity has its own number of buckets; all trees have the same depth.
    """

    spark: SparkSession
    root: str
    buckets: Mapping[str, int]
    keys: Mapping[str, tuple[str, ...]]
    schemas: Mapping[str, str]  # entity -> schema as JSON, without the working columns

    @property
    def tree(self) -> DataFrame:
        return self.spark.read.schema(f"entity STRING, {NODES}").parquet(f"{self.root}/tree")

    def rows(self, entity: str, nodes: Sequence[int] | None = None) -> DataFrame:
        """Rows with bucket and hash, of the given buckets only (their folders are the only ones listed and read)."""
        schema = T.StructType.fromJson(json.loads(self.schemas[entity])).add(HASH, T.StringType()).add(BUCKET, T.IntegerType())
        found = self.spark.read.schema(schema).parquet(f"{self.root}/{entity}")
        return found if nodes is None else found.where(F.col(BUCKET).isin(list(nodes)))


def write_keyed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int, row_hash: Column | None = None) -> None:
    """Rows below ``path`` in a folder for each bucket of the key, sorted by key; with ``row_hash`` taken where they are written."""
    write_buckets(rows.withColumn(BUCKET, bucket_of(keys, buckets)), path, keys, row_hash)


def write_buckets(placed: DataFrame, path: str, keys: Sequence[str], row_hash: Column | None = None) -> None:
    """Rows that know their bucket, each in its bucket's folder and sorted by key."""
    met = storage.with_binary_hash(placed).repartition(BUCKET).sortWithinPartitions(BUCKET, *keys)
    done = storage.with_hex_hash(met) if row_hash is None else met.withColumn(HASH, row_hash)
    done.write.partitionBy(BUCKET).mode("errorifexists").options(**storage.OBJECT_OPTIONS).parquet(path)


def write_snapshot(
    tables: Mapping[str, DataFrame], root: str, keys: Mapping[str, tuple[str, ...]], buckets: Mapping[str, int], parallel: int = 4,
) -> KeyedSnapshot:
    """Store entities by key buckets (numbers as by ``layout``); a few at a time.  The tree is read from the stored hashes alone."""
    kinds = {e: f.schema.json() for e, f in tables.items()}
    spark = next(iter(tables.values())).sparkSession

    def one(entity: str) -> None:
        frame = tables[entity]
        write_keyed(frame, f"{root}/{entity}", keys[entity], buckets[entity], F.sha2(logical_line(frame, entity), 256))

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(one, tables))
    done = KeyedSnapshot(spark, root, dict(buckets), {e: keys[e] for e in tables}, kinds)
    bottom = union_all([leaves(done.rows(e).select(BUCKET, HASH)).withColumn("entity", F.lit(e)) for e in tables])
    grown(bottom, max(buckets.values()), ["entity"]).repartition(1).write.partitionBy("level").parquet(f"{root}/tree")
    return done


def changed_buckets(left: KeyedSnapshot, right: KeyedSnapshot) -> dict[str, list[int]]:
    """Entity -> buckets that differ: as many numbers as it has buckets at most."""
    if left.buckets != right.buckets:
        raise ValueError("snapshots of different numbers of buckets")
    most = max(left.buckets.values())
    found: dict[str, list[int]] = {}
    for row in differing(left.tree, right.tree, most, ["entity"]).collect():
        found.setdefault(row["entity"], []).append(row["node"])
    return found


def changes(left: KeyedSnapshot, right: KeyedSnapshot, entity: str, nodes: Sequence[int] | None = None) -> DataFrame:
    """``key_changes`` of one entity, from the buckets that differ."""
    nodes = changed_buckets(left, right).get(entity, []) if nodes is None else nodes

    def side(snapshot: KeyedSnapshot, other: KeyedSnapshot) -> DataFrame:
        held = snapshot if entity in snapshot.keys else None
        return held.rows(entity, nodes) if held else other.rows(entity, nodes).limit(0)

    keys = (left if entity in left.keys else right).keys[entity]
    return key_changes(side(left, right), side(right, left), keys)


def diff(left: KeyedSnapshot, right: KeyedSnapshot) -> DataFrame:
    """One line per entity of either side: rows, rows on one side only, keys inserted, deleted and changed, equalities.

    Entities with equal roots are reported from the trees; their rows are not
    read.  An entity missing on a side counts as empty and of another schema.
    """
    spark = left.spark
    entities = sorted({*left.keys, *right.keys})
    suspects = changed_buckets(left, right)
    top = depth(max(left.buckets.values()))
    sizes = [
        {r["entity"]: r["row_count"] for r in s.tree.where(F.col("level") == top).select("entity", "row_count").collect()}
        for s in (left, right)]
    lines = local_table(
        spark, [(e, sizes[0].get(e, 0), sizes[1].get(e, 0), e in suspects, left.schemas.get(e) == right.schemas.get(e)) for e in entities],
        "entity STRING, left_rows BIGINT, right_rows BIGINT, compared BOOLEAN, logical_schema_equal BOOLEAN")
    names = ("only_left", "only_right", "inserted", "deleted", "changed")
    counted = [
        changes(left, right, e, nodes).agg(
            F.lit(e).alias("entity"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names[:2]],
            *[F.count_if(F.col("change") == c).alias(c) for c in names[2:]])
        for e, nodes in sorted(suspects.items())]
    if counted:
        lines = lines.join(union_all(counted), "entity", "left").fillna(0, list(names))
    else:
        lines = lines.withColumns({c: F.lit(0).cast("bigint") for c in names})
    return lines.select(
        "entity", "left_rows", "right_rows", *names, "compared", (F.col("left_rows") == F.col("right_rows")).alias("row_counts_equal"),
        "logical_schema_equal", (F.col("only_left") + F.col("only_right") == 0).alias("logical_content_hash_equal"))
