"""Audit runs on files: each run is written once, in the folder of its id's hash, and never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.layers import first_per_key
from wardline.operators.registry import audit_recent
from wardline.sources.storage import materialize, path_exists

PART = "_part"


class AuditStore:
    """Runs of the given schema (with ``run_id`` and ``created_at``) below ``root``.

    ``parts`` is a property of the store: the number of folders the ids are
    dealt into, each of which a lookup or an append reads only if it must.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _part(self, run_id: Column) -> Column:
        return F.pmod(F.xxhash64(run_id), F.lit(self.parts)).cast("int")

    def _stored(self) -> DataFrame:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema] + [T.StructField(PART, T.IntegerType())])
        if not path_exists(self.spark, self.root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.root)

    def append(self, runs: DataFrame) -> int:
        """Write the runs whose id is not held yet, one for each id (the first by time); how many those were.

        A retried append finds what an earlier one has left, whole or in part,
        and adds the rest.  An id that is known keeps its first record, whatever
        comes with it now.
        """
        names = [f.name for f in self.schema]
        once = first_per_key(runs.select(*names).where(F.col("run_id").isNotNull()), ["run_id"], [
            "created_at", *[c for c in names if c not in ("run_id", "created_at")]])
        once = materialize(once.withColumn(PART, self._part(F.col("run_id"))), "audit")
        touched = [r[PART] for r in once.select(PART).distinct().collect()]  # as many as there are folders
        held = self._stored().where(F.col(PART).isin(touched)).select("run_id")
        fresh = materialize(once.join(held, "run_id", "left_anti"), "audit")
        fresh.repartition(PART).write.mode("append").partitionBy(PART).parquet(self.root)
        return fresh.count()

    def runs(self) -> DataFrame:
        return self._stored().drop(PART)

    def get(self, run_id: str) -> DataFrame:
        """The run of that id: one folder is read."""
        part = self.spark.range(1).select(self._part(F.lit(run_id))).first()[0]
        return self._stored().where((F.col(PART) == part) & (F.col("run_id") == run_id)).drop(PART)

    def recent(self, limit: int = 50) -> DataFrame:
        return audit_recent(self.runs(), limit)
