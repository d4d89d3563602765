"""Incremental bronze ingest of JSON Lines drops as a file stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.sources.lines import parse_lines

#: Keys of all times are kept on disk by each state partition; a trigger saves what it has added, not the whole.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in KEYED_STATE}
    for k, v in KEYED_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_lines(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: str,
    keys: Sequence[str],
    day_column: str,
    files_per_trigger: int | None = None,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Take every new file once and append rows with unseen keys to ``target``; returns when all files are taken.

    The keys of all earlier rows are the stream's state, dealt out by key over
    the shuffle partitions of the first start: a trigger looks up its own keys
    and saves the new ones, whatever has come before, and no row is dropped for
    being late.  Of rows that share a key inside one trigger any one is kept.
    Each micro-batch writes its own folder, overwritten if the batch is retried
    from the state before it, so a restart neither loses nor doubles rows.
    Malformed lines, and objects whose key is missing or of another type, go to
    ``<target>_rejected`` by a query of their own, which needs no state.  The
    queries of both are returned, ended.
    """
    def lines() -> DataFrame:
        stream = spark.readStream.format("text")
        if files_per_trigger:
            stream = stream.option("maxFilesPerTrigger", files_per_trigger)
        text = stream.load(source).withColumnRenamed("value", "line")
        return parse_lines(text).select("line", F.when(F.col("is_object"), F.from_json("line", schema)).alias("row"))

    whole = F.coalesce(reduce(Column.__and__, [F.col(f"row.{k}").isNotNull() for k in keys]), F.lit(False))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_day", F.to_date(day_column)).write.mode("overwrite").partitionBy("_day").parquet(f"{target}/batch={batch_id}")

    def leave_out(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").text(f"{target}_rejected/batch={batch_id}")

    def started(df: DataFrame, take, name: str) -> StreamingQuery:
        return df.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()

    with keyed_state(spark):
        accepted = started(lines().where(whole).select("row.*").dropDuplicates(list(keys)), keep, "accepted")
        rejected = started(lines().where(~whole).select("line"), leave_out, "rejected")
        for query in (accepted, rejected):
            query.awaitTermination()
    return accepted, rejected


def deduplicated_stream(stream: DataFrame, keys: Sequence[str], time_column: str, delay: str) -> DataFrame:
    """Bounded-state alternative: repeats within ``delay`` are dropped by the stream's own state."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(keys))
