"""Registries of snapshots, manifests, runs and lineage edges.

A registry is append-only: state such as *active* or *superseded* is derived
from the order of publication, never updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.identity import canonical_json
from wardline.operators.neighbours import neighbours

# Versions this code supports, and the bounds of list queries.
SUPPORTED = {
    "manifest_schema_version": "1.0", "snapshot_schema_version": "1.0", "generator_version": "1.0.0",
    "schema_version": "1.0", "loader_version": "1.0.0",
}
LIST_BOUND = 1000
AUDIT_BOUND = 100
PUBLISHABLE = ("validated", "completed", "active")
#: The newest snapshot is the last in this order, everywhere.
PUBLICATION_ORDER = ("published_at", "sequence")


def snapshot_active(snapshots: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Newest publishable snapshot of each ``by`` group: a maximum, combined before the shuffle."""
    rest = [c for c in snapshots.columns if c not in by]
    first = [c for c in (*PUBLICATION_ORDER, "snapshot_id") if c in rest]
    ordered = [*first, *[c for c in rest if c not in first]]
    return (
        snapshots.filter(F.col("status").isin(*PUBLISHABLE)).groupBy(*by)
        .agg(F.max(F.struct(*ordered)).alias("_newest"))
        .select(*by, *[F.col(f"_newest.{c}").alias(c) for c in rest])
    )


def snapshot_history(snapshots: DataFrame, by: str = "layer", sequence: str = "sequence") -> DataFrame:
    """Published snapshots with the one each replaces, the one that superseded it, and its state.

    The order is that of publication, then ``sequence``.  A layer may hold most
    of the registry, so neighbours are found in buckets by publication minute
    and time, and block of the sequence among equal times.
    """
    published = snapshots.filter(F.col("status").isin(*PUBLISHABLE)).select(
        by, "snapshot_id", "published_at", sequence,
        F.date_trunc("minute", "published_at").alias("_minute"), F.shiftright(F.col(sequence), 16).alias("_block"))
    linked = neighbours(
        published, group=[by], buckets=["_minute", "published_at", "_block"], order=["published_at", sequence],
        payload=["snapshot_id"], following="_after", preceding="_before")
    superseded_by = F.col("_after.snapshot_id")
    return linked.select(
        by, "snapshot_id", "published_at", F.col("_before.snapshot_id").alias("replaces_snapshot_id"),
        superseded_by.alias("superseded_by"),
        F.when(superseded_by.isNull(), "active").otherwise("superseded").alias("state"))


def registry_list(
    registry: DataFrame, order: Sequence[str | Column], limit: int = 100, **equals,
) -> DataFrame:
    """Registry rows with the given column values, ordered; asking for more than ``LIST_BOUND`` is an error."""
    _within(limit, LIST_BOUND)
    for column, value in equals.items():
        registry = registry.filter(F.col(column) == value)
    return registry.orderBy(*order).limit(limit)


def _within(limit: int, bound: int) -> None:
    if not 0 < limit <= bound:
        raise ValueError(f"a list holds 1 to {bound} rows; {limit} were asked for")


def stamp_provenance(result: DataFrame, **ids: str | Column) -> DataFrame:
    """Attach dataset, manifest, snapshot, profile and generator ids to every result row."""
    parts = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in ids.items()]
    return result.withColumn("provenance", F.struct(*parts))


def register_conflicts(candidates: DataFrame, registry: DataFrame, key: str, stable: Sequence[str]) -> DataFrame:
    """Outcome of registering each candidate: new, unchanged, or conflict (same id, other stable content)."""
    def fingerprinted(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha2(canonical_json(stable), 256).alias(name))

    joined = fingerprinted(candidates, "_candidate").join(fingerprinted(registry, "_known"), key, "left")
    outcome = (
        F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("_candidate"), "unchanged")
        .otherwise("conflict"))
    return joined.select(key, outcome.alias("outcome"))


def _major(column: str) -> Column:
    return F.split_part(F.col(column), F.lit("."), F.lit(1)).try_cast("int")


def version_compat(versions: DataFrame) -> DataFrame:
    """Add compatible, requires_regeneration, requires_rematerialization and reason.

    Rules are read in order; the first differing major version decides.
    """
    rules = (
        ("manifest_schema_version", "Manifest schema major version is incompatible.", False, False),
        ("snapshot_schema_version", "Snapshot schema major version is incompatible.", False, True),
        ("generator_version", "Generator major version is incompatible.", True, False),
        ("schema_version", "Logical schema major version is incompatible.", True, True),
        ("loader_version", "Loader major version is incompatible.", False, True),
    )
    no = F.lit(False)
    verdict = F.when(
        F.greatest(*[_major(column).isNull().cast("int") for column, _, _, _ in rules]) == 1,
        F.struct(no.alias("compatible"), no.alias("regenerate"), no.alias("rematerialize"),
                 F.lit("Invalid version.").alias("reason")))
    for column, reason, regenerate, rematerialize in rules:
        verdict = verdict.when(
            _major(column) != int(SUPPORTED[column].split(".")[0]),
            F.struct(no.alias("compatible"), F.lit(regenerate).alias("regenerate"),
                     F.lit(rematerialize).alias("rematerialize"), F.lit(reason).alias("reason")))
    verdict = verdict.otherwise(F.struct(
        F.lit(True).alias("compatible"), no.alias("regenerate"),
        (F.col("loader_version") != SUPPORTED["loader_version"]).alias("rematerialize"),
        F.lit("Versions share supported major compatibility.").alias("reason")))
    return versions.withColumn("_verdict", verdict).select(
        *versions.columns, F.col("_verdict.compatible").alias("compatible"),
        F.col("_verdict.regenerate").alias("requires_regeneration"),
        F.col("_verdict.rematerialize").alias("requires_rematerialization"), F.col("_verdict.reason").alias("reason"))


def lineage_ancestry(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, node_id, depth) of everything upstream of each start, each node once at its least depth.

    By doubling: jumps of 1, 2, 4, ... steps are joined from the ones before,
    and every round looks from all that is found along jumps as long as the
    round has come so far.  So rounds grow with the logarithm of the depth.
    Least depths have no gaps: a round that adds nothing is the last one, which
    ends cycles as well.  Jumps and what is found are written to the shared
    folder after each round.
    """
    from wardline.sources.storage import materialize

    found = materialize(
        starts.select(F.col("start_id"), F.col("start_id").alias("node_id"), F.lit(0).alias("depth")).distinct(), "lineage")
    jumps = materialize(edges.select(F.col("child_id").alias("_from"), F.col("parent_id").alias("_to")).distinct(), "lineage")
    reach = 1
    while True:
        further = materialize(
            found.join(jumps, found["node_id"] == jumps["_from"])
            .groupBy("start_id", F.col("_to").alias("node_id")).agg((F.min("depth") + reach).cast("int").alias("depth"))
            .join(found.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti"), "lineage")
        if further.isEmpty():
            return found
        found = materialize(found.unionByName(further), "lineage")
        on = jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_beyond"))
        jumps = materialize(jumps.join(on, "_to").select("_from", F.col("_beyond").alias("_to")).distinct(), "lineage")
        reach *= 2


def lineage_resolve_run(
    runs: DataFrame, snapshots: DataFrame, manifests: DataFrame, edges: DataFrame,
) -> DataFrame:
    """Each audited run with its serving snapshot and manifest, one row per upstream lake snapshot."""
    named = runs.select("run_id", F.get_json_object("provenance_json", "$.snapshot_id").alias("snapshot_id"))
    served = named.join(
        snapshots.select("snapshot_id", "manifest_id", "gold_snapshot_id", "orchestration_run_id"), "snapshot_id", "left"
    ).join(manifests.select("manifest_id", "dataset_id"), "manifest_id", "left")
    golds = snapshots.select(F.col("gold_snapshot_id").alias("start_id")).filter(F.col("start_id").isNotNull()).distinct()
    ancestry = lineage_ancestry(edges, golds)
    upstream = ancestry.select(
        F.col("start_id").alias("gold_snapshot_id"), F.col("node_id").alias("lake_node_id"), "depth")
    return served.join(upstream, "gold_snapshot_id", "left").select(
        "run_id", "snapshot_id", "manifest_id", "dataset_id", "gold_snapshot_id", "orchestration_run_id",
        "depth", "lake_node_id")


def audit_append(existing: DataFrame, incoming: DataFrame, order: Sequence[str] = ("created_at",)) -> DataFrame:
    """Audit rows after an idempotent append: a known run id is never written twice or changed."""
    from wardline.sources.storage import insert_ignore

    return existing.unionByName(insert_ignore(existing, incoming, ["run_id"], order).select(*existing.columns))


def audit_recent(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs; asking for more than ``AUDIT_BOUND`` is an error."""
    _within(limit, AUDIT_BOUND)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(limit)


def audit_get(runs: DataFrame, run_id) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def eval_scorecard(expected: DataFrame, actual: DataFrame, key: str = "question") -> DataFrame:
    """Share of runs with the expected outcome, and their mean latency.

    ``expected`` has ``clarification``, ``denied`` and ``expected_tables``;
    ``actual`` has ``status``, ``actual_tables`` and ``latency_ms``.
    """
    joined = actual.join(expected, key)

    def share(condition: Column, name: str) -> Column:
        return F.avg(condition.cast("double")).alias(name)

    return joined.agg(
        F.count("*").alias("questions"),
        share(F.col("status") == "completed", "executable_sql_rate"),
        share(F.array_sort(F.array_distinct("actual_tables")) == F.array_sort(F.array_distinct("expected_tables")),
              "table_selection_accuracy"),
        share((F.col("status") == "clarification_required") == F.col("clarification"), "clarification_accuracy"),
        share((F.col("status") == "denied") == F.col("denied"), "unsafe_query_rejection_rate"),
        F.avg("latency_ms").alias("average_latency_ms"))


def run_stage_summary(stage_events: DataFrame) -> DataFrame:
    """Per run: stages seen, retries, failures, duration and final status."""
    return stage_events.groupBy("run_id").agg(
        F.count_distinct("stage").alias("stages"),
        F.coalesce(F.max("retry_count"), F.lit(0)).alias("retries"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
        F.max_by("status", F.struct("finished_at", "stage")).alias("final_status"),
    ).withColumn("_took", F.col("finished_at") - F.col("started_at")).select(
        "run_id", "stages", "retries", "failures", "started_at", "finished_at", "final_status",
        F.expr("CAST((extract(DAY FROM _took) * 86400L + extract(HOUR FROM _took) * 3600 "
               "+ extract(MINUTE FROM _took) * 60 + extract(SECOND FROM _took)) * 1000 AS DOUBLE)").alias("duration_ms"))
