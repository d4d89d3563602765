"""A lake whose snapshots are chains of batches.

A batch is laid on top of the head, the newest run that passed every gate.  Raw
and bronze hold the batch's own lines; silver adds the rows of keys that are
not there yet, and reads only those key buckets of the state that the batch
hits; gold takes over what silver added.  Nothing that an earlier batch wrote is
read whole or written again: row counts and hashes add up, and each silver
object carries the hash tree of all its buckets, so two snapshots are compared
without reading what they share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import schemas
from wardline.functions.identity import EMPTY_SUM, added_sums, canonical_json, merged_checksums, stored_checksum
from wardline.functions.local import local_table, union_all
from wardline.operators import hash_tree, layers, quality
from wardline.operators.hash_tree import BUCKET
from wardline.plans.lake_run import EDGE_SCHEMA, VERSION, Conflict, Lake, ObjectVersion, Snapshot, _verdicts, identity
from wardline.sources import storage

PART_SCHEMA = (
    "object_id STRING, parent_object_id STRING, layer STRING, entity STRING, path STRING, batch_id STRING, buckets INT, "
    "row_count BIGINT, hash_sum STRING")
_PART = "_part"


class IncrementalLake(Lake):
    def __init__(self, spark: SparkSession, root: str, rows_in_bucket: int = hash_tree.ROWS_IN_BUCKET, **options):
        """``rows_in_bucket`` sets an entity's number of key buckets from its first batch; it stays as it is from then on."""
        super().__init__(spark, root, **options)
        self.rows_in_bucket = rows_in_bucket
        self._lines: dict[str, dict] = {}  # of the parts registry, by object; a line never changes
        self._unsaved: list[dict] = []

    # chains

    def head(self) -> dict[str, Snapshot]:
        """The newest run that reached gold, by layer; empty before the first one."""
        gold = self.active("gold")
        done = {}
        while gold is not None:
            done[gold.layer] = gold
            row = self.snapshots().where(F.col("snapshot_id") == gold.parent_snapshot_id).first() if gold.parent_snapshot_id else None
            gold = self._load(row) if row else None
        return done

    def parts(self, o: ObjectVersion) -> list[dict]:
        """The batches' parts of an object, oldest first: one line for each batch that added to it."""
        if o.object_id not in self._lines:
            self._lines |= {r["object_id"]: r.asDict() for r in self._registry("parts", PART_SCHEMA).collect()}  # a line per batch and entity
        chain, at = [], o.object_id
        while at is not None:
            chain.append(self._lines[at])
            at = self._lines[at]["parent_object_id"]
        return chain[::-1]

    def state(self, o: ObjectVersion, layer: str, nodes: Sequence[int] | None = None) -> DataFrame:
        """Rows of an object of bronze, silver or gold; of silver, those of the given buckets only (no other folder is read)."""
        paths = [p["path"] for p in self.parts(o)]
        if layer != "silver":
            return self.spark.read.schema(schemas.lake_schema(o.entity, layer == "gold")).parquet(*paths)
        schema = schemas.lake_schema(o.entity, typed=True).add(_PART, T.StringType()).add(BUCKET, T.IntegerType())
        rows = self.spark.read.schema(schema).option("basePath", self._state_root(o.entity)).parquet(*paths)
        return (rows if nodes is None else rows.where(F.col(BUCKET).isin(list(nodes)))).drop(_PART)

    def _state_root(self, entity: str) -> str:
        return f"{self.root}/state/{entity}"

    def frames(self, snapshot: Snapshot) -> dict[str, DataFrame]:
        if snapshot.layer == "raw":
            raise ValueError("Raw objects are lines, not rows.")
        return {o.entity: self.state(o, snapshot.layer).drop(BUCKET) for o in snapshot.objects}

    def tree(self, o: ObjectVersion) -> DataFrame:
        return self.spark.read.schema(hash_tree.NODES).parquet(f"{self.root}/trees/{o.object_id}")

    def _extended(self, layer: str, base: ObjectVersion | None, part: ObjectVersion, batch: str, buckets: int = 0) -> ObjectVersion:
        """``base`` with one more part, as an object of its own."""
        object_id = identity("object", layer, part.entity, VERSION, base.object_id if base else None, part.object_id)
        line = {
            "object_id": object_id, "parent_object_id": base.object_id if base else None, "layer": layer, "entity": part.entity,
            "path": part.path, "batch_id": batch, "buckets": buckets, "row_count": part.row_count, "hash_sum": part.hash_sum}
        self._lines[object_id] = line
        self._unsaved.append(line)
        return replace(
            part, object_id=object_id, row_count=part.row_count + (base.row_count if base else 0),
            rejected=part.rejected + (base.rejected if base else 0), hash_sum=added_sums(part.hash_sum, base.hash_sum if base else EMPTY_SUM))

    # a batch

    def apply(self, paths: Mapping[str, str], dataset_id: str, batch: str, parent: str | None = None) -> dict[str, Snapshot]:
        """Run a batch of JSON Lines through all layers on top of the head.

        ``parent`` is the gold snapshot the batch was made for; any other head
        is a conflict.  A batch that the head already holds changes nothing; the
        same batch id with other content is a conflict.  The first layer whose
        gate fails ends the run, and the head stays what it was.
        """
        base = self.head()
        if parent is not None and (not base or base["gold"].snapshot_id != parent):
            raise Conflict(f"batch {batch} is made for {parent}, the head is {base['gold'].snapshot_id if base else 'empty'}")
        lines = self._each(lambda item: self._raw_part(*item), sorted(paths.items()))
        if base and self._known(base["raw"], lines, batch):
            return base
        before = {layer: {o.entity: o for o in s.objects} for layer, s in base.items()}
        objects = self._each(lambda o: self._extended("raw", before.get("raw", {}).get(o.entity), o, batch), lines)
        done = {"raw": self._publish_batch("raw", dataset_id, None, batch, objects, [], base)}
        parts = lines
        for layer in schemas.LAYERS[1:]:
            parent_snapshot = done[schemas.LAYERS[schemas.LAYERS.index(layer) - 1]]
            step = {"bronze": self._bronze_part, "silver": self._silver_part, "gold": self._gold_part}[layer]
            held = before.get(layer, {})
            results = self._each(lambda o, s=step, h=held, p=parent_snapshot: s(o, h.get(o.entity), p, batch), parts)
            parts = [part for part, _, _ in results]
            objects = [whole for _, whole, _ in results]
            checks = [c for _, _, found in results for c in found]
            together = {**held, **{o.entity: o for o in objects}}
            if layer == "silver":
                checks += self._references(parts, together)
            if layer == "gold":
                checks.append(("required_entities", None, set(schemas.REQUIRED_GOLD) <= set(together)))
            errors = sorted({f"{entity or 'lake'}/{check}" for check, entity, passed in checks if not passed})
            done[layer] = self._publish_batch(layer, dataset_id, parent_snapshot, batch, objects, errors, base)
            if errors:
                break
        return done

    def _known(self, raw: Snapshot, lines: Sequence[ObjectVersion], batch: str) -> bool:
        held = {(p["entity"], p["row_count"], p["hash_sum"]) for o in raw.objects for p in self.parts(o) if p["batch_id"] == batch}
        if held and held != {(o.entity, o.row_count, o.hash_sum) for o in lines}:
            raise Conflict(f"batch {batch} is known with other content")
        return bool(held)

    def _publish_batch(self, layer, dataset_id, parent, batch, objects, errors, base) -> Snapshot:
        """A snapshot of the batch's objects and of the head's objects that the batch leaves alone."""
        if self._unsaved:
            self._append("parts", [tuple(line.values()) for line in self._unsaved], PART_SCHEMA)
            self._unsaved = []
        held = base.get(layer)
        carried = [o for o in held.objects if o.entity not in {n.entity for n in objects}] if held else []
        whole = sorted([*objects, *carried], key=lambda o: o.entity)
        step = schemas.layer_transition(parent.layer, layer) if parent else "source-to-raw"
        done = self._publish(layer, dataset_id, step, parent, batch, whole, errors)
        if held and done.passed:
            self._append("edges", [(held.snapshot_id, done.snapshot_id, "extended_by", step, VERSION)], EDGE_SCHEMA)
        return done

    def _raw_part(self, entity: str, path: str) -> ObjectVersion:
        total = self._raw_checksum(path)
        return ObjectVersion(entity, identity("object", "raw", entity, *total), path, total.row_count, 0, total.hash_sum)

    def _bronze_part(self, o: ObjectVersion, base: ObjectVersion | None, parent: Snapshot, batch: str):
        part, checks = self._bronze(o, replace(parent, batch_id=batch))
        return part, self._extended("bronze", base, part, batch), checks

    def _gold_part(self, o: ObjectVersion, base: ObjectVersion | None, parent: Snapshot, batch: str):
        silver = self.spark.read.schema(schemas.lake_schema(o.entity, typed=True)).parquet(o.path).drop(BUCKET)
        path = storage.write_version(
            layers.gold_transform(silver), self.root, "gold", o.entity, schemas.ENTITY_KEYS[o.entity],
            schemas.CLUSTER_KEYS.get(o.entity, ()))
        part, checks = self._measured(o, "gold", path, quality.gold_rules(o.entity))
        return part, self._extended("gold", base, part, batch), [*self._input_check(o, "silver"), *checks]

    def _silver_part(self, o: ObjectVersion, base: ObjectVersion | None, parent: Snapshot, batch: str):
        """Typed rows of keys that are new: the first of each in the batch, if the state's bucket does not hold the key."""
        bronze = storage.read_entity(self.spark, o.path, o.entity)
        keys = schemas.ENTITY_KEYS[o.entity]
        buckets = self.parts(base)[0]["buckets"] if base else hash_tree.buckets_for(o.row_count, self.rows_in_bucket)
        firsts, _ = layers.stored_firsts(bronze, keys)
        firsts = layers.silver_typing(firsts).withColumn(BUCKET, hash_tree.bucket_of(keys, buckets))
        if base:
            nodes = [r[BUCKET] for r in firsts.select(BUCKET).distinct().collect()]  # as many as there are buckets
            firsts = storage.without_keys(firsts, self.state(base, "silver", nodes), keys)
        path = f"{self._state_root(o.entity)}/{_PART}={uuid.uuid4().hex}"
        hash_tree.write_buckets(firsts, path, keys)
        part, checks = self._measured(o, "silver", path, quality.silver_rules(o.entity))
        if part.rejected:
            kept = self.spark.read.schema(schemas.lake_schema(o.entity, typed=True)).parquet(path)
            place = [schemas.SOURCE_FILE, schemas.ROW_ORDER]
            no_key = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
            left_out = bronze.join(kept.select(*place), place, "left_anti").select(
                F.when(no_key == 1, layers.NULL_KEY).otherwise(layers.DUPLICATE_KEY).alias("reason"),
                canonical_json(schemas.columns(o.entity)).alias("content"), *place, schemas.BATCH_ID)
            rejected_path, counts = self._keep_rejected(left_out, "silver", o.entity)
            part = replace(part, rejected_path=rejected_path, rejected_reasons=json.dumps(counts, sort_keys=True))
        whole = self._extended("silver", base, part, batch, buckets)
        self._grow_tree(whole, base, path, buckets)
        return part, whole, [*self._input_check(o, "bronze", quality.identifier_rule(o.entity)), *checks]

    def _grow_tree(self, whole: ObjectVersion, base: ObjectVersion | None, path: str, buckets: int) -> None:
        """The base's leaves and those of the new part add up; no row of the base is looked at."""
        stored = self.spark.read.schema(f"{schemas.RECORD_HASH} STRING, {BUCKET} INT").parquet(path)
        bottom = hash_tree.leaves(stored, checksum=stored_checksum())
        if base:
            old = self.tree(base).where("level = 0").select("node", "row_count", "hash_sum")
            bottom = merged_checksums(bottom.unionByName(old), ["node"])
        hash_tree.grown(bottom, buckets).repartition(1).write.mode("overwrite").parquet(f"{self.root}/trees/{whole.object_id}")

    def _references(self, parts: Sequence[ObjectVersion], state: Mapping[str, ObjectVersion]) -> list[tuple[str, str | None, bool]]:
        """References of the batch's new rows, looked up in those buckets of the parents that they fall into."""
        found = []
        new = {p.entity: p for p in parts}
        for child, column, parent, key in schemas.LAKE_REFERENCES:
            if child not in new or not new[child].row_count:
                continue
            asked = self.spark.read.schema(schemas.lake_schema(child, typed=True)).parquet(new[child].path).select(
                F.col(column).alias(key)).distinct()
            if parent in state:
                buckets = self.parts(state[parent])[0]["buckets"]
                asked = storage.materialize(asked.withColumn(BUCKET, hash_tree.bucket_of([key], buckets)), "asked")
                nodes = [r[BUCKET] for r in asked.where(F.col(key).isNotNull()).select(BUCKET).distinct().collect()]
                asked = asked.join(self.state(state[parent], "silver", nodes).select(key), key, "left_anti")
            found.append((f"foreign_key:{column}", child, asked.isEmpty()))
        return found

    # comparison

    def changes(self, left: Snapshot, right: Snapshot) -> DataFrame:
        """(entity, key, change) between two silver snapshots of this lake, read from the buckets that differ alone."""
        sides = [{o.entity: o for o in s.objects} for s in (left, right)]
        found = [local_table(self.spark, [], "entity STRING, key STRING, change STRING")]
        for entity in sorted({*sides[0], *sides[1]}):
            one, other = (side.get(entity) for side in sides)
            if one and other and (one.row_count, one.hash_sum) == (other.row_count, other.hash_sum):
                continue
            present = one or other
            buckets = self.parts(present)[0]["buckets"]
            none = self.spark.createDataFrame([], hash_tree.NODES)
            trees = [self.tree(o) if o else none for o in (one, other)]
            nodes = [r["node"] for r in hash_tree.differing(*trees, buckets).collect()]
            rows = [self.state(o, "silver", nodes) if o else self.state(present, "silver", []) for o in (one, other)]
            keys = list(schemas.ENTITY_KEYS[entity])
            changed = hash_tree.key_changes(*rows, keys, schemas.RECORD_HASH)
            found.append(changed.select(F.lit(entity).alias("entity"), F.to_json(F.struct(*keys)).alias("key"), "change"))
        return union_all(found)


def batch_rows(lake: IncrementalLake, done: Mapping[str, Snapshot]) -> DataFrame:
    """(layer, entity, batch_id, parent_batch_id, row_count) of every part of the objects of a run."""
    rows = []
    for layer, snapshot in done.items():
        for o in snapshot.objects:
            before = None
            for p in lake.parts(o):
                rows.append((layer, o.entity, p["batch_id"], before, p["row_count"]))
                before = p["batch_id"]
    return local_table(lake.spark, rows, "layer STRING, entity STRING, batch_id STRING, parent_batch_id STRING, row_count BIGINT")
