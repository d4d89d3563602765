"""Data-quality gates.  Every gate returns (check, entity, violations, passed).

Row-level rules of an entity are one aggregate.  References and uniqueness are
first aggregated by key, so a key that holds a large share of the rows is one
row per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import schemas
from wardline.functions.local import local_table, union_all

Tables = Mapping[str, DataFrame]

# Accepted text forms of dates and timestamps.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{3,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
# Fixed value: shape of a valid diagnosis code.
DIAGNOSIS_CODE = r"^[A-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"


def _result(check: Column, entity: Column, violations: Column) -> list[Column]:
    return [
        check.alias("check"), entity.alias("entity"), violations.alias("violations"),
        (violations == 0).alias("passed"),
    ]


def _counted(frame: DataFrame, entity: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """All rules of one entity in one pass; a rule is a predicate that marks a violation."""
    counts = frame.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"_{i}") for i, (_, bad) in enumerate(rules)])
    lines = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("violations")) for i, (name, _) in enumerate(rules)
    ])
    return counts.select(F.inline(lines)).select(*_result(F.col("check"), F.lit(entity), F.col("violations")))


def identifier_validity(tables: Tables, entities: Sequence[str] | None = None) -> DataFrame:
    """First key column present and positive; lab results have no own identifier at the source."""
    names = [e for e in (entities or list(tables)) if e != "lab_results"]
    return union_all([
        _counted(tables[e], e, [("identifier_validity", _bad_identifier(schemas.ENTITY_KEYS[e][0]))]) for e in names
    ])


def _bad_identifier(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) <= 0)


def valid_iso(field: T.StructField) -> Column:
    """Null passes; typed columns pass; text must have the ISO form and name a real day."""
    value = F.col(field.name)
    if not isinstance(field.dataType, T.StringType):
        return F.lit(True) if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else value.isNull()
    if schemas.is_timestamp_column(field.name):
        good = value.rlike(ISO_TIMESTAMP) & value.try_cast("timestamp").isNotNull()
    else:
        good = value.rlike(ISO_DATE) & value.try_cast("date").isNotNull()
    return value.isNull() | good


def _dated(frame: DataFrame) -> list[T.StructField]:
    return [f for f in frame.schema if schemas.is_date_column(f.name) or schemas.is_timestamp_column(f.name)]


def date_parse(tables: Tables, entities: Sequence[str] | None = None) -> DataFrame:
    parts = []
    for entity in entities or list(tables):
        fields = _dated(tables[entity])
        if fields:
            parts.append(_counted(tables[entity], entity, [(f"date_parse:{f.name}", ~valid_iso(f)) for f in fields]))
    return union_all(parts)


def categorical_domains(tables: Tables) -> DataFrame:
    return union_all([
        _counted(tables[e], e, [(f"categorical_domain:{column}", ~F.coalesce(F.col(column).isin(*values), F.lit(False)))])
        for e, (column, values) in schemas.DOMAINS.items() if e in tables
    ])


def _referenced(tables: Tables, references, null_passes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Used keys with their row counts, and known parent keys, over all references at once.

    A parent that is not among the tables knows no key.

    Each child and each parent is read once.  Rows collapse to one per used key
    before the shuffle, so a key held by many rows weighs no more than another.
    References and parents are numbers here (``_edge_list`` has their names),
    so that a key is all that a row holds in an aggregate or a join.
    """
    child_of, parent_of = _numbers(references)
    by_child: dict[str, list] = {}
    for child, column, parent, key in references:
        by_child.setdefault(child, []).append((column, parent, key))
    used = union_all([
        tables[child].select(F.inline(F.array(*[
            F.struct(F.lit(child_of[child, column]).alias("_child"), F.lit(parent_of[parent, key]).alias("_parent"),
                     F.col(column).cast("bigint").alias("key")) for column, parent, key in edges])))
        .filter(F.col("key").isNotNull() if null_passes else F.lit(True)).groupBy("_child", "_parent", "key").agg(F.count("*").alias("rows"))
        for child, edges in by_child.items()])
    parents = [edge for edge in dict.fromkeys((parent, key) for _, _, parent, key in references) if edge[0] in tables]
    if not parents:
        return used, used.select("_parent", "key").limit(0)
    known = union_all([
        tables[parent].select(F.lit(parent_of[parent, key]).alias("_parent"), F.col(key).cast("bigint").alias("key"))
        for parent, key in parents])
    return used, known


def _numbers(references) -> tuple[dict, dict]:
    children = dict.fromkeys((c, k) for c, k, _, _ in references)
    parents = dict.fromkeys((p, pk) for _, _, p, pk in references)
    return {c: n for n, c in enumerate(children)}, {p: n for n, p in enumerate(parents)}


def _edge_list(tables: Tables, references) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    child_of, _ = _numbers(references)
    return local_table(
        spark, [(child_of[c, k], f"{c}.{k}", f"{p}.{pk}", c, k) for c, k, p, pk in references],
        "_child INT, child STRING, parent STRING, entity STRING, column_name STRING")


def foreign_keys(tables: Tables, references=schemas.REFERENCES, null_passes: bool = True) -> DataFrame:
    """Rows whose reference has no parent; a null reference passes if ``null_passes``."""
    used, known = _referenced(tables, references, null_passes)
    orphans = used.join(known, ["_parent", "key"], "left_anti").groupBy("_child").agg(F.sum("rows").alias("_orphans"))
    return _edge_list(tables, references).join(orphans, "_child", "left").select(*_result(
        F.concat(F.lit("foreign_key:"), "column_name"), F.col("entity"), F.coalesce("_orphans", F.lit(0))))


def foreign_keys_by_parent(tables: Tables, references=schemas.REFERENCES, null_passes: bool = True) -> DataFrame:
    """``foreign_keys`` for stored tables, reference by reference.

    Nothing but key columns of one child and one parent meets in a join, so
    tables that are bucketed by the key are counted and joined where they lie,
    and a parent that Spark knows to be small is sent to the child.  Frames that
    are expensive to compute are read once for each of their references here.
    """
    parts = []
    for child, column, parent, key in references:
        used = tables[child].select(F.col(column).alias("key"))
        if null_passes:
            used = used.where(F.col("key").isNotNull())
        counted = used.groupBy("key").agg(F.count("*").alias("rows"))
        if parent in tables:
            counted = counted.join(tables[parent].select(F.col(key).alias("key")), "key", "left_anti")
        parts.append(counted.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_orphans")).select(
            *_result(F.lit(f"foreign_key:{column}"), F.lit(child), F.col("_orphans"))))
    return union_all(parts)


def foreign_keys_lake(tables: Tables) -> DataFrame:
    """References of the lake's entities at hand: null references and those to entities that are absent are orphans."""
    return foreign_keys(tables, [r for r in schemas.LAKE_REFERENCES if r[0] in tables], null_passes=False)


def missingness(tables: Tables, entities: Sequence[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """Null profile per column; a column passes while its null rate stays within ``threshold``."""
    parts = []
    for entity in entities or list(tables):
        frame = tables[entity]
        counts = frame.agg(
            F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in frame.columns])
        lines = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{c}").alias("null_count")) for c in frame.columns
        ])
        parts.append(counts.select("_rows", F.inline(lines)).select(
            F.lit(entity).alias("entity"), "column_name", F.col("_rows").alias("row_count"), "null_count",
            F.coalesce(F.try_divide(F.col("null_count").cast("double"), F.col("_rows")), F.lit(0.0)).alias("null_rate"),
        ))
    return union_all(parts).withColumn("passed", F.col("null_rate") <= threshold)


def quality_rate_bounds(tables: Tables) -> DataFrame:
    return _counted(tables["quality_measures"], "quality_measures", gold_rules("quality_measures"))


def _rate_out_of_bounds() -> Column:
    good = F.col("measure_value").between(0, 1) & (F.col("numerator") <= F.col("denominator"))
    return ~F.coalesce(good, F.lit(False))


def check_constraints(tables: Tables, entities: Sequence[str] | None = None) -> DataFrame:
    """Declared row constraints; a constraint that is unknown (null) holds."""
    names = entities or list(dict.fromkeys(e for e, _, _ in schemas.CHECKS))
    return union_all([_counted(tables[e], e, _check_rules(e)) for e in names])


def not_null(tables: Tables, entities: Sequence[str] | None = None) -> DataFrame:
    return union_all([_counted(tables[e], e, _not_null_rules(e)) for e in (entities or list(tables))])


def declared_rules(tables: Tables) -> DataFrame:
    """``not_null`` and ``check_constraints`` of all entities at hand, in one pass over each."""
    return union_all([_counted(tables[e], e, _not_null_rules(e) + _check_rules(e)) for e in tables])


def _check_rules(entity: str) -> list[tuple[str, Column]]:
    return [(f"check:{column}", ~F.expr(rule)) for owner, column, rule in schemas.CHECKS if owner == entity]


def _not_null_rules(entity: str) -> list[tuple[str, Column]]:
    return [(f"not_null:{name}", F.col(name).isNull()) for name, _, nullable in schemas.ENTITY_FIELDS[entity] if not nullable]


def unique_keys(tables: Tables, entities: Sequence[str] | None = None) -> DataFrame:
    """Keys held by more than one row, for primary and further unique keys; one pass over each entity.

    Key columns are grouped as they are; an entity with several keys is counted
    by grouping sets, one for each key.
    """
    parts = []
    for entity in entities or list(tables):
        keys = [schemas.ENTITY_KEYS[entity], *schemas.UNIQUE_KEYS.get(entity, ())]
        columns = list(dict.fromkeys(c for key in keys for c in key))
        rows = tables[entity].select(*columns)
        if len(keys) == 1:
            counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"), F.lit(0).alias("_set"))
        else:
            counted = rows.groupingSets([[F.col(c) for c in key] for key in keys], *[F.col(c) for c in columns]).agg(
                F.count("*").alias("_n"), F.grouping_id().alias("_set"))
        absent = [sum(1 << n for n, c in enumerate(reversed(columns)) if c not in key) for key in keys]
        repeated = counted.agg(*[F.count_if((F.col("_set") == s) & (F.col("_n") > 1)).alias(f"_{n}") for n, s in enumerate(absent)])
        lines = F.array(*[
            F.struct(F.lit("unique:" + ",".join(key)).alias("check"), F.col(f"_{n}").alias("violations")) for n, key in enumerate(keys)])
        parts.append(repeated.select(F.inline(lines)).select(*_result(F.col("check"), F.lit(entity), F.col("violations"))))
    return union_all(parts)


def expected_objects(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Entities of the parent manifest that the child manifest lacks."""
    missing = parent.select("entity").join(child.select("entity"), "entity", "left_anti")
    return missing.agg(F.count("*").alias("violations")).select(
        *_result(F.lit("expected_objects"), F.lit(None).cast("string"), F.col("violations")))


def duplicate_source_objects(objects: DataFrame, column: str = "object_id") -> DataFrame:
    repeated = objects.groupBy(column).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))
    return repeated.select(*_result(F.lit("duplicate_source_objects"), F.lit(None).cast("string"), F.col("violations")))


def input_checksums(registered: DataFrame, actual: DataFrame) -> DataFrame:
    """Objects whose content no longer has the registered checksum, or that are gone."""
    keys = ["entity", "row_count", "hash_sum"]
    changed = registered.select(*keys).join(actual.select(*keys), keys, "left_anti")
    return changed.groupBy().agg(F.count("*").alias("violations")).select(
        *_result(F.lit("input_checksums"), F.lit(None).cast("string"), F.col("violations")))


def parse_success(parsed: DataFrame, entity: str, max_ratio: float = 0.0) -> DataFrame:
    """Malformed lines; by default a single one fails, ``max_ratio`` tolerates a share."""
    counted = parsed.agg(F.count("*").alias("_rows"), F.count_if(~F.col("is_object")).alias("violations"))
    return counted.select(
        F.lit("parse_success").alias("check"), F.lit(entity).alias("entity"), "violations",
        (F.col("violations") <= F.lit(max_ratio) * F.col("_rows")).alias("passed"))


def flagged(mark: str) -> Column:
    return F.array_contains(F.col(schemas.QUALITY_FLAGS), mark)


def bronze_rules(entity: str) -> list[tuple[str, Column]]:
    """Violations a written bronze row can show: a key column the source object lacked, a value of another type."""
    marks = F.array(*[F.lit(f"missing:{k}") for k in schemas.ENTITY_KEYS[entity]])
    missing = ("expected_columns", F.arrays_overlap(F.col(schemas.QUALITY_FLAGS), marks))
    return [missing, *[(f"type:{name}", flagged(f"type:{name}")) for name in schemas.columns(entity)]]


def identifier_rule(entity: str) -> list[tuple[str, Column]]:
    """Of bronze rows, before silver drops null and repeated keys: an identifier of another type, or not positive."""
    if entity == "lab_results":
        return []
    key = schemas.ENTITY_KEYS[entity][0]
    return [("identifier_validity", flagged(f"type:{key}") | (F.col(key) <= 0))]


def silver_rules(entity: str) -> list[tuple[str, Column]]:
    """Violations a written silver row can show: dates, categorical domain."""
    rules = []
    for name in schemas.columns(entity):
        if schemas.is_date_column(name) or schemas.is_timestamp_column(name):
            rules.append((f"date_parse:{name}", flagged(f"date:{name}") | flagged(f"type:{name}")))
    if entity in schemas.DOMAINS:
        column, values = schemas.DOMAINS[entity]
        rules.append((f"categorical_domain:{column}", ~F.coalesce(F.col(column).isin(*values), F.lit(False))))
    return rules


def gold_rules(entity: str) -> list[tuple[str, Column]]:
    return [("quality_rate_bounds", _rate_out_of_bounds())] if entity == "quality_measures" else []


def row_rules(frame: DataFrame, entity: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """The given row rules of one entity, in one pass."""
    return _counted(frame, entity, rules)


def required_entities(present: DataFrame, required: Sequence[str] = schemas.REQUIRED_GOLD) -> DataFrame:
    """Required entities that are not among the ``entity`` values of ``present``."""
    needed = local_table(present.sparkSession, [(e,) for e in required], "entity STRING")
    missing = needed.join(present.select("entity"), "entity", "left_anti")
    return missing.agg(F.count("*").alias("violations")).select(
        *_result(F.lit("required_entities"), F.lit(None).cast("string"), F.col("violations")))


def row_count_reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(entity, expected_rows, actual_rows, passed) over both sides."""
    left = expected.select("entity", F.col("row_count").alias("expected_rows"))
    right = actual.select("entity", F.col("row_count").alias("actual_rows"))
    return left.join(right, "entity", "full").select(
        "entity", "expected_rows", "actual_rows",
        F.coalesce(F.col("expected_rows") == F.col("actual_rows"), F.lit(False)).alias("passed"))


def stable_summary(tables: Tables) -> DataFrame:
    """Fingerprint of the encounters: exact total cost."""
    total = F.round(F.sum(F.col("total_cost").cast("decimal(18,2)")), 2)
    return tables["encounters"].agg(total.alias("encounter_total_cost"))


def negative_stay(tables: Tables) -> DataFrame:
    bad = F.col("discharge_date") < F.col("admission_date")
    return _counted(tables["encounters"], "encounters", [("negative_stay", bad)])


def unknown_codes(tables: Tables, pattern: str = DIAGNOSIS_CODE) -> DataFrame:
    """Diagnoses with a code of no valid shape, and how many encounters carry them."""
    strange = tables["diagnoses"].filter(~F.col("diagnosis_code").rlike(pattern)).select("diagnosis_id", "diagnosis_code")
    used = tables["encounter_diagnoses"].groupBy("diagnosis_id").agg(F.count("*").alias("encounters"))
    return strange.join(used, "diagnosis_id", "left").select(
        "diagnosis_code", F.coalesce("encounters", F.lit(0)).alias("encounters"))


def gate(checks: DataFrame) -> DataFrame:
    """One row: does everything pass, how many checks failed, which ones."""
    failed = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.concat_ws("/", "entity", "check"))))
    return checks.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count("*").alias("checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"), failed.alias("errors"))


def dimension_join_check(tables: Tables, edges=schemas.REFERENCES) -> DataFrame:
    """Profile of each approved join edge: used keys, rows, orphan rows, widest fan-out."""
    used, known = _referenced(tables, edges)
    profile = used.join(known.withColumn("_known", F.lit(True)), ["_parent", "key"], "left").groupBy("_child").agg(
        F.count("*").alias("_keys"), F.sum("rows").alias("_rows"),
        F.sum(F.when(F.col("_known").isNull(), F.col("rows"))).alias("_orphans"), F.max("rows").alias("_widest"))

    def whole(name: str, out: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(out)

    return _edge_list(tables, edges).join(profile, "_child", "left").select(
        "child", "parent", whole("_keys", "used_keys"), whole("_rows", "rows"), whole("_orphans", "orphan_rows"),
        whole("_widest", "max_fan_out"))
