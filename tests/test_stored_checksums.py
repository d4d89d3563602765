"""Checksums of a lake's objects: what they tell apart, and how often stored lines and rows are read for them."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.conftest import SF_DIR
from wardline.functions import identity as ident
from wardline.plans.incremental import IncrementalLake
from wardline.plans.lake_run import Lake
from wardline.sources import lines


def hashes(*texts):
    return [(hashlib.sha256(t.encode()).hexdigest(),) for t in texts]


def test_stored_sums_name_multisets_and_add_up(spark):
    def total(rows, parts=1):
        return tuple(spark.createDataFrame(rows, "h string").repartition(parts).agg(*ident.stored_checksum("h")).first())

    some, more = hashes(*map(str, range(50))), hashes(*map(str, range(40, 90)))
    n, one = total(some)
    assert n == 50 and one == total(some[::-1], 7)[1] and len(one) == 64
    assert total([])[1] == ident.EMPTY_SUM
    others = [some[:-1], [*some, some[0]], [*some[:-1], some[0]], [*some[:-1], more[-1]]]
    assert len({one, *(total(rows)[1] for rows in others)}) == 5
    for k in range(0, 64, 16):  # each of the four words tells single rows apart
        assert len({total([row])[1][k : k + 16] for row in some[:8]}) == 8
    assert ident.added_sums(one, total(more)[1]) == total(some + more)[1]
    parts = spark.createDataFrame([total(some), total(more)], "row_count long, hash_sum string")
    assert tuple(ident.merged_checksums(parts).first()) == total(some + more)


def test_no_row_has_its_digits_read_as_numbers(spark):
    plan = spark.createDataFrame(hashes("a"), "h string").agg(*ident.stored_checksum("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(substring" not in plan and "xxhash64" in plan


@pytest.mark.parametrize("kind", [Lake, IncrementalLake])
def test_raw_lines_are_read_once_for_their_publication_and_once_for_bronze(spark, tables, lake_root, monkeypatch, kind):
    read = []
    text = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, path, *more, **named: read.append(path) or text(self, path, *more, **named))
    lake = kind(spark, lake_root)
    paths = lake.write_batch({e: tables[e] for e in ("providers", "hospitals")}, "b")
    done = lake.run(paths, "clinical", "b") if kind is Lake else lake.apply(paths, "clinical", "b")
    assert done["bronze"].passed and sorted(read) == sorted([*paths.values(), *paths.values()])
    assert {o.entity: o.row_count for o in done["bronze"].objects} == {e: tables[e].count() for e in paths}


def test_a_changed_line_of_the_same_number_of_lines_is_noticed(spark, lake_root):
    rows = spark.createDataFrame([(n, 1, "s", 5) for n in range(40)], "provider_id BIGINT, hospital_id BIGINT, specialty STRING, years_experience INT")
    lake = Lake(spark, lake_root)
    paths = lake.write_batch({"providers": rows}, "b")
    lake.publish_raw(paths, "clinical", "b")
    lines.write_text(rows.withColumn("specialty", F.lit("t")).select(ident.canonical_json(rows.columns).alias("value")), paths["providers"], "overwrite")
    assert lake.advance("bronze").errors == ["providers/input_checksums"]


def test_parity_report_writes_what_both_lakes_read_once(spark, monkeypatch):
    written = []
    plain = lines.write_canonical
    monkeypatch.setattr(lines, "write_canonical", lambda df, path: written.append(path.rsplit("/", 1)[1]) or plain(df, path))
    rows = {r.layer: r.failed_checks for r in contract.queries()["parity_report"](spark, SF_DIR).collect()}
    assert sorted(e for e in set(written) if written.count(e) > 1) == ["diagnoses", "hospitals"] and len(set(written)) == 11
    assert rows["silver"] == "logical_content_hash_equal,rejected_rows_equal" and rows["gold"] == "logical_content_hash_equal"
