"""Interaction of document filters: what each removes, and what it would have removed, in every order.

Each filter stores the ids of the documents that fail it in a table of its
own.  Left-anti joins with those tables give the survivors of every set of
filters, left-semi joins what a filter removes from them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.local import union_all
from wardline.llm.common import long_id, materialize, workspace

# The five filters, by letter (E, copies of a smaller doc_id's text, is no property of one text).
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"

#: A document in the id tables: its doc_id, and its text where rows share a doc_id.
KEY = ["doc_id", "version"]
LABELS = ("good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions on one text, all inside the JVM."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS, "B": 100 * distinct < LEAST_DISTINCT * n,
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text), "D": text.rlike(SYMBOLS)}


def _version() -> Column:
    return F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("version")


def failing_ids(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows (doc_id, version, part) of all documents, and for each filter the table of the keys that fail it.

    Texts are read once; from there on only keys move.  A text's copies are
    found by SHA-256: the smallest doc_id of each hash is a minimum, combined
    before the shuffle, and whoever is not such a first one fails E by a
    left-anti join on unique keys, so thousands of copies meet in no task.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(
        long_id(id_column, "doc_id"), F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).where("doc_id IS NOT NULL")
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(letter)) for letter, fails in text_failures(F.col("text")).items()]))
    facts = materialize(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed")).select(
        "doc_id", _version(), "part", "digest", "failed"), "audit")
    spark, path = docs.sparkSession, workspace(docs.sparkSession, "failing")
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", _version())
    by_text = facts.select(*KEY, F.explode("failed").alias("filter"))
    copies = facts.select(*KEY).join(firsts, KEY, "left_anti").withColumn("filter", F.lit("E"))
    by_text.unionByName(copies).distinct().write.partitionBy("filter").parquet(path)
    stored = spark.read.schema("doc_id long, version long, filter string").parquet(path)
    return facts.select(*KEY, "part"), {f: stored.where(F.col("filter") == f).select(*KEY) for f in "ABCDE"}


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with 0/1 columns good and toxic; a document counts if any of its labels says so."""
    marks = labels.select(
        long_id("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"),
    ).where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in LABELS])
    return rows.join(marks, "doc_id", "left").fillna(0, list(LABELS))


def audit_order(rows: DataFrame, failing: Mapping[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """(part, step, filter, kept, removed, redundant) of one order, step by step along the joins."""
    parts = rows.select("part").distinct()
    left, found = rows, []
    for step, f in enumerate(order, 1):
        removed, failed, left = left.join(failing[f], KEY, "left_semi"), rows.join(failing[f], KEY, "left_semi"), left.join(failing[f], KEY, "left_anti")
        counted = [df.groupBy("part").agg(F.count("*").alias(n)) for n, df in (("kept", left), ("removed", removed), ("failed", failed))]
        line = parts
        for c in counted:
            line = line.join(c, "part", "left")
        line = line.fillna(0, ["kept", "removed", "failed"])
        found.append(line.select(
            "part", F.lit(step).alias("step"), F.lit(f).alias("filter"), "kept", "removed", (F.col("failed") - F.col("removed")).alias("redundant")))
    return union_all(found)


def survivors(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """(part, and arrays kept, good, toxic: counts after each set of filters; bit k of an index: filter k has run).

    A prefix of an order leaves what its set of filters leaves, so 2**k sets
    stand for all prefixes.  Every failing row is doubled filter by filter, once
    with the filter run and once without, and the left-anti join takes out the
    former where the filter fails it; what fails nothing (no id table has it, a
    left-anti join with all of them) survives every set and is counted only
    once.  All joins are on the same unique key, so rows are shuffled by it once.
    """
    any_failing = union_all([df.select(*KEY) for df in failing.values()]).distinct()
    sums = [F.count("*").alias("kept"), *[F.sum(F.col(c).cast("long")).alias(c) for c in LABELS]]
    clean = rows.join(any_failing, KEY, "left_anti").groupBy("part").agg(*sums).withColumn("set", F.lit(-1))
    tagged = rows.join(any_failing, KEY, "left_semi").withColumn("set", F.lit(0))
    for k, ids in enumerate(failing.values()):
        tagged = tagged.withColumn("runs", F.explode(F.array(F.lit(0), F.lit(1))))
        match = (tagged["runs"] == 1) & (tagged["doc_id"] == ids["doc_id"]) & (tagged["version"] == ids["version"])
        tagged = tagged.join(ids, match, "left_anti").withColumn("set", F.col("set") + F.col("runs") * (1 << k)).drop("runs")
    cells = materialize(clean.unionByName(tagged.groupBy("part", "set").agg(*sums)), "audit")

    lines = F.map_from_entries(F.collect_list(F.struct("set", F.struct("kept", *LABELS))))  # as many as there are sets, and one
    by_part = cells.groupBy("part").agg(lines.alias("of"))

    def counts(name: str) -> Column:
        def found(s: Column) -> Column:
            return F.coalesce(F.try_element_at("of", s)[name], F.lit(0).cast("long"))

        return F.transform(F.sequence(F.lit(0), F.lit((1 << len(failing)) - 1)), lambda s: found(s) + found(F.lit(-1))).alias(name)

    return by_part.select("part", *[counts(n) for n in ("kept", *LABELS)])


def audit(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each part, order of the filters and step; see ``filter_interactions`` for the columns.

    ``rows`` has doc_id, version, part, good and toxic; a filter has a letter.
    """
    letters = list(failing)
    steps = []
    for order in permutations(letters):
        run = 0
        for n, f in enumerate(order, 1):
            bit = 1 << letters.index(f)
            steps.append((n, "".join(order), f, run, run | bit, bit, (1 << len(letters)) - 1 - bit, (1 << len(letters)) - 1))
            run |= bit
    names = ("step", "filter_order", "filter", "before", "after", "alone", "others", "all")
    plan = F.from_json(
        F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in steps])),
        "array<struct<step int, filter_order string, filter string, before int, after int, alone int, others int, all int>>")
    counted = survivors(rows, failing).select("*", _shapley(letters))
    lines = counted.select("*", F.explode(plan).alias("at")).select(*counted.columns, "at.*")

    def after(counts: str, filters: str) -> Column:
        return F.get(F.col(counts), F.col(filters))

    removed = after("kept", "before") - after("kept", "after")
    return lines.select(
        "part", "filter_order", "step", after("kept", "after").alias("kept"), removed.alias("removed"),
        (F.get("kept", F.lit(0)) - after("kept", "alone") - removed).alias("redundant"),
        (after("kept", "others") - after("kept", "all")).alias("unique_fails"),
        *[(after(c, "before") - after(c, "after")).alias(f"{c}_lost") for c in LABELS],
        F.element_at("shapley", F.col("filter")).alias("shapley"))


def _shapley(letters: Sequence[str]) -> Column:
    """Removals by each filter summed over all orders: a set of s filters comes before it in s! (k - 1 - s)! of them."""
    terms = []
    for k, f in enumerate(letters):
        sets = [s for s in range(1 << len(letters)) if not s >> k & 1]
        weights = [factorial(s.bit_count()) * factorial(len(letters) - 1 - s.bit_count()) for s in sets]
        runs = F.from_json(F.lit(json.dumps([[s, s | 1 << k, w] for s, w in zip(sets, weights, strict=True)])), "array<array<int>>")
        total = F.aggregate(
            runs, F.lit(0).cast("long"), lambda done, t: done + (F.get("kept", F.get(t, F.lit(0))) - F.get("kept", F.get(t, F.lit(1)))) * F.get(t, F.lit(2)))
        terms += [F.lit(f), total]
    return F.create_map(*terms).alias("shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters do to each other, for each part (source) and each of their 120 orders.

    part, filter_order, step (from 1), and counts of the part's documents: kept
    after the step, removed by it, redundant (failing it, removed before),
    unique_fails (failing no other filter), good_lost and toxic_lost (labelled
    so, removed by it), shapley (removed by this filter, summed over all orders).

    A null text is empty, a null source the part ''; rows without doc_id are
    left out; repeated rows all count; of rows that share a doc_id each is
    judged by its own text, and labelled alike.  Null labels say nothing.  An
    empty table gives no row.  Other columns play no part.
    """
    rows, failing = failing_ids(docs)
    return audit(materialize(labelled(rows, labels), "audit"), failing)


def oracle() -> str:
    """The same rows as DuckDB SQL: failing letters of each document, counted for every order."""
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL
    ), w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
    firsts AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
    marks AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id
    ), judged AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
          CASE WHEN len(words) < {LEAST_WORDS} THEN 'A' ELSE '' END,
          CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 'B' ELSE '' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END,
          CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END,
          CASE WHEN w.doc_id > low THEN 'E' ELSE '' END) AS fails
      FROM w JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = w.doc_id
    ), cells AS (
      SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
    ), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
      SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (
      SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, CAST(s AS INTEGER), 1) AS letter,
             substr(filter_order, 1, CAST(s AS INTEGER) - 1) AS earlier
      FROM orders, (SELECT unnest(range(1, 6)) AS s)
    ), met AS (
      SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS now, fails = letter AS sole,
             translate(fails, earlier, '') <> fails AS gone
      FROM cells, steps
    ), counted AS (
      SELECT part, filter_order, step, letter,
        CAST(coalesce(sum(n) FILTER (NOT gone AND NOT now), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (NOT gone AND now), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (gone AND now), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (sole), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (NOT gone AND now), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (NOT gone AND now), 0) AS BIGINT) AS toxic_lost
      FROM met GROUP BY part, filter_order, step, letter
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM counted"""
