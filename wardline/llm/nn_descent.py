"""Near-duplicate embeddings by NN-descent with exact link counts.

A neighbour graph starts from shared leaves of random-projection trees and is
refined by joins: what two neighbours of a vector have between them is
measured and replaces worse entries of their lists, until no list changes.
Lists hold only neighbours above a floor that lies as far below the threshold
as two links in a row can reach.  A list that is full of links may hide more
(it is saturated); lists are then enlarged to the whole cluster that the graph
connects, and clusters are measured block against block, so that every link
inside them counts.  A sample of vectors compared with all others, enlarged
until it holds enough true links, audits the recall; while it falls short, more
trees are added and the descent goes on.  A recall that stays short, or that
too few links stand for, is reported.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Batches, components, emit, long_id, materialize, mix64, partition_count, sorted_runs, star_edges

THRESHOLD = 0.98
TREES = 12
LEAF = 40  # vectors in a leaf, about
NEIGHBOURS = 12
MOST_ROUNDS = 8
BLOCK = 1024
AUDITED = 256  # vectors compared with all others at first; each further block is twice as large
MOST_AUDITED = 4096
EVIDENCE = 200  # true links that the audit asks for
RECALL = 0.99
LEAST_RECALL = 0.9


def _unit(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(row, vec_id, label, unit) of the rows that can link: unit is the vector scaled to length one, as packed doubles.

    ``row`` is the id; rows that repeat an id share it.
    """
    def step(batches: Batches) -> Batches:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("unit", pa.binary())])
        for part in batches:
            ids, labels, units = [], [], []
            for i, label, v in zip(*(part.column(n).to_pylist() for n in range(3)), strict=True):
                x = np.array(v, np.float64)
                with np.errstate(over="ignore"):
                    top = np.abs(x).max() if len(x) else 0.0
                    x = x / top if top > 0 else x  # so that squares neither overflow nor vanish
                    size = math.sqrt(float(x @ x))
                if size > 0 and math.isfinite(size):
                    ids.append(i)
                    labels.append(label)
                    units.append((x / size).tobytes())
            yield emit(schema, vec_id=ids, label=labels, unit=units)

    chosen = vectors.select(
        long_id(id_column, "vec_id"), F.col(f"`{label_column}`").cast("string").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return chosen.where(finite).mapInArrow(step, "vec_id long, label string, unit binary")


def _planes(width: int, tree: int, bits: int) -> np.ndarray:
    return np.random.default_rng([width, tree]).standard_normal((width, bits))


_LEAVES = pa.schema([("node", pa.int64()), ("unit", pa.binary()), ("leaf", pa.int64())])
_LISTS = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("cosine", pa.float64())])
_LISTS_DDL = "node long, near long, cosine double"


def _leaves(trees: range, bits: int):
    """Each vector once for each tree, with the leaf it falls into."""
    def step(batches: Batches) -> Batches:
        for part in batches:
            nodes, labels, units = (part.column(n).to_pylist() for n in range(3))
            of_label = np.array([xxhash.xxh64_intdigest(x) for x in labels], np.uint64)
            by_width: dict[int, list[int]] = {}
            for n, u in enumerate(units):
                by_width.setdefault(len(u) // 8, []).append(n)
            for width, at in by_width.items():
                x = _unit([units[n] for n in at])
                for tree in trees:
                    code = ((x @ _planes(width, tree, bits)) > 0) @ (1 << np.arange(bits))
                    leaf = mix64(mix64(of_label[at] + np.uint64(tree << 32 | width)) + code.astype(np.uint64)).view(np.int64)
                    yield emit(_LEAVES, node=[nodes[n] for n in at], unit=[units[n] for n in at], leaf=leaf)

    return step


def best_pairs(x: np.ndarray, floor: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): for each row its ``keep`` best others at or above ``floor``, block by block."""
    left, right, cosines = [], [], []
    for a in range(0, len(x), BLOCK):
        best_j = np.zeros((min(BLOCK, len(x) - a), 0), np.int64)
        best_c = np.zeros(best_j.shape)
        for b in range(0, len(x), BLOCK):
            c = x[a : a + BLOCK] @ x[b : b + BLOCK].T
            if a == b:
                np.fill_diagonal(c, -2)
            j = np.broadcast_to(np.arange(b, b + c.shape[1]), c.shape)
            best_c, best_j = np.concatenate((best_c, c), axis=1), np.concatenate((best_j, j), axis=1)
            if best_c.shape[1] > keep:
                top = np.argpartition(-best_c, keep - 1, axis=1)[:, :keep]
                best_c, best_j = np.take_along_axis(best_c, top, axis=1), np.take_along_axis(best_j, top, axis=1)
        i, k = np.nonzero(best_c >= floor)
        left.append(i + a)
        right.append(best_j[i, k])
        cosines.append(best_c[i, k])
    return np.concatenate(left), np.concatenate(right), np.concatenate(cosines)


def _within(group_column: str, floor: float, keep: int):
    """List entries among the vectors of each group of a sorted partition; a group may hold vectors of one length only."""
    def step(batches: Batches) -> Batches:
        for run in sorted_runs(batches, [group_column], size=2 << 20):
            group = np.asarray(run[group_column].combine_chunks())
            nodes = np.asarray(run["node"].combine_chunks())
            units = run["unit"].combine_chunks().to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            for a, b in zip(edge, np.append(edge[1:], len(group)), strict=True):
                if b - a > 1:
                    i, j, c = best_pairs(_unit(units[a:b]), floor, keep)
                    if len(i):
                        yield emit(_LISTS, node=nodes[a:b][i], near=nodes[a:b][j], cosine=c)

    return step


def _best(entries: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best entries of each list, each neighbour once."""
    once = entries.where("node <> near").groupBy("node", "near").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("cosine"), "near"))
    return once.withColumn("place", place).where(F.col("place") <= keep).drop("place")


_LINKS = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("links", pa.int64()), ("others", pa.int64())])
_LINKS_DDL = "node long, near long, links long, others long"


def _cluster_blocks(threshold: float):
    """Links between the vectors of two blocks of a cluster: sums by node (near is null), and edges enough to connect them."""
    keys = ["cluster", "low", "high"]

    def step(batches: Batches) -> Batches:
        for run in sorted_runs(batches, keys, size=2 << 20):
            cluster, low, high, nodes, block, copies = (
                np.asarray(run[c].combine_chunks()) for c in (*keys, "node", "block", "copies"))
            units = run["unit"].combine_chunks().to_pylist()
            change = (cluster[1:] != cluster[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            edge = np.flatnonzero(np.concatenate(([True], change)))
            for a, b in zip(edge, np.append(edge[1:], len(nodes)), strict=True):
                x, ids, times = _unit(units[a:b]), nodes[a:b], copies[a:b]
                one, other = block[a:b] == low[a], block[a:b] == high[a]
                near = x[one] @ x[other].T >= threshold
                if low[a] == high[a]:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                sums = [(ids[one], near @ times[other], near.sum(axis=1))]
                if low[a] != high[a]:
                    sums.append((ids[other], times[one] @ near, near.sum(axis=0)))
                for n, links, others in sums:
                    yield emit(_LINKS, node=n, near=[None] * len(n), links=links, others=others)
                p, q = star_edges(ids[one][i], ids[other][j])
                yield emit(_LINKS, node=p, near=q, links=[0] * len(p), others=[0] * len(p))

    return step


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    threshold: float = THRESHOLD, keep: int = NEIGHBOURS, trees: int = TREES,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors`` with an id.

    Vectors link if their labels are equal and not null, their lengths are the
    same and their cosine in doubles is at least ``threshold``.  Vectors that
    are null, empty or zero, or hold a null or non-finite component, and those
    without a label, have no links.  Equal vectors of one label are one node,
    whose copies link with each other and share their links.  Rows that repeat
    an id count as vectors of their own and each get a row.  An empty table
    gives no row.

    Recall is audited on up to ``MOST_AUDITED`` vectors, until they hold
    ``EVIDENCE`` true links.  If it is below ``RECALL`` when eight times
    ``trees`` have grown, or if fewer links were met, a warning says so; below
    ``LEAST_RECALL`` it is a RuntimeError.
    """
    rows = vectors.select(long_id(id_column, "vec_id")).where("vec_id IS NOT NULL")
    good = materialize(usable(vectors, id_column, vector_column, label_column), "vectors")
    key = F.xxhash64("label", "unit")
    classes = materialize(
        good.groupBy("label", "unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("node", key).withColumn("salted", F.xxhash64("unit", "label", F.lit(1))), "classes")
    n = classes.count()
    floor = 2 * threshold**2 - 1 if threshold > 0 else -1.0
    bits = max(1, min(24, math.ceil(math.log2(max(2, n / LEAF)))))
    vectors_of = classes.select("node", "label", "unit", "copies")
    width = partition_count(classes)
    truth, links, audited = _audit(classes, vectors_of, threshold)

    lists, grown = None, 0
    while True:
        leaves = vectors_of.select("node", "label", "unit").mapInArrow(_leaves(range(grown, grown + trees), bits), "node long, unit binary, leaf long")
        seeds = leaves.repartition(width, "leaf").sortWithinPartitions("leaf").mapInArrow(_within("leaf", floor, keep), _LISTS_DDL)
        grown += trees
        lists = materialize(_best(seeds if lists is None else seeds.unionByName(lists), keep), "lists")
        lists = _descend(lists, vectors_of, floor, keep, width)
        counts, edges = _measure(lists, vectors_of, threshold, width)
        recall = _recall(truth, counts)
        if recall >= RECALL or grown >= 8 * trees:
            break
    _report(recall, links, audited, n)

    # from nodes back to vectors: copies link with each other and with all copies of linked nodes
    found = components(edges)
    per_node = classes.select("node", "copies", "first").join(counts, "node", "left").join(
        found.withColumnRenamed("component", "cluster"), "node", "left").select(
        "node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("cluster", "node").alias("cluster"))
    per_node = materialize(per_node, "nodes")
    named = per_node.groupBy("cluster").agg(F.min("first").alias("component_id"))
    linked = good.select("vec_id", key.alias("node")).join(per_node.join(named, "cluster").select("node", "n_links", "component_id"), "node")
    lonely = rows.groupBy("vec_id").count().join(linked.groupBy("vec_id").agg(F.count("*").alias("used")), "vec_id", "left").select(
        "vec_id", F.explode(F.array_repeat(F.lit(0), (F.col("count") - F.coalesce("used", F.lit(0))).cast("int"))).alias("none"))
    result = linked.select("vec_id", "n_links", "component_id").unionByName(
        lonely.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return result.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _descend(lists: DataFrame, vectors_of: DataFrame, floor: float, keep: int, width: int) -> DataFrame:
    """Rounds of the join of neighbours of neighbours, until the lists stay as they are."""
    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("node", "near").cast("decimal(38,0)"))).first()

    now = state(lists)
    for _ in range(MOST_ROUNDS):
        # around each centre: the vectors on its list and those that list it; lists are short, but a centre may be
        # on many: they are dealt to groups of a bounded size, each with the centre's own list
        out_of = lists.select(F.col("node").alias("centre"), F.col("near").alias("member"))
        into = lists.select(F.col("near").alias("centre"), F.col("node").alias("member"))
        crowd = into.groupBy("centre").agg(F.count("*").alias("n")).withColumn("parts", F.expr(f"(n + {4 * keep - 1}) div {4 * keep}"))
        part_of = into.join(crowd, "centre").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
        own = out_of.join(crowd, "centre", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        members = part_of.select("centre", "part", "member").unionByName(own.select("centre", "part", "member")).distinct()
        around = members.withColumn("around", F.xxhash64("centre", "part")).join(
            vectors_of.select(F.col("node").alias("member"), "unit"), "member").select("around", F.col("member").alias("node"), "unit")
        fresh = around.repartition(width, "around").sortWithinPartitions("around").mapInArrow(_within("around", floor, keep), _LISTS_DDL)
        lists = materialize(_best(lists.unionByName(fresh), keep), "lists")
        before, now = now, state(lists)
        if before == now:
            break
    return lists


def _measure(lists: DataFrame, vectors_of: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(node, links in vectors) and connecting (a, b), from every pair inside the clusters that the lists connect."""
    clusters = components(lists.select(F.col("node").alias("a"), F.col("near").alias("b")))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    placed = clusters.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # block b is in the tiles (a, b) and (b, c): every pair of blocks once
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    keys = ["cluster", "low", "high"]
    dealt = tiles.withColumnRenamed("component", "cluster").join(vectors_of.select("node", "unit", "copies"), "node").select(
        *keys, "block", "node", "copies", "unit")
    measured = materialize(
        dealt.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(_cluster_blocks(threshold), _LINKS_DDL), "links")
    counts = measured.where("near IS NULL").groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    return counts, measured.where("near IS NOT NULL").select(F.col("node").alias("a"), F.col("near").alias("b"))


def _audit(classes: DataFrame, vectors_of: DataFrame, threshold: float) -> tuple[DataFrame, int, int]:
    """((node, truth) of the audited nodes, their true links, their number): growing blocks in hashed order against all vectors."""
    after, links, audited, truth, size = None, 0, 0, None, AUDITED
    while truth is None or (links < EVIDENCE and audited < MOST_AUDITED):
        left = classes if after is None else classes.where(F.col("salted") > after)
        block = left.select("node", "label", "unit", "salted").orderBy("salted").limit(size).collect()
        if truth is not None and not block:
            break
        found = materialize(_true_links(block, vectors_of, threshold), "audit")
        truth = found if truth is None else truth.unionByName(found)
        links += found.agg(F.sum("truth")).first()[0] or 0
        audited += len(block)
        if len(block) < size:
            break
        after, size = block[-1]["salted"], min(2 * size, MOST_AUDITED - audited)
    return truth, links, audited


def _true_links(block: list, vectors_of: DataFrame, threshold: float) -> DataFrame:
    """(node, truth): links of the nodes of a block, whose size is bounded, by comparing them with all vectors."""
    by_label: dict[tuple[str, int], tuple[list[int], list[bytes]]] = {}
    for r in block:
        ids, units = by_label.setdefault((r["label"], len(r["unit"])), ([], []))
        ids.append(r["node"])
        units.append(bytes(r["unit"]))
    ready = {k: (ids, _unit(units)) for k, (ids, units) in by_label.items()}
    schema = pa.schema([("node", pa.int64()), ("truth", pa.int64())])

    def step(batches: Batches) -> Batches:
        for part in batches:
            nodes, labels, units = (part.column(n).to_pylist() for n in range(3))
            at: dict[tuple[str, int], list[int]] = {}
            for n, (label, u) in enumerate(zip(labels, units, strict=True)):
                at.setdefault((label, len(u)), []).append(n)
            for k, those in at.items():
                if k in ready:
                    ids, q = ready[k]
                    near = (q @ _unit([units[n] for n in those]).T) >= threshold
                    near &= np.array(ids)[:, None] != np.array([nodes[n] for n in those])[None]
                    yield emit(schema, node=ids, truth=near.sum(axis=1))

    return vectors_of.select("node", "label", "unit").mapInArrow(step, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def _recall(truth: DataFrame, counts: DataFrame) -> float:
    """Found share of the true links; 1 where there are none."""
    both = truth.join(counts, "node", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("others", F.lit(0))))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def _report(recall: float, links: int, audited: int, nodes: int) -> None:
    """Say what an audit cannot vouch for; an audit of all nodes is complete with any number of links."""
    met = f"{audited} of {nodes} audited vectors hold {links} links"
    if recall < LEAST_RECALL:
        raise RuntimeError(f"near-duplicate search found {recall:.3f} of the true links ({met}); grow more trees")
    if recall < RECALL:
        warnings.warn(f"near-duplicate search found {recall:.3f} of the true links ({met})", stacklevel=3)
    elif links < EVIDENCE and audited < nodes:
        warnings.warn(f"recall of the near-duplicate search rests on few links: {met}", stacklevel=3)


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows by comparing every pair of a label, as DuckDB SQL."""
    return f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= {threshold}
    ), reach AS (
      SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION
      SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT n.vec_id, (SELECT count(*) FROM links WHERE links.a = n.vec_id) AS n_links, n.component_id, n.vec_id = n.component_id AS kept
    FROM named n"""
