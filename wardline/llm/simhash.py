"""Near-duplicates by SimHash fingerprints, searched through deletion variants of segments.

Two fingerprints of 64 bits that differ in at most ``MOST`` = 4 bits, cut into
three segments, differ by at most one bit in one of them.  So every segment is
indexed under each of its variants with one bit replaced by a wildcard, equal
variants meet, and the whole fingerprints are compared.  Only distinct
fingerprints take part, so a crowd of copies is one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Batches, components, emit, long_id, materialize, mix64, partition_count, rows_of_batches, sorted_runs, star_edges

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width of each
MOST = 4
SHINGLE = 4
SEED = 42

_BITS_AT_ONCE = 4096  # shingles whose bits are unpacked together


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: a bit is 1 if set in over half the shingle hashes.

    ASCII letters are lower-cased, words are runs of anything but ASCII white
    space.  A text of fewer words is one shingle; one of none has fingerprint 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[k : k + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long.  Rows without an id are left out."""
    def step(batches: Batches) -> Batches:
        for part in batches:
            texts = part.column(1).cast(pa.binary()).to_pylist()
            prints = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield emit(_PRINTS, doc_id=part.column(0), fp=prints.view(np.int64))

    chosen = docs.select(long_id(id_column, "doc_id"), F.col(f"`{text_column}`").alias("text")).where("doc_id IS NOT NULL")
    return chosen.mapInArrow(step, "doc_id long, fp long")


def variant_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the one-wildcard segment variants of ``fps``, and for each the index of its fingerprint."""
    keys = []
    for n, (first, width) in enumerate(SEGMENTS):
        segment = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            keys.append((segment & ~np.uint64(1 << bit)) | np.uint64((n << 5 | bit) << 32))
    return np.concatenate(keys), np.tile(np.arange(len(fps)), len(keys))


_VARIANTS = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _spread(buckets: int):
    """Variants of a batch as one packed row for each bucket: sorted by key, 16 bytes a variant."""
    def step(batches: Batches) -> Batches:
        for part in rows_of_batches(batches, size=1 << 17):  # 16,384 fingerprints, a million variants
            fps = np.asarray(part["fp"].combine_chunks()).view(np.uint64)
            keys, of = variant_keys(fps)
            bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed = np.stack((keys[order], fps[of[order]]), axis=1)
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            starts = np.concatenate(([0], ends[:-1]))
            full = np.flatnonzero(ends > starts)
            yield emit(_VARIANTS, bucket=full.astype(np.int32), pairs=[packed[a:b].tobytes() for a, b in zip(starts[full], ends[full], strict=True)])

    return step


def close_pairs(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that share a key and differ in at most ``most`` bits.

    The entries are sorted by key; entry i meets entry i + lag as long as any
    run of equal keys is longer than the lag, so memory stays in proportion to
    the entries.  Found links are thinned to a spanning forest on the way.
    """
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    live = np.arange(len(keys))
    left, right, held = [], [], 0
    for lag in range(1, len(keys)):
        live = live[live + lag < len(keys)]
        live = live[keys[live] == keys[live + lag]]
        if not len(live):
            break
        x, y = fps[live], fps[live + lag]
        near = (np.bitwise_count(x ^ y) <= most) & (x != y)
        if near.any():
            left.append(x[near])
            right.append(y[near])
            held += len(left[-1])
            if held > 4_000_000:
                a, b = star_edges(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return star_edges(np.concatenate(left), np.concatenate(right))


def _meet(most: int):
    def step(batches: Batches) -> Batches:
        for part in sorted_runs(batches, ["bucket"], size=1 << 20):
            buckets = np.asarray(part["bucket"].combine_chunks())
            pairs = part["pairs"].combine_chunks()
            pairs = pairs.to_pylist() if pairs else []
            for b in np.unique(buckets):
                at = np.flatnonzero(buckets == b)
                packed = np.frombuffer(b"".join(pairs[i] for i in at), np.uint64).reshape(-1, 2)
                x, y = close_pairs(packed[:, 0], packed[:, 1], most)
                if len(x):
                    yield emit(_EDGES, a=x.view(np.int64), b=y.view(np.int64))

    return step


def near_fingerprints(distinct: DataFrame, most: int = MOST, per_bucket: int = 200_000) -> DataFrame:
    """(a, b): links enough to connect what differs in at most ``most`` bits, of the distinct longs in ``fp``."""
    if most > 5:  # 3 segments leave one with a single difference up to 5
        raise ValueError("three segments find at most 5 differing bits")
    distinct = materialize(distinct.select("fp"), "fingerprints")
    n = distinct.count()
    width = partition_count(distinct)
    buckets = max(width, -(-n * 64 // per_bucket))
    spread = distinct.mapInArrow(_spread(buckets), "bucket int, pairs binary")
    return spread.repartition(max(width, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(most), "a long, b long")


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MOST, shingle: int = SHINGLE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links).

    Null and empty texts have fingerprint zero and link like any other; rows
    without an id are left out; a repeated id gives a row for each of its rows;
    an empty table gives no row.
    """
    prints = materialize(fingerprints(docs, id_column, text_column, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(near_fingerprints(classes, most))
    # the group's number is a fingerprint: its smallest document names the component
    joined = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "groups")
    named = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = joined.join(named, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MOST, shingle: int = SHINGLE,
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group (of repeated ids, every row), and those without an id."""
    groups = simhash_groups(docs, id_column, text_column, most, shingle)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, docs[id_column].cast("long") == copies["_copy"], "left_anti")
