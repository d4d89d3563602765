"""Token files under a static range asymmetric numeral system.

A file row is a segment: documents' ids in ascending order of their numbers, a
frequency table that the segment's blocks share, and blocks that decode
independently of each other.  Inside a block token t belongs to lane t mod
``LANES``, and the lanes' words are interleaved in decoding order.  Every
``CHECKPOINT`` steps a block holds the lanes' states and its place among the
words, so decoding can begin there as well; all such stretches decode side by
side.  Each block carries a checksum, and so do a segment's tables, ids and sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Batches, emit, long_id, partition_count, rows_of_batches
from wardline.llm.tokens import encoder

END = 2
LANES = 64
STEPS = 1024  # of a full block
CHECKPOINT = 256
SEGMENT = 2_000_000  # ids after which a segment ends with its document
PRECISION = 20
BYTES_IN_PART = 16 << 20
BYTES_AT_ONCE = 4 << 20  # of text to the encoder, which looks up each distinct piece of them once

_M = 1 << PRECISION
_LOW = np.uint64(1 << 31)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Counts of the 65,536 possible ids scaled to a sum of 2**PRECISION; what occurs keeps one at least."""
    counts = np.bincount(ids, minlength=1 << 16).astype(np.int64)
    seen = counts > 0
    scaled = np.where(seen, np.maximum(1, counts * _M // max(1, int(counts.sum()))), 0)
    over = int(scaled.sum()) - _M
    if over <= 0:
        scaled[np.argmax(scaled)] -= over
        return scaled
    for k in np.argsort(-scaled, kind="stable"):  # take from the most frequent what rounding up has added
        take = min(over, int(scaled[k]) // 2)
        scaled[k] -= take
        over -= take
        if not over:
            return scaled
    raise ValueError("too many different ids for the precision")


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(words, states at checkpoints, word places at checkpoints) of each block; ids are blocks x steps x lanes."""
    blocks, steps, lanes = ids.shape
    cum = np.cumsum(freq) - freq
    f_of, c_of = freq.astype(np.uint64), cum.astype(np.uint64)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words = np.empty((steps, blocks, lanes), np.uint32)
    out = np.empty((steps, blocks, lanes), bool)
    marks = np.empty((-(-steps // CHECKPOINT), blocks, lanes), np.uint64)
    for s in range(steps - 1, -1, -1):
        symbols = ids[:, s, :]
        f = f_of[symbols]
        full = x >= f << np.uint64(63 - PRECISION)
        out[s], words[s] = full, x.astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(PRECISION)) + (x - q * f) + c_of[symbols]
        if s % CHECKPOINT == 0:
            marks[s // CHECKPOINT] = x
    before = np.cumsum(out.sum(axis=2), axis=0) - out.sum(axis=2)
    return (
        [words[:, b][out[:, b]] for b in range(blocks)], [marks[:, b] for b in range(blocks)],
        [before[::CHECKPOINT, b].astype(np.uint32) for b in range(blocks)])


def decode_stretches(
    words: np.ndarray, states: np.ndarray, places: np.ndarray, steps: int, freq: np.ndarray, symbol_of: np.ndarray,
) -> np.ndarray:
    """Ids (stretches x steps x lanes) from the lanes' states and the places of their next words."""
    cum = (np.cumsum(freq) - freq).astype(np.uint64)
    f_of = freq.astype(np.uint64)
    x, at = states.copy(), places.astype(np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)  # lanes that need no word may look past the end
    out = np.empty((len(x), steps, x.shape[1]), np.uint16)
    for s in range(steps):
        slot = x & np.uint64(_M - 1)
        symbols = symbol_of[slot.astype(np.int64)]
        out[:, s] = symbols
        x = f_of[symbols] * (x >> np.uint64(PRECISION)) + slot - cum[symbols]
        need = x < _LOW
        upto = np.cumsum(need, axis=1)
        word = words[np.minimum(at[:, None] + upto - 1, len(words) - 1) * need]
        x = np.where(need, x << np.uint64(32) | word, x)
        at += upto[:, -1]
    return out


_SEGMENT = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_sizes", pa.binary()),
    ("symbols", pa.binary()), ("frequencies", pa.binary()), ("block_steps", pa.binary()), ("words", pa.list_(pa.binary())),
    ("states", pa.list_(pa.binary())), ("places", pa.list_(pa.binary())), ("checksums", pa.list_(pa.int64()))])
_SEGMENT_DDL = (
    "shard int, segment int, n_tokens long, doc_ids binary, doc_sizes binary, symbols binary, frequencies binary, block_steps binary, "
    "words array<binary>, states array<binary>, places array<binary>, checksums array<long>")


def _checksum(*parts: bytes) -> int:
    crc = 0
    for p in parts:
        crc = zlib.crc32(p, crc)
    return crc


#: What a segment holds besides its blocks; the last checksum covers it.
_FRAME = ("doc_ids", "doc_sizes", "symbols", "frequencies", "block_steps")


def _frame_checksum(shard: int, segment: int, n_tokens: int, parts: list[bytes]) -> int:
    sizes = np.array([shard, segment, n_tokens, *map(len, parts)], "<i8").tobytes()
    return _checksum(sizes, *parts)


def encode_segment(shard: int, segment: int, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    freq = frequencies(ids)
    used = np.flatnonzero(freq)
    full = len(ids) // (STEPS * LANES)
    rest = ids[full * STEPS * LANES :]
    words, states, places, steps = [], [], [], []
    groups = []
    if full:
        groups.append(ids[: full * STEPS * LANES].reshape(full, STEPS, LANES))
    if len(rest):
        rows = -(-len(rest) // LANES)
        groups.append(np.append(rest, np.full(rows * LANES - len(rest), np.argmax(freq), ids.dtype)).reshape(1, rows, LANES))
    for group in groups:
        w, s, p = encode_blocks(group, freq)
        words += [a.astype("<u4").tobytes() for a in w]
        states += [a.astype("<u8").tobytes() for a in s]
        places += [a.astype("<u4").tobytes() for a in p]
        steps += [group.shape[1]] * len(w)
    frame = [
        docs.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), used.astype("<u2").tobytes(), freq[used].astype("<u4").tobytes(),
        np.array(steps, "<u2").tobytes()]
    sums = [_checksum(*x) for x in zip(words, states, places, strict=True)] + [_frame_checksum(shard, segment, len(ids), frame)]
    return emit(
        _SEGMENT, shard=[shard], segment=[segment], n_tokens=[len(ids)], **{name: [part] for name, part in zip(_FRAME, frame, strict=True)},
        words=[words], states=[states], places=[places], checksums=[sums])


def decode_segment(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, their numbers of tokens, all token ids) of a file row; raises if a checksum is off."""
    frame = [row[name] for name in _FRAME]
    blocks = len(row["words"])
    if len(row["checksums"]) != blocks + 1 or row["checksums"][-1] != _frame_checksum(row["shard"], row["segment"], row["n_tokens"], frame):
        raise ValueError(f"the tables of segment {row['shard']}/{row['segment']} are damaged")
    if sum(np.frombuffer(row["doc_sizes"], "<u8").tolist()) != row["n_tokens"] or len(row["block_steps"]) != 2 * blocks:
        raise ValueError(f"the sizes of segment {row['shard']}/{row['segment']} do not add up")
    for k, parts in enumerate(zip(row["words"], row["states"], row["places"], strict=True)):
        if _checksum(*parts) != row["checksums"][k]:
            raise ValueError(f"block {k} of segment {row['shard']}/{row['segment']} is damaged")
    freq = np.zeros(1 << 16, np.int64)
    freq[np.frombuffer(row["symbols"], "<u2")] = np.frombuffer(row["frequencies"], "<u4")
    symbol_of = np.repeat(np.arange(1 << 16, dtype=np.uint16), freq)
    steps = np.frombuffer(row["block_steps"], "<u2").astype(np.int64)
    words = [np.frombuffer(w, "<u4") for w in row["words"]]
    base = np.cumsum([0] + [len(w) for w in words])[:-1]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    states, places, length, block = [], [], [], []
    for k, n in enumerate(steps.tolist()):
        marks = -(-n // CHECKPOINT)
        states.append(np.frombuffer(row["states"][k], "<u8").reshape(marks, LANES))
        places.append(np.frombuffer(row["places"][k], "<u4").astype(np.int64) + base[k])
        length += [min(CHECKPOINT, n - CHECKPOINT * m) for m in range(marks)]
    ids = np.zeros(0, np.uint16)
    if states:
        x, at, length = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.array(length)
        begin = np.cumsum(length) - length
        ids = np.empty((int(length.sum()), LANES), np.uint16)
        for n in np.unique(length):
            those = np.flatnonzero(length == n)
            found = decode_stretches(flat, x[those], at[those], int(n), freq, symbol_of)
            ids[(begin[those][:, None] + np.arange(n)).ravel()] = found.reshape(-1, LANES)
        ids = ids.ravel()[: row["n_tokens"]]
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_sizes"], "<u8").astype(np.int64), ids


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of all documents to ``path``: shards in ascending order of doc_id, each in segments.

    A null text counts as empty; every document ends with id ``END``; rows
    without an id are left out; rows of one id follow in the order of their
    texts' hashes.
    """
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        tokens, shard, segment = encoder(vocabulary), TaskContext.get().partitionId(), 0
        docs_held, sizes_held, ids_held, held = [], [], [], 0
        for part in rows_of_batches(batches, size=BYTES_AT_ONCE):
            ids, sizes = tokens.encode(part["text"])
            ids = np.insert(ids, np.cumsum(sizes), END)
            docs_held.append(np.asarray(part["doc_id"].combine_chunks()))
            sizes_held.append(sizes + 1)
            ids_held.append(ids)
            held += len(ids)
            if held >= SEGMENT:
                yield encode_segment(shard, segment, *(np.concatenate(x) for x in (docs_held, sizes_held, ids_held)))
                docs_held, sizes_held, ids_held, held, segment = [], [], [], 0, segment + 1
        if held:
            yield encode_segment(shard, segment, *(np.concatenate(x) for x in (docs_held, sizes_held, ids_held)))

    rows = docs.select(long_id(id_column, "doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partition_count(docs), -(-total // BYTES_IN_PART))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(step, _SEGMENT_DDL).write.option("compression", "none").parquet(path)


_DOCS = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64())])


def _decode(batches: Batches) -> Batches:
    for batch in batches:
        for row in batch.to_pylist():
            docs, sizes, ids = decode_segment(row)
            wide = ids.astype("<u4").tobytes()
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield emit(
                _DOCS, shard=[row["shard"]] * n, segment=[row["segment"]] * n, doc_id=docs, inside=ends - sizes, n_tokens=sizes, ids_crc32=crc)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``.

    ``start`` is the number of ids in all documents before it: those of shards
    and segments before, from the rows' sizes alone, and those in its segment.
    """
    files = spark.read.schema(_SEGMENT_DDL).parquet(path)
    found = files.mapInArrow(_decode, "shard int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("shard", "segment", "n_tokens")
    before = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("size")).select(
        "shard", F.coalesce(F.sum("size").over(before(W.orderBy("shard"))), F.lit(0)).alias("shard_start"))  # a row per shard
    segments = sizes.select(
        "shard", "segment", F.coalesce(F.sum("n_tokens").over(before(W.partitionBy("shard").orderBy("segment"))), F.lit(0)).alias("base"))
    base = segments.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("shard_start")).alias("base"))
    return found.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
