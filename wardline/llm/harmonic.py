"""Packing of tokenised documents into sequences by harmonic classes.

A class holds pieces of one reciprocal of the capacity, 4096 / k for k a power
of two, and each of its bins takes exactly k pieces.  Documents may be cut, so
a document's length is written as a sum of class sizes: bins are full to the
last token.  Workers fill their classes independently of each other; the
pieces that a worker has left in a class form shorter sequences whose lengths
are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Batches, emit, long_id, partition_count, rows_of_batches
from wardline.llm.tokens import encoder

CAPACITY = 4096
END = 2
SLOTS_OF_WORKER = 256

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64())])
_PIECES_DDL = "doc_id long, row_key long, start long, length int, ids_crc32 long, doc_tokens long"


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document: whole bins, then the binary digits of the rest, large to small."""
    return [capacity] * (tokens // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (tokens % capacity) >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document: its ids by the tokenizers library and the end id, cut by :func:`cut`."""
    def step(batches: Batches) -> Batches:
        tokens = encoder(vocabulary)
        for part in rows_of_batches(batches, size=1 << 20):
            ids, counts = tokens.encode(part["text"])
            tokens_of = counts + 1
            whole = memoryview(np.insert(ids, np.cumsum(counts), END).astype("<u4").tobytes())
            sizes = [cut(n, capacity) for n in tokens_of.tolist()]
            per_doc = np.fromiter(map(len, sizes), np.int64, len(sizes))
            length = np.fromiter(chain.from_iterable(sizes), np.int64, int(per_doc.sum()))
            ends = np.cumsum(length)
            at = (ends - length).tolist()
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at, ends.tolist(), strict=True)]
            of = np.repeat(np.arange(len(sizes)), per_doc)
            first = np.cumsum(tokens_of) - tokens_of
            yield emit(
                _PIECES, doc_id=np.asarray(part["doc_id"].combine_chunks())[of], row_key=np.asarray(part["row_key"].combine_chunks())[of],
                start=ends - length - first[of], length=length.astype(np.int32), ids_crc32=crc, doc_tokens=tokens_of[of])

    text = F.col(f"`{text_column}`").cast("string")
    chosen = docs.select(long_id(id_column, "doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
    return chosen.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(step, _PIECES_DDL)


def pack(cuts: DataFrame, capacity: int = CAPACITY, workers: int = 0, slots_of_worker: int = SLOTS_OF_WORKER) -> DataFrame:
    """Place pieces: adds sequence_id and offset.

    Rows are dealt to workers by a hash of the piece, numbered by class inside
    each worker, and every k in a row make a bin.  If ``cuts`` has _at (slot and
    place in a mix), a worker is a range of slots instead and numbers its pieces
    in their order, so sequence ids follow the mix range by range.  With m left over, the piece
    numbered t belongs to the sequence of 2**b pieces, b the highest bit in
    which t and m differ: so m's binary digits are the sequences' sizes.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    mixed = "_at" in cuts.columns
    if mixed:
        dealt = cuts.withColumn("worker", F.expr(f"_at.slot div {slots_of_worker}"))
    else:
        workers = workers or partition_count(cuts)
        dealt = cuts.withColumn("worker", F.pmod(F.xxhash64("row_key", F.expr("start div 1048576")), F.lit(workers)))
    group = W.partitionBy("worker", "length")
    numbered = dealt.withColumn("n", F.row_number().over(group.orderBy(*["_at"] * mixed, "doc_id", "row_key", "start")) - 1).withColumn(
        "rows", F.count("*").over(group))
    k = F.expr(f"{capacity} div length")
    placed = numbered.withColumn("k", k).withColumn("t", F.col("n") % F.col("k")).withColumn("full", F.expr("rows div k")).withColumn(
        "bin", F.expr("n div k")).withColumn("m", F.col("rows") % F.col("k"))
    differ = F.col("t").bitwiseXOR(F.col("m"))
    bit = F.floor(F.log2(F.greatest(differ, F.lit(1)).cast("double"))).cast("int")  # below 2**13: exact
    tail = F.col("bin") >= F.col("full")
    first = F.expr("CASE WHEN bin < full THEN 0L ELSE shiftleft(shiftright(m, bit + 1), bit + 1) END")
    placed = placed.withColumn("bit", F.when(tail, bit).otherwise(F.lit(0))).withColumn("first", first)
    # worker | class | number within the class: a tail's sequences count on from the full bins by their first piece
    class_no = F.log2(F.col("length").cast("double")).cast("long")
    within = F.col("bin") + F.when(tail, F.col("first")).otherwise(F.lit(0))
    sequence = F.shiftleft(F.col("worker").cast("long"), 40) + F.shiftleft(class_no, 35) + within.cast("long")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        sequence.alias("sequence_id"), ((F.col("t") - F.col("first")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    order: DataFrame | None = None, slots_of_worker: int = SLOTS_OF_WORKER,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    A null or empty text is one piece with the end id alone; rows without an id
    are left out; rows that repeat an id are documents of their own; an empty
    table gives no row.  With ``order`` (_id, _at of every id, see
    :func:`mixing.order_of`) sequences are numbered along the mix.
    """
    cuts = pieces(docs, vocabulary, id_column, text_column, capacity)
    if order is not None:
        cuts = cuts.join(order, cuts["doc_id"] == order["_id"]).drop("_id")
    return pack(cuts, capacity, slots_of_worker=slots_of_worker)
