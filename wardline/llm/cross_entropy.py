"""Scores of documents by cross-entropy difference between two matched language models.

Both models predict the next byte of a text from up to four bytes before it;
their shared vocabulary is the 256 byte values and an end symbol.  The target
model counts the documents marked as wanted, the background model counts all
documents; background counts are scaled to the target's size, so the two are
smoothed alike.  Each order from one to five bytes leans on the next shorter
one.  A token's loss is its negative log-probability, and a document's score is
the mean over its tokens of background loss minus target loss: the higher, the
more it reads like the target.

All counts are exact, whatever the size of the corpus.  Texts are packed into
chunks of a bounded size and written; a chunk carries its distinct strings of
five bytes with both models' counts, so one pass counts for both.  Sums by
string, and the shorter strings' sums from them, are ordinary aggregates, and a
token's loss depends on its string of five alone, so the models are one table
of losses by string.  It meets a chunk's strings in a join and the chunk's
texts in the task that scores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Batches, column_bytes, emit, long_id, materialize, partition_count, rows_of_batches, sorted_runs

BEFORE, END = 0xFE, 0xFF  # no byte of UTF-8
SYMBOLS = 257
ORDER = 5
STRENGTH = 8.0  # pseudo-counts of the shorter context
FLOOR = 0.5
CHUNK = 12 << 20  # bytes of texts that share one list of strings
PART = 2 << 20  # bytes of texts worked on at once

_PLACE_BITS = 24
_SEGMENT = 1 << _PLACE_BITS  # tokens whose places fit beside a string of five bytes in 64 bits


def token_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with 4 marks before each text and an end symbol after it, places of tokens, first token of each text)."""
    n, texts = len(data), len(at) - 1
    stream = np.full(n + 5 * texts, BEFORE, np.uint8)
    start = at[:-1] + 5 * np.arange(texts)
    token = np.ones(len(stream), bool)
    for k in range(4):
        token[start + k] = False
    own = token.copy()
    own[at[1:] + 5 * np.arange(texts) + 4] = False
    stream[own] = data
    stream[at[1:] + 5 * np.arange(texts) + 4] = END
    return stream, np.flatnonzero(token), at[:-1] + np.arange(texts)


def runs(stream: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(strings of five in order, first of each string's run, tokens by run) of up to 2**24 tokens at a time."""
    for lo in range(0, len(places), _SEGMENT):
        chosen = places[lo : lo + _SEGMENT]
        packed = np.zeros(len(chosen), np.uint64)
        for k in range(ORDER - 1, -1, -1):  # the last byte lowest
            packed = packed << np.uint64(8) | stream[chosen - k]
        packed = packed << np.uint64(_PLACE_BITS) | np.arange(len(chosen), dtype=np.uint64)
        packed.sort()
        string, token = packed >> np.uint64(_PLACE_BITS), (packed & np.uint64(_SEGMENT - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1])))
        yield string[start].astype(np.int64), start, lo + token


def _parts(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PART`` bytes, or of one longer text."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, min(int(np.searchsorted(at, at[lo] + PART, "right")) - 1, lo + PART))
        yield lo, hi
        lo = hi


_PIECE = pa.schema([
    ("chunk", pa.int64()), ("gram", pa.int64()), ("wanted", pa.int64()), ("seen", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary())])
_PIECE_DDL = "chunk long, gram long, wanted long, seen long, ids binary, texts binary"


def _packed(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    rows = pa.record_batch([ids, pa.array(np.diff(at), pa.int64())], names=["doc_id", "size"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes(), pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def _unpacked(ids: bytes, texts: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    rows = pa.ipc.open_stream(ids).read_all().combine_chunks()
    at = np.concatenate(([0], np.cumsum(rows["size"].to_numpy())))
    data = np.frombuffer(pa.decompress(texts, int(at[-1]), codec="zstd"), np.uint8) if at[-1] else np.zeros(0, np.uint8)
    return pa.concat_arrays(rows["doc_id"].chunks), data, at


def pieces(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text, wanted): a row of packed texts for each chunk, and a row for each of its strings of five.

    Chunks are numbered by the task that packs them, so the result must be
    written before it is read twice.
    """
    def pack(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(rows_of_batches(batches, size=CHUNK)):
            data, at = column_bytes(part["text"])
            wanted = np.asarray(part["wanted"].combine_chunks())
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in _parts(at):
                stream, places, _ = token_stream(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                chosen = np.repeat(wanted[lo:hi], np.diff(at[lo : hi + 1]) + 1).astype(np.int64)
                for string, start, token in runs(stream, places):
                    found.append((string, np.add.reduceat(chosen[token], start), np.diff(start, append=len(token))))
            gram, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            sums = []
            for column in (1, 2):
                total = np.zeros(len(gram), np.int64)
                np.add.at(total, where, np.concatenate([f[column] for f in found]))
                sums.append(total)
            chunk, none = np.full(len(gram), task + number), pa.nulls(len(gram), pa.binary())
            yield emit(_PIECE, chunk=chunk, gram=gram, wanted=sums[0], seen=sums[1], ids=none, texts=none)
            ids, texts = _packed(part["doc_id"].combine_chunks(), data, at)
            yield emit(_PIECE, chunk=[task + number], gram=[None], wanted=[None], seen=[None], ids=[ids], texts=[texts])

    return rows.mapInArrow(pack, _PIECE_DDL)


def models(counts: DataFrame) -> DataFrame:
    """gram, loss_target, loss_background of every string of five in ``counts`` (gram, wanted, seen).

    A string is a number of five bytes, the last one lowest: its ending is a
    remainder and what comes before its last byte a quotient by 256.  A context
    or an ending belongs to at most 257 strings of the next order.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        ending = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        levels[k] = levels[k + 1].groupBy(ending).agg(F.sum("wanted").alias("wanted"), F.sum("seen").alias("seen"))
    totals = levels[1].agg(F.sum("wanted").alias("wanted"), F.sum("seen").alias("seen")).first()
    n_target, n_background = float(totals.wanted or 0), float(totals.seen or 0)
    scale = F.lit(n_target / n_background if n_target and n_background else 1.0)
    size = {"wanted": F.lit(n_target), "seen": F.lit(n_background) * scale}
    ratio = {"wanted": F.lit(1.0), "seen": scale}

    model = levels[1].select("gram", *[
        ((F.col(c) * ratio[c] + FLOOR) / (size[c] + FLOOR * SYMBOLS)).alias(f"p_{c}") for c in ratio])
    for k in range(2, ORDER + 1):
        context = W.partitionBy(F.shiftright("gram", 8))
        here = levels[k].select("gram", *ratio, *[F.sum(c).over(context).alias(f"context_{c}") for c in ratio])
        here = here.withColumn("ending", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        model = here.join(model.withColumnRenamed("gram", "ending"), "ending").select("gram", *[
            ((F.col(c) * ratio[c] + STRENGTH * F.col(f"p_{c}")) / (F.col(f"context_{c}") * ratio[c] + STRENGTH)).alias(f"p_{c}")
            for c in ratio])
    return model.select("gram", (-F.log("p_wanted")).alias("loss_target"), (-F.log("p_seen")).alias("loss_background"))


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()),
    ("score", pa.float64())])


def _score(batches: Batches) -> Batches:
    """Scores of the texts of each chunk, whose row of texts comes first and whose strings follow in order."""
    for table in sorted_runs(batches, ["chunk"]):
        rows = np.flatnonzero(np.asarray(table["ids"].is_valid().combine_chunks()))
        for row, end in zip(rows.tolist(), [*rows.tolist()[1:], table.num_rows], strict=True):
            ids, data, at = _unpacked(table["ids"][row].as_py(), table["texts"][row].as_py())
            known = table.slice(row + 1, end - row - 1)
            gram, *models_losses = (known[c].to_numpy() for c in ("gram", "loss_target", "loss_background"))
            for lo, hi in _parts(at):
                stream, places, first = token_stream(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                n = np.diff(at[lo : hi + 1]) + 1
                token_loss = np.empty((2, len(places)))
                for string, start, token in runs(stream, places):
                    where = np.searchsorted(gram, string)
                    if len(string) and not (where[-1] < len(gram) and (gram[where] == string).all()):
                        raise RuntimeError("a chunk's strings are not all in the model")
                    lengths = np.diff(start, append=len(token))
                    for out, loss in zip(token_loss, models_losses, strict=True):
                        out[token] = np.repeat(loss[where], lengths)
                means = [np.add.reduceat(out, first) / n for out in token_loss]
                yield emit(
                    _OUT, doc_id=ids.slice(lo, hi - lo), n_tokens=n, loss_target=means[0], loss_background=means[1], score=means[1] - means[0])


def cross_entropy_difference(
    docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text_column: str = "text", wanted_column: str = "doc_id",
) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score: a row per row of ``docs``.

    ``wanted`` lists the ids of the target documents.  Counts cover all whole
    texts.  Null and empty texts are one token, the end; a null id is never
    wanted; repeated rows count as often as they stand; without any wanted
    document the target model knows nothing and gives every byte the same
    chance.  An empty table gives no row.

    A string's row stands at most once in a chunk, so the commonest string has
    as many rows as there are chunks, and so has every other common one.  The
    packed texts and the counts by string are written to the shared folder.
    """
    rows = docs.select(long_id(id_column, "doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    ids = wanted.select(long_id(wanted_column, "wanted_id")).where("wanted_id IS NOT NULL").distinct()
    # the ids grow with the corpus: a sort-merge join at every size
    marked = rows.join(ids.hint("merge"), F.col("doc_id") == F.col("wanted_id"), "left").select(
        "doc_id", "text", F.col("wanted_id").isNotNull().alias("wanted"))
    packed = materialize(pieces(marked), "cross-entropy-chunks")
    strings, texts = packed.where("gram IS NOT NULL"), packed.where("gram IS NULL")
    counts = materialize(strings.groupBy("gram").agg(F.sum("wanted").alias("wanted"), F.sum("seen").alias("seen")), "cross-entropy-counts")
    losses = strings.select("chunk", "gram").join(models(counts), "gram").select("chunk", "gram", "loss_target", "loss_background")
    both = losses.unionByName(texts.select("chunk", "ids", "texts"), allowMissingColumns=True)
    by_chunk = both.repartition(partition_count(docs), "chunk").sortWithinPartitions("chunk", F.col("gram").asc_nulls_first())
    return by_chunk.mapInArrow(_score, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
