"""Removal of long repeated passages with suffix arrays, exact to the byte.

Every string of ``LENGTH`` bytes has an anchor: its leftmost stretch of
``ANCHOR`` bytes with the smallest hash.  Equal strings have equal anchors at
equal distances, so strings need comparing only inside the groups of one
anchor.  Consecutive strings with the same anchor in the same place of a text
form one piece.  Pieces of a group with equal bytes need no comparison: all
but the earliest are repeats.  What is left, groups with different pieces, is
joined with its bytes, and a suffix array of each group's distinct pieces
(``suffix_groups``) tells which strings inside them are equal.

All texts pass through arrays a few MB at a time; equal pieces are combined
before each shuffle, and the rest travels packed by hash buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.llm.common import (
    Batches, PolynomialHash, column_bytes, emit, materialize, mix64, partition_count, rows_of_batches, sorted_runs,
    take_columns,
)
from wardline.llm.suffix_groups import suffix_arrays

LENGTH = 100
ANCHOR = 32
BATCH = 1 << 19  # bytes of text in arrays at a time
SORTED_AT_ONCE = 1 << 18  # symbols of many groups in one call
CROWDED = 4096  # distinct pieces of an anchor from which its strings are grouped one by one

_REPEATS = 1 << 16  # rows of one id


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i (near the end over what is there)."""
    k = 1
    while 2 * k <= width:
        x = np.concatenate((pick(x[:-k], x[k:]), x[len(x) - k :])) if len(x) > k else x
        k *= 2
    if k < width and len(x) > width - k:
        x = np.concatenate((pick(x[: k - width], x[width - k :]), x[len(x) - (width - k) :]))
    return x


class Pieces:
    """Finds the pieces of a batch of texts."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor = length, anchor
        self.one, self.two = PolynomialHash(), PolynomialHash(0xD6E8FEB86659FD93)

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, content hash, text number, start in ``data``, end, anchor's distance) of each piece.

        The content hash covers the piece's bytes and the anchor's place in it.
        """
        n, k, width = len(data), self.anchor, self.length - self.anchor + 1
        lengths = np.diff(at)
        if n < self.length or lengths.max(initial=0) < self.length:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
        prefix = self.one.prefix(data)
        hashes = mix64((prefix[k:] - prefix[:-k]) * self.one._down[: n - k + 1])
        least = _slide(hashes, width, np.minimum)
        whole = np.arange(n - k + 1) + self.length <= np.repeat(at[1:], lengths)[: n - k + 1]
        least[~whole] = 0
        chosen = np.flatnonzero(_slide(least[::-1], width, np.maximum)[::-1] == hashes)

        def anchor_of(p: np.ndarray) -> np.ndarray:
            rank = np.searchsorted(chosen, p)
            while True:
                off = hashes[chosen[rank]] != least[p]
                if not off.any():
                    return chosen[rank]
                rank[off] += 1

        change = np.concatenate(([True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])))
        start = np.flatnonzero(change)
        last = np.append(start[1:], len(least)) - 1
        start, last = start[whole[start]], last[whole[start]]
        head, tail = anchor_of(start), anchor_of(last)
        tied = head != tail  # the smallest hash comes again: string by string
        if tied.any():
            counts = (last - start + 1)[tied]
            each = np.repeat(start[tied] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            start = np.concatenate((start[~tied], each))
            last = np.concatenate((last[~tied], each))
            tail = np.concatenate((tail[~tied], anchor_of(each)))
            order = np.argsort(start, kind="stable")
            start, last, tail = start[order], last[order], tail[order]
        end = last + self.length
        left = tail - start
        content = self.two.spans(self.two.prefix(data), start, end) ^ mix64(left.astype(np.uint64) + np.uint64(1))
        text = np.searchsorted(at, start, side="right") - 1
        return least[start], content, text, start, end, left


def first_of_equal(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an entry is the earliest by (doc, start) of those with its keys."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    first = np.empty(len(order), bool)
    first[order] = new
    return first


# --- packed rows: (bucket, kind, data), data an array of one of these --------------------------------------------

PIECE = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4"), ("left", "<i2")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
_PACKED_DDL = "bucket int, kind tinyint, data binary"
_WHOLE, _REPEAT, _WANTED = 0, 1, 2


def _packed(kind: int, rows: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    cuts = [*edge.tolist(), len(rows)]
    yield emit(
        _PACKED, bucket=bucket[edge].astype(np.int32), kind=[kind] * len(edge),
        data=[rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans, those of a document that touch or overlap joined."""
    if not len(doc):
        return np.zeros(0, SPAN)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start[order].astype(np.int64) + size[order])
    step = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1]))) << 40
    reach = np.maximum.accumulate(end + step)
    new = np.concatenate(([True], start[1:] + step[1:] > reach[:-1]))
    edge = np.flatnonzero(new)
    out = np.empty(len(edge), SPAN)
    out["doc"], out["start"] = doc[edge], start[edge]
    out["size"] = reach[np.append(edge[1:], len(doc)) - 1] - step[edge] - start[edge]
    return out


def _find(buckets: int, doc_buckets: int, length: int):
    """Texts to packed pieces, by anchor, and packed repeats, by document."""
    def step(batches: Batches) -> Batches:
        finder = Pieces(length)
        for part in rows_of_batches(batches, size=BATCH):
            data, at = column_bytes(part["text"])
            ids = np.asarray(part["doc_id"].combine_chunks())
            anchor, content, text, start, end, left = finder.of(data, at)
            rows = np.empty(len(anchor), PIECE)
            rows["anchor"], rows["content"], rows["doc"], rows["left"] = anchor, content, ids[text], left
            rows["start"], rows["size"] = start - at[text], end - start
            first = first_of_equal((rows["anchor"], rows["content"]), rows["doc"], rows["start"])
            again = rows[~first]
            spans = _spans(again["doc"], again["start"], again["size"])
            yield from _packed(_REPEAT, spans, buckets + _bucket(spans["doc"], doc_buckets))
            rows = rows[first]
            yield from _packed(_WHOLE, rows, _bucket(rows["anchor"], buckets))

    return step


def _compare(buckets: int, doc_buckets: int, crowded: int):
    """Packed pieces of an anchor to repeats and to wanted pieces (of groups with different contents), by document."""
    def step(batches: Batches) -> Batches:
        for run in sorted_runs(batches, ["bucket"], size=1 << 20):
            numbers = np.asarray(run["bucket"].combine_chunks())
            kinds = np.asarray(run["kind"].combine_chunks())
            data = run["data"].combine_chunks().to_pylist()
            passed = numbers >= buckets
            if passed.any():
                yield emit(_PACKED, bucket=numbers[passed] - buckets, kind=kinds[passed], data=[d for d, p in zip(data, passed, strict=True) if p])
            for b in np.unique(numbers[~passed]):
                rows = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(numbers == b)), PIECE)
                anchors, of, count = np.unique(rows["anchor"], return_inverse=True, return_counts=True)
                rows = rows[count[of] > 1]
                first = first_of_equal((rows["anchor"], rows["content"]), rows["doc"], rows["start"])
                again = rows[~first]
                spans = _spans(again["doc"], again["start"], again["size"])
                yield from _packed(_REPEAT, spans, _bucket(spans["doc"], doc_buckets))
                rows = rows[first]
                anchors, of, count = np.unique(rows["anchor"], return_inverse=True, return_counts=True)
                wanted = rows[count[of] > 1].copy()
                crowd = count[of][count[of] > 1]
                wanted["content"] = crowd > crowded
                yield from _packed(_WANTED, wanted, _bucket(wanted["doc"], doc_buckets))

    return step


def _texts_and_marks(run: pa.Table, kind: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the run's texts, their offsets, their ids, packed rows of a kind)."""
    kinds = np.asarray(run["kind"].combine_chunks())
    packed = run.filter(pa.array(kinds == kind))["data"].to_pylist() if kind != _WHOLE else []
    texts = run.filter(pa.array(kinds == _WHOLE))
    data, at = column_bytes(texts["data"])
    return data, at, np.asarray(texts["doc_id"].combine_chunks()), np.frombuffer(b"".join(packed), dtype)


def _locate(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, kind="stable")
    return order[np.searchsorted(ids[order], wanted)]


_BYTES = pa.schema([
    ("bucket", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("left", pa.int16()), ("piece", pa.binary())])
_BYTES_DDL = "bucket int, key long, doc long, start int, left smallint, piece binary"


def _fetch(buckets: int, length: int):
    """The bytes of wanted pieces; a crowded anchor's pieces are taken apart into strings keyed by their own hash.

    Equal strings of one batch go on as the earliest alone and as repeats.
    """
    def step(batches: Batches) -> Batches:
        hashes = PolynomialHash(0xA0761D6478BD642F)
        for run in sorted_runs(batches, ["bucket"], size=BATCH):
            data, at, ids, wanted = _texts_and_marks(run, _WANTED, PIECE)
            if not len(wanted):
                continue
            begin = at[:-1][_locate(ids, wanted["doc"])] + wanted["start"]
            crowd = wanted["content"] > 0
            rows = [(wanted["anchor"][~crowd], wanted["doc"][~crowd], wanted["start"][~crowd], wanted["left"][~crowd], begin[~crowd], wanted["size"][~crowd])]
            if crowd.any():
                some, b = wanted[crowd], begin[crowd]
                strings = some["size"].astype(np.int64) - length + 1
                shift = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
                b = np.repeat(b, strings) + shift
                key = hashes.spans(hashes.prefix(data), b, b + length)
                left = (np.repeat(some["left"], strings) - shift).astype(np.int16)
                doc, start = np.repeat(some["doc"], strings), (np.repeat(some["start"], strings) + shift).astype(np.int32)
                first = first_of_equal((key,), doc, start)
                again = _spans(doc[~first], start[~first], np.full(int((~first).sum()), length))
                yield emit(
                    _BYTES, bucket=[buckets] * len(again), key=again["size"].astype(np.int64), doc=again["doc"], start=again["start"],
                    left=[0] * len(again), piece=[b""] * len(again))
                rows.append((key[first], doc[first], start[first], left[first], b[first], np.full(int(first.sum()), length)))
            key, doc, start, left, b, size = (np.concatenate(x) for x in zip(*rows, strict=True))
            raw = data.tobytes()
            yield emit(
                _BYTES, bucket=_bucket(key, buckets).astype(np.int32), key=key.astype(np.uint64).view(np.int64), doc=doc, start=start, left=left,
                piece=[raw[x : x + y] for x, y in zip(b.tolist(), size.tolist(), strict=True)])

    return step


def _padded(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, sign: int) -> np.ndarray:
    """A row for each stretch of ``sizes`` bytes from ``begin`` forwards or backwards, filled up with a byte UTF-8 lacks."""
    rows = np.full((len(sizes), int(sizes.max(initial=0))), 0xFF, np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[np.repeat(np.arange(len(sizes)), sizes), step] = data[np.repeat(begin, sizes) + sign * step]
    return rows


def _shared_by_all(rows: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The longest prefix that all rows of each group share."""
    differ = rows != rows[np.repeat(bounds, counts)]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows), np.int64)
    return np.minimum.reduceat(np.minimum(same, sizes), bounds)


def repeats_in_groups(
    key: np.ndarray, doc: np.ndarray, start: np.ndarray, left: np.ndarray, data: np.ndarray, at: np.ndarray, length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the strings in pieces data[at[i]:at[i + 1]] that an earlier piece of the same key holds too.

    A piece holds its anchor ``left`` bytes from its start.  The bytes around
    the anchor that lie in every string of a group, and agree in all of its
    pieces, enter the group's suffix array as one symbol.
    """
    order = np.argsort(key, kind="stable")
    key, doc, start, left = key[order], doc[order], start[order].astype(np.int64), left[order].astype(np.int64)
    size, begin = np.diff(at)[order], at[:-1][order]
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(bounds, len(key)))
    right = size - left - ANCHOR
    of_all = _shared_by_all(_padded(data, begin + left - 1, left, -1), left, bounds, counts)
    core_left = np.minimum(of_all, np.minimum.reduceat(left - (size - length), bounds))
    of_all = _shared_by_all(_padded(data, begin + left + ANCHOR, right, 1), right, bounds, counts)
    core_right = np.minimum(of_all, np.minimum.reduceat(length - left - ANCHOR, bounds))
    core = core_left + ANCHOR + core_right
    left_part, right_part = left - np.repeat(core_left, counts), right - np.repeat(core_right, counts)
    room = left_part + 1 + right_part + 1  # piece, core, piece, end of piece
    weight = np.add.reduceat(room, bounds) + 1
    by_weight = np.argsort(weight, kind="stable")  # groups of like size take as many steps
    upto = np.cumsum(weight[by_weight])
    docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut = 0
    while cut < len(by_weight):
        stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + SORTED_AT_ONCE, side="right")))
        groups = by_weight[cut:stop]
        cut = stop
        n = counts[groups]
        pieces = np.repeat(bounds[groups] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        last = np.cumsum(n) - 1
        wide = room[pieces]
        wide[last] += 1
        ends = np.cumsum(wide)
        begins = ends - wide
        symbols = np.ones(int(ends[-1]), np.int64)
        symbols[ends[last] - 1] = 0
        lp, rp = left_part[pieces], right_part[pieces]
        symbols[begins + lp] = 2
        for sizes, target, source in (
            (lp, begins, begin[pieces]), (rp, begins + lp + 1, begin[pieces] + size[pieces] - rp)):
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            symbols[np.repeat(target, sizes) + step] = data[np.repeat(source, sizes) + step].astype(np.int64) + 3
        sorted_all = suffix_arrays(symbols, np.concatenate(([0], ends[last])))
        piece_at = np.full(len(symbols), -1, np.int64)  # the piece whose string starts here
        strings = size[pieces] - length + 1
        heads = np.repeat(begins - np.cumsum(strings) + strings, strings) + np.arange(int(strings.sum()))
        piece_at[heads] = np.repeat(np.arange(len(pieces)), strings)
        ranked = sorted_all[piece_at[sorted_all] >= 0]
        piece = piece_at[ranked]
        group = np.repeat(np.arange(len(groups)), n)[piece]
        need = (length - core[groups] + 1)[group]  # symbols of a string
        widest = int(need.max())
        flat = np.append(symbols, np.zeros(widest, np.int64)).astype(np.uint16)
        windows = np.lib.stride_tricks.sliding_window_view(flat, widest)
        same = np.zeros(len(ranked), bool)
        for a in range(1, len(ranked), 1 << 15):
            b = min(len(ranked), a + (1 << 15))
            differ = windows[ranked[a:b]] != windows[ranked[a - 1 : b - 1]]
            agree = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
            same[a:b] = (agree >= need[a:b]) & (group[a:b] == group[a - 1 : b - 1])
        kind = np.cumsum(~same)
        lone = ~same & np.append(~same[1:], True)
        kind, ranked, piece = kind[~lone], ranked[~lone], piece[~lone]
        d = doc[pieces][piece]
        s = start[pieces][piece] + ranked - begins[piece]
        first = first_of_equal((kind,), d, s)
        docs.append(d[~first])
        starts.append(s[~first])
    return np.concatenate(docs), np.concatenate(starts)


def _longest_shared(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The longest prefix that each padded row shares with another row of its group, within its own size."""
    n = len(rows)
    keyed = np.concatenate((group.astype(">u4").view(np.uint8).reshape(n, 4), rows), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    rows, group = rows[order], group[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(max(n - 1, 0), np.int64)
    shared[group[1:] != group[:-1]] = 0
    most = np.zeros(n, np.int64)
    most[order] = np.maximum(np.append(0, shared), np.append(shared, 0))
    return np.minimum(most, sizes)


def trimmed(key: np.ndarray, left: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes to cut before, bytes to keep) of each piece: what lies as far from the anchor as any other piece of the key agrees."""
    size = np.diff(at)
    right = size - left - ANCHOR
    group = np.unique(key, return_inverse=True)[1]

    before = _longest_shared(group, _padded(data, at[:-1] + left - 1, left, -1), left)
    after = _longest_shared(group, _padded(data, at[:-1] + left + ANCHOR, right, 1), right)
    return left - before, before + ANCHOR + after


def _sort_groups(buckets: int, doc_buckets: int, length: int):
    def step(batches: Batches) -> Batches:
        hashes = PolynomialHash()
        for run in sorted_runs(batches, ["bucket"], size=BATCH):
            numbers = np.asarray(run["bucket"].combine_chunks())
            for b in np.unique(numbers):
                part = run.filter(pa.array(numbers == b))
                key, doc, start, left = (np.asarray(part[c].combine_chunks()) for c in ("key", "doc", "start", "left"))
                if b == buckets:  # repeats already
                    again = _spans(doc, start, key)
                    yield from _packed(_REPEAT, again, _bucket(again["doc"], doc_buckets))
                    continue
                data, at = column_bytes(part["piece"])
                # what no other piece of the key agrees with is cut off; pieces too short for a string then go
                skip, keep = trimmed(key, left.astype(np.int64), data, at)
                long = np.flatnonzero(keep >= length)
                begin, size = (at[:-1] + skip)[long], keep[long]
                key, doc, start, left = key[long], doc[long], start[long] + skip[long], (left - skip)[long]
                # earliest of equal pieces (the anchor's place is part of them) stand for the others
                whole = hashes.spans(hashes.prefix(data), begin, begin + size) ^ mix64(left.astype(np.uint64) + np.uint64(1))
                first = first_of_equal((key, whole), doc, start)
                again = _spans(doc[~first], start[~first], size[~first])
                yield from _packed(_REPEAT, again, _bucket(again["doc"], doc_buckets))
                kept = np.flatnonzero(first)
                _, of, count = np.unique(key[kept], return_inverse=True, return_counts=True)
                kept = kept[count[of] > 1]
                if not len(kept):
                    continue
                size, begin = size[kept], begin[kept]
                flat = data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                docs, starts = repeats_in_groups(
                    key[kept], doc[kept], start[kept], left[kept], flat, np.concatenate(([0], np.cumsum(size))), length)
                spans = _spans(docs, starts, np.full(len(docs), length))
                yield from _packed(_REPEAT, spans, _bucket(spans["doc"], doc_buckets))

    return step


_MARKED = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("removed", pa.binary())])


def _beside(batch: pa.RecordBatch, *carried: pa.Array) -> pa.RecordBatch:
    """The batch, with the carried column if there is one."""
    return pa.RecordBatch.from_arrays([*batch.columns, *carried], names=batch.schema.names + ["carried"] * len(carried))


def _mark(batches: Batches) -> Batches:
    """Each text with its repeats, joined and ordered, as packed pairs of start and end."""
    for run in sorted_runs(batches, ["bucket"], size=BATCH):
        _, at, ids, spans = _texts_and_marks(run, _REPEAT, SPAN)
        spans = _spans(spans["doc"], spans["start"], spans["size"])
        low, high = np.searchsorted(spans["doc"], ids), np.searchsorted(spans["doc"], ids, side="right")
        pairs = np.stack((spans["start"], spans["start"] + spans["size"]), axis=1).astype(np.int32)
        texts = run.filter(pa.compute.equal(run["kind"], _WHOLE))
        if len(ids):
            marked = emit(
                _MARKED, doc_id=ids, text=texts["data"].combine_chunks(),
                removed=[pairs[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            yield _beside(marked, *(texts[c].combine_chunks() for c in run.column_names if c == "carried"))


def numbered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """``docs`` with a column ``_number`` that no two rows share, in the order of ids, and whether ids repeat.

    Rows without an id are left out.

    The number is the id, or where ids repeat id * 65,536 + place, the rows of
    one id being placed by their texts' hashes.
    """
    rows = docs.where(F.col(f"`{id_column}`").isNotNull()).withColumn("_number", F.col(f"`{id_column}`").cast("long"))
    size = rows.groupBy("_number").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (size or 0) <= 1:
        return rows, False
    if size > _REPEATS:
        raise ValueError("more than 65,536 rows share an id")
    text = F.col(f"`{text_column}`")
    place = F.row_number().over(W.partitionBy("_number").orderBy(F.xxhash64(text), text)) - 1
    return materialize(rows.withColumn("_place", place).withColumn("_number", F.col("_number") * _REPEATS + F.col("_place")).drop("_place"), "texts"), True


def marked_spans(
    rows: DataFrame, then: Callable[[Batches], Batches], schema: str, length: int = LENGTH, crowded: int = CROWDED,
) -> DataFrame:
    """What ``then`` makes of batches (doc_id, text as bytes, removed) of rows (doc_id, text) with unique ids.

    A column ``carried`` of the rows goes with their texts to ``then``, after
    the others.

    ``removed`` holds ascending disjoint (start, end) pairs of 32-bit integers:
    the byte spans that repeat earlier strings.  Both steps share one Python
    worker.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"strings of at least {2 * ANCHOR} bytes")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = partition_count(rows)
    buckets, doc_buckets = max(2 * width, -(-total // (8 << 20))), max(8 * width, -(-total // (2 << 20)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(width, "bucket").sortWithinPartitions("bucket")

    plain = rows.select("doc_id", "text")
    compared = materialize(dealt(plain.mapInArrow(_find(buckets, doc_buckets, length), _PACKED_DDL)).mapInArrow(
        _compare(buckets, doc_buckets, crowded), _PACKED_DDL), "pieces")

    def and_carried(schema: str, rows: DataFrame) -> StructType:
        return StructType([*StructType.fromDDL(schema), *(f for f in rows.schema if f.name == "carried")])

    def with_texts(marks: DataFrame, rows: DataFrame) -> DataFrame:
        texts = rows.mapInArrow(_by_document(doc_buckets), and_carried(f"{_PACKED_DDL}, doc_id long", rows))
        return dealt(texts.unionByName(marks, allowMissingColumns=True))

    wanted = with_texts(compared.where(F.col("kind") == _WANTED), plain).mapInArrow(_fetch(buckets, length), _BYTES_DDL)
    found = dealt(wanted).mapInArrow(_sort_groups(buckets, doc_buckets, length), _PACKED_DDL)
    marks = compared.where(F.col("kind") == _REPEAT).unionByName(found)
    return with_texts(marks, rows).mapInArrow(lambda batches: then(_mark(batches)), and_carried(schema, rows))


_TEXTS = pa.schema([*_PACKED, ("doc_id", pa.int64())])


def _by_document(doc_buckets: int):
    def step(batches: Batches) -> Batches:
        for part in batches:
            ids = np.asarray(part.column(0))
            texts = pa.compute.fill_null(part.column(1), "").cast(pa.binary())
            yield _beside(emit(
                _TEXTS, bucket=_bucket(ids, doc_buckets).astype(np.int32), kind=np.full(len(ids), _WHOLE, np.int8), data=texts, doc_id=ids,
            ), *part.columns[2:])

    return step


_REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(text: bytes, removed: bytes) -> tuple[bytes, np.ndarray]:
    pairs = np.frombuffer(removed, np.int32).reshape(-1, 2)
    parts, at = [], 0
    for a, b in pairs.tolist():
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), pairs


def _report(batches: Batches) -> Batches:
    for batch in batches:
        rows = []
        for doc, text, removed in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            kept, pairs = _kept(text, removed)
            rows.append((doc, len(text), len(text) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest()))
        yield emit(_REPORT, **dict(zip(_REPORT.names, map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True)))


def _plain(rows: DataFrame, text_column: str) -> DataFrame:
    return rows.select(F.col("_number").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, crowded: int = CROWDED,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row of ``docs`` with an id.

    A byte goes if a string of ``length`` bytes that covers it starts earlier as
    well (in a document of smaller id, or earlier in its own).  Null counts as
    empty; rows of one id are documents of their own, ordered by their texts'
    hashes; an empty table gives no row.
    """
    rows, repeated = numbered(take_columns(docs, doc_id=id_column, text=text_column), "doc_id", "text")
    report = marked_spans(
        _plain(rows, "text"), _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, crowded)
    doc_id = F.shiftright("doc_id", _REPEATS.bit_length() - 1) if repeated else F.col("doc_id")
    return report.withColumn("doc_id", doc_id)


_CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _whole_characters(batches: Batches) -> Batches:
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, at = [], 0
            for a, b in np.frombuffer(removed, np.int32).reshape(-1, 2).tolist():
                while a < b and text[a] & 0xC0 == 0x80:  # a character that began before the span stays
                    a += 1
                while b > a and b < len(text) and text[b] & 0xC0 == 0x80:  # and so does one that ends after it
                    b -= 1
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            texts.append(b"".join(parts).decode("utf-8"))
        yield _beside(emit(_CLEAN, doc_id=batch.column(0), text=texts), *batch.columns[3:])


def cleaned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows of ``docs`` and their columns; texts lose their repeated bytes, but characters of which a byte stays, stay whole.

    Null texts stay null, and rows without an id stay as they are.
    """
    rows, _ = numbered(docs, id_column, text_column)
    others = [c for c in docs.columns if c != text_column]
    carried = F.struct(F.col(f"`{text_column}`").isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(others)])
    texts = marked_spans(
        rows.select(F.col("_number").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), carried.alias("carried")),
        _whole_characters, "doc_id long, text string", length)
    text = F.when(F.col("carried.null"), None).otherwise(F.col("text"))
    return texts.select(*[(text if c == text_column else F.col(f"carried.c{others.index(c)}")).alias(c) for c in docs.columns]).unionByName(
        docs.where(F.col(f"`{id_column}`").isNull()))
