"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  The field scores a line by features of its own and
of the lines beside it, and neighbouring labels by a table of transitions.
Forward-backward gives each line's probability of being good; their mean,
weighted by the lines' lengths, is the document's quality, put on the labels'
scale by a logistic curve.

The labels at hand are of documents.  Lines of good documents train as good;
of bad documents those lines train as bad that the field itself finds the
likelier bad ones, in a few rounds of fitting and labelling again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Batches, PolynomialHash, column_bytes, emit, long_id, rows_of_batches
from wardline.llm.language import fold

PER_CLASS = 1500  # sampled training documents of each label
ROUNDS, STEPS, RATE, RIDGE = 3, 80, 0.15, 1e-3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_BATCH = 1 << 19


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_WIDE = _table(bytes(range(128, 256)))
_DIGIT = _table(b"0123456789")
_SPACE = _table(b" \t\r\x0b\x0c")
_PLAIN = _table(b".,;:'\"?()-")
_BAR = _table(b"|")
_CRY = _table(b"!")
_SYMBOL = (1 - np.maximum.reduce([_UPPER, _LOWER, _WIDE, _DIGIT, _SPACE, _PLAIN, _BAR, _CRY])).astype(np.uint8)
_FULL_STOP = _table(b".?!\"'")

OWN = 29
BESIDE = (2, 4, 5, 6, 10, 12, 26)  # own features that the lines before and after show too
FEATURES = OWN + 2 * len(BESIDE) + 3


@dataclass
class Lines:
    """Features of all lines of some documents; line i of document d is row first[d] + i."""

    features: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def lines_of(data: np.ndarray, at: np.ndarray, hashes: PolynomialHash) -> Lines:
    """Lines end at line feeds; every document has one line at least, an empty one if need be."""
    docs = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    # a start is a document's begin or comes after a break inside the document that began last
    own = np.concatenate((np.zeros(docs, bool), np.ones(len(breaks), bool)))
    order = np.argsort(np.concatenate((2 * at[:-1] + 1, 2 * (breaks + 1))), kind="stable")
    own = own[order]
    doc = np.cumsum(~own) - 1
    start = np.concatenate((at[:-1], breaks + 1))[order]
    end = np.where(np.append(doc[1:] != doc[:-1], True), at[1:][doc], np.append(start[1:], len(data)) - 1)
    size = end - start
    n = np.maximum(size, 1).astype(np.float64)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return (total[end] - total[start]).astype(np.float64)

    upper, lower, wide, digit, space, plain, bar, cry, symbol = (
        count(t) for t in (_UPPER, _LOWER, _WIDE, _DIGIT, _SPACE, _PLAIN, _BAR, _CRY, _SYMBOL))
    letters = upper + lower + wide
    white = _SPACE[data] > 0
    inked = ~white & (data != 10)
    held = np.diff(at) > 0
    fresh = np.zeros(len(data), bool)  # nothing of the same document before
    fresh[at[:-1][held]] = True
    word = inked.copy()  # first bytes of words
    word[1:] &= ~inked[:-1] | fresh[1:]
    total = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))
    words = (total[end] - total[start]).astype(np.float64)
    after = inked.copy()  # last bytes of words
    after[:-1] &= ~inked[1:] | fresh[1:]
    odd_end = after & ((_SYMBOL | _CRY | _BAR)[data] > 0)
    total = np.concatenate(([0], np.cumsum(odd_end, dtype=np.int64)))
    odd_words = (total[end] - total[start]) / np.maximum(words, 1)
    # words that say again the word before them in their line
    begins, ends = np.flatnonzero(word), np.flatnonzero(after) + 1
    hashed = hashes.spans(hashes.prefix(data), begins, ends)
    echo = np.zeros(len(data), bool)
    echo[begins[1:]] = hashed[1:] == hashed[:-1]
    total = np.concatenate(([0], np.cumsum(echo, dtype=np.int64)))
    line_of_word = np.searchsorted(start, begins, side="right") - 1
    heads = np.searchsorted(line_of_word, np.arange(len(start)))  # the first word of a line has none before it
    has = heads < len(begins)
    has[has] = line_of_word[heads[has]] == np.flatnonzero(has)
    cross = np.zeros(len(start), np.int64)
    cross[has] = echo[begins[heads[has]]]
    echoes = (total[end] - total[start] - cross) / np.maximum(words, 1)
    filled = size > 0
    safe = np.minimum(np.maximum(end - 1, 0), max(len(data) - 1, 0))
    last = data[safe] if len(data) else np.zeros(len(start), np.uint8)
    head = data[np.minimum(start, max(len(data) - 1, 0))] if len(data) else last
    key = hashes.spans(hashes.prefix(data), start, end) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    again = (times[of] > 1) & filled
    counts = np.bincount(doc, minlength=docs)
    repeats = np.bincount(doc, weights=again * size, minlength=docs) / np.maximum(np.diff(at), 1)
    shout, odd, table = upper / np.maximum(letters, 1), symbol / n, bar / np.maximum(words, 1)
    own_columns = [
        np.ones(len(start)), np.log1p(size) / 8, shout, digit / n, odd, cry / np.maximum(words, 1), table,
        np.log1p(words) / 6, (letters + digit) / np.maximum(words, 1) / 10, plain / n, again, ~filled, odd_words,
        filled & (_FULL_STOP[last] > 0), filled & (_UPPER[head] > 0), shout > 0.3, shout > 0.8, odd > 0.02, odd > 0.1, table > 0.2,
        odd_words > 0.3, odd_words > 0.8, wide / n, repeats[doc], (words > 0) & (words < 3), np.log1p(words / np.maximum(plain, 1)) / 4,
        echoes, echoes > 0.15, echoes > 0.5]
    own_features = np.stack([np.asarray(c, np.float32) for c in own_columns], axis=1)
    first_line = np.append(True, doc[1:] != doc[:-1])
    last_line = np.append(doc[1:] != doc[:-1], True)
    beside = own_features[:, BESIDE]
    before, behind = np.zeros_like(beside), np.zeros_like(beside)
    before[1:], behind[:-1] = beside[:-1], beside[1:]
    before[first_line], behind[last_line] = 0, 0
    only = first_line & last_line
    features = np.concatenate(
        (own_features, before, behind, np.stack((first_line, last_line, only), axis=1).astype(np.float32)), axis=1)
    return Lines(features, size + 1, counts)


def lines_of_texts(texts: list[str | None], at_once: int = 64) -> Lines:
    """The same for many texts, a few at a time."""
    hashes, parts = PolynomialHash(), []
    for k in range(0, len(texts), at_once):
        parts.append(lines_of(*column_bytes(pa.array(texts[k : k + at_once], pa.string())), hashes))
    return Lines(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("features", "sizes", "counts")])


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good of each line, expected transitions as a 2 x 2 table), by forward-backward.

    ``scores`` are the lines' scores for good (0 for bad).  All documents take
    their k-th lines in one step.
    """
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, long = first[order], counts[order]
    steps = int(long[0]) if len(long) else 0
    live = np.searchsorted(-long, -np.arange(steps), side="left")  # documents with more than k lines
    unary = np.stack((np.zeros(len(scores)), scores), axis=1)
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)

    def both(a: np.ndarray) -> np.ndarray:  # log-sum over the last axis of two
        return np.logaddexp(a[..., 0], a[..., 1])

    for k in range(steps):
        at = first[: live[k]] + k
        alpha[at] = unary[at] if k == 0 else unary[at] + both(alpha[at - 1][:, None, :] + transitions.T[None])
    for k in range(steps - 2, -1, -1):
        at = first[: live[k + 1]] + k
        beta[at] = both((unary[at + 1] + beta[at + 1])[:, None, :] + transitions[None])
    joint = alpha + beta
    good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))
    inner = np.ones(len(scores), bool)
    inner[first + long - 1] = False
    at = np.flatnonzero(inner)
    if not len(at):
        return good, np.zeros((2, 2))
    z = both(joint[at])
    pair = alpha[at][:, :, None] + transitions[None] + (unary[at + 1] + beta[at + 1])[:, None, :] - z[:, None, None]
    return good, np.exp(pair).sum(axis=0)


@dataclass
class LineField:
    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean probability of good, by document."""
        good, _ = marginals(lines.features @ self.weights, lines.counts, self.transitions)
        first = lines.first
        return np.add.reduceat(good * lines.sizes, first) / np.add.reduceat(lines.sizes.astype(np.float64), first)

    def scores(self, lines: Lines) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.quality(lines)) + self.offset, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(lines: Lines, labels: np.ndarray, sizes: dict[int, int]) -> LineField:
    """A field for documents labelled 1 (good) or 0; ``sizes`` are the labels' numbers of documents outside the sample too.

    The field weighs both labels alike; the logistic curve follows their real shares.
    """
    x = lines.features.astype(np.float64)
    doc = np.repeat(np.arange(len(labels)), lines.counts)
    of_line = labels[doc].astype(np.float64)
    last = np.zeros(len(doc), bool)
    last[lines.first + lines.counts - 1] = True
    inner = np.flatnonzero(~last)
    share = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    balance = np.where(labels == 1, len(labels) / share[1], len(labels) / share[0]) / 2
    theta = np.zeros(FEATURES + 4)
    line_labels = of_line.copy()
    weight = 1.0 / len(labels)
    for r in range(ROUNDS):
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        np.add.at(seen, (line_labels[inner].astype(int), line_labels[inner + 1].astype(int)), 1)
        for t in range(1, STEPS + 1):
            good, expected = marginals(x @ theta[:FEATURES], lines.counts, theta[FEATURES:].reshape(2, 2))
            gradient = np.concatenate((x.T @ ((line_labels - good) * balance[doc]), (seen - expected).ravel())) * weight - RIDGE * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
            theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if r + 1 < ROUNDS:
            good, _ = marginals(x @ theta[:FEATURES], lines.counts, theta[FEATURES:].reshape(2, 2))
            worst = np.minimum.reduceat(good, lines.first)[doc]
            line_labels = np.where(of_line == 1, 1.0, np.where((good < 0.5) | (good <= worst), 0.0, 1.0))
    field = LineField(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), 1.0, 0.0)
    # the logistic curve from document quality to label
    whole = sum(sizes.values())
    balance = np.where(labels == 1, sizes.get(1, 0) / share[1], sizes.get(0, 0) / share[0]) * len(labels) / max(1, whole)
    z = _logit(field.quality(lines))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([((labels - p) * balance * z).sum() - 0.1 * a, ((labels - p) * balance).sum() - 0.1 * b])
        s = p * (1 - p) * balance
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    field.slope, field.offset = max(float(a), 0.05), float(b)
    return field


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_class: int = PER_CLASS,
) -> LineField | None:
    """Fit on the sampled labelled documents outside the held-out fold; None without any.

    Per label the ``per_class`` documents whose ids hash lowest; of documents
    labelled both ways 0 counts.
    """
    marked = labels.select(long_id("doc_id", "_id"), F.col("quality").cast("int").alias("_quality")).where(
        "_id IS NOT NULL AND _quality IN (0, 1)").groupBy("_id").agg(F.min("_quality").alias("_quality"))
    marked = marked.where(fold("_id", FOLDS) != HELD_OUT)
    sizes = {r["_quality"]: r["count"] for r in marked.groupBy("_quality").count().collect()}
    place = F.xxhash64(F.lit("sample"), "_id").cast("double") / 2.0**64 + 0.5
    share = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("_quality") == label, F.lit(min(1.0, 1.2 * (per_class + 50) / size))).otherwise(share)
    picked = marked.withColumn("_place", place).where(F.col("_place") <= share)  # some per_class rows of each label
    rows = docs.select(long_id(id_column, "_id"), F.col(f"`{text_column}`").cast("string").alias("_text")).join(F.broadcast(picked), "_id")
    chosen: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["_place"], r["_id"], r["_text"] or "")):
        own = chosen.setdefault(r["_quality"], [])
        if len(own) < per_class:
            own.append(r["_text"])
    texts = [t for c in sorted(chosen) for t in chosen[c]]
    if not texts:
        return None
    return fit(lines_of_texts(texts), np.array([c for c in sorted(chosen) for _ in chosen[c]]), sizes)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_class: int = PER_CLASS,
) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``.

    Null and empty texts are one empty line.  Without labels to learn from all
    scores are 0.5.  A null id is held out neither way (false); repeated rows
    each get their row; an empty table gives none.
    """
    field = train(docs, labels, id_column, text_column, per_class)

    def step(batches: Batches) -> Batches:
        hashes = PolynomialHash()
        for part in rows_of_batches(batches, size=_BATCH):
            data, at = column_bytes(part["text"])
            score = field.scores(lines_of(data, at, hashes)) if field is not None else np.full(part.num_rows, 0.5)
            yield emit(
                _OUT, doc_id=part["doc_id"].combine_chunks(), held_out=part["held_out"].combine_chunks(), score=score,
                predicted=(score >= THRESHOLD).astype(np.int32))

    asked = docs.select(long_id(id_column, "doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    asked = asked.withColumn("held_out", F.coalesce(fold(folds=FOLDS) == HELD_OUT, F.lit(False)))
    return asked.mapInArrow(step, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_class: int = PER_CLASS,
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``THRESHOLD``, with all their columns (all rows without labels to learn from)."""
    field = train(docs, labels, id_column, text_column, per_class)
    if field is None:
        return docs
    text_at = docs.columns.index(text_column)

    def step(batches: Batches) -> Batches:
        hashes = PolynomialHash()
        for batch in batches:
            for part in rows_of_batches([batch], size=_BATCH):
                data, at = column_bytes(part.column(text_at))
                good = field.scores(lines_of(data, at, hashes)) >= THRESHOLD
                yield from part.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(step, docs.schema)
