"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training row.  The weights are fitted on
a bounded sample of training rows by the follow-the-regularised-leader method
with elastic-net penalties, which leaves weights of no use at exactly zero; a
part of the sample is held back to calibrate the temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Batches, emit, long_id, mix64, rows_of_batches
from wardline.llm.counting import table_sums

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 800  # sampled training rows of each language
MOST_LANGUAGES = 500
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.002, 4
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")  # numerals that are no digits as well
_PIECE = 1 << 20  # characters hashed together


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def _add_grams(points: np.ndarray, out: np.ndarray) -> None:
    """Add the counts of all n-grams of a text's code points to ``out``, piece by piece."""
    n, most = len(points), max(ORDERS)
    for first in range(0, n, _PIECE):
        part = points[max(0, first - most + 1) : first + _PIECE].astype(np.uint64)
        new = first - max(0, first - most + 1)
        key = np.zeros(len(part), np.uint64)
        for order in range(1, most + 1):
            # key[i]: the last ``order`` code points up to i, 21 bits each
            shifted = np.concatenate((np.zeros(order - 1, np.uint64), part[: len(part) - order + 1]))
            key = key | shifted << np.uint64(21 * (order - 1))
            if order in ORDERS:
                ends = max(new, order - 1)
                if ends < len(key):
                    slots = mix64(key[ends:] ^ np.uint64(order << 60 & (1 << 64) - 1)) >> np.uint64(64 - FEATURES.bit_length() + 1)
                    out += np.bincount(slots.astype(np.int64), minlength=FEATURES)


def gram_counts(texts: list[str | None], at_once: int = 64) -> Iterator[np.ndarray]:
    """Rows of n-gram counts, ``at_once`` texts a time; letters are lower-cased, null has none."""
    for first in range(0, len(texts), at_once):
        part = texts[first : first + at_once]
        counts = np.zeros((len(part), FEATURES), np.int64)
        for row, text in zip(counts, part, strict=True):
            if text:
                _add_grams(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), row)
        yield counts


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages, scaled by the inverse document frequency
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float64)
        size = np.sqrt((x * x) @ (self.idf * self.idf))
        logits = (x @ self.weights) / np.where(size > 0, size, 1)[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, alpha: float = ALPHA, beta: float = BETA,
    l1: float = L1, l2: float = L2, epochs: int = EPOCHS, seed: int = 7, features: int = FEATURES,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of multinomial logistic regression; ``rows`` are (indices, values).

    Every coordinate keeps the sum z of its adjusted gradients and the sum n of
    their squares; its weight is zero while |z| is within the L1 penalty.
    The bias is one more feature of value 1, under the same rule but unpenalised.
    """
    z, n = np.zeros((features + 1, n_classes)), np.zeros((features + 1, n_classes))
    penalty1, penalty2 = np.full((features + 1, 1), l1), np.full((features + 1, 1), l2)
    penalty1[features] = penalty2[features] = 0

    def weights(at):
        zi = z[at]
        lasso = penalty1[at] * len(rows)
        return np.where(np.abs(zi) <= lasso, 0.0, -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(n[at])) / alpha + penalty2[at] * len(rows)))

    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in shuffle.permutation(len(rows)):
            at, values = np.append(rows[k][0], features), np.append(rows[k][1], 1.0)
            w = weights(at)
            p = softmax(values @ w)
            p[classes[k]] -= 1
            gradient = values[:, None] * p
            square = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
    w = weights(np.arange(features + 1))
    return w[:features], w[features]


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(p)), classes], 1e-300)).mean()

    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))


def fold(id_column: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % folds


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(rows holding each feature, rows) over all rows of ``text``."""
    def add(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for counts in gram_counts(batch.column(0).to_pylist()):
            table[:FEATURES] += (counts > 0).sum(axis=0)
            table[FEATURES] += len(counts)

    sums = table_sums(texts.select("text"), add, FEATURES + 1)
    return sums[:FEATURES], int(sums[FEATURES])


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on ``rows`` (doc_id, text, lang): frequencies over all, weights on the sample.

    The sample takes the ``per_language`` rows of each language whose ids hash
    lowest.  None if no row has a language and a letter.
    """
    labelled = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    names = [r["lang"] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError("more languages than the model is meant for")
    if not names:
        return None
    frequency, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    # thresholds on the hash keep about per_language rows of each language; the cut to the number comes after
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(None).cast("double")
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.2 * (per_language + 50) / size))).otherwise(share)
    place = F.xxhash64(F.lit("sample"), "doc_id", "text").cast("double") / 2.0**64 + 0.5
    picked = labelled.withColumn("place", place).where(F.col("place") <= share).collect()
    by_language: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["place"], r["text"])):
        own = by_language.setdefault(r["lang"], [])
        if len(own) < per_language and has_letter(r["text"]):
            own.append(r["text"])
    languages = sorted(by_language)
    texts = [t for name in languages for t in by_language[name]]
    classes = np.array([c for c, name in enumerate(languages) for _ in by_language[name]])
    if not texts:
        return None
    vectors = []
    for counts in gram_counts(texts):
        for row in counts:
            at = np.flatnonzero(row)
            values = row[at] * idf[at]
            vectors.append((at, values / np.sqrt((values * values).sum())))
    held = np.arange(len(texts)) % 5 == 0
    weights, bias = ftrl([v for v, h in zip(vectors, held, strict=True) if not h] or vectors, classes[~held] if (~held).any() else classes, len(languages))
    logits = np.array([v @ weights[at] + bias for at, v in vectors])
    return LanguageModel(
        languages, weights * idf[:, None], bias, idf, temperature(logits[held], classes[held]) if held.any() else 1.0)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs``.

    Training rows are those outside fold 0 (crc32 of the id mod 5).  Texts that
    are null or hold no letter are ``und`` with score 0, and so are all if no
    language could be learned.  A null id is held out neither way (false) and
    never trains.  Repeated rows each get their row; an empty table gives none.
    """
    rows = docs.select(
        long_id(id_column, "doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"),
        F.col(f"`{lang_column}`").cast("string").alias("lang"))
    model = train(rows.where(fold() != 0), per_language)

    def step(batches: Batches) -> Batches:
        for part in rows_of_batches(batches, size=1 << 20):
            texts = part["text"].to_pylist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model is not None:
                at = [i for i, t in enumerate(texts) if has_letter(t)]
                first = 0
                for counts in gram_counts([texts[i] for i in at]):
                    p = model.probabilities(counts)
                    for i, best, row in zip(at[first : first + len(p)], p.argmax(axis=1), p, strict=True):
                        names[i], scores[i] = model.languages[best], row[best]
                    first += len(p)
            yield emit(_OUT, doc_id=part["doc_id"].combine_chunks(), held_out=part["held_out"].combine_chunks(), lang_pred=names, score=scores)

    asked = rows.select("doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    return asked.mapInArrow(step, "doc_id long, held_out boolean, lang_pred string, score double")
