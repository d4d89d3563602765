import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import empty_frame, odd_documents, odd_frame, prose
from wardline.llm import cross_entropy, language, line_crf
from wardline.llm.common import PolynomialHash, column_bytes

# --- quality -----------------------------------------------------------------------------------------------------


def lines(texts):
    data, at = column_bytes(pa.array(texts, pa.string()))
    return line_crf.lines_of(data, at, PolynomialHash())


def test_lines_of_odd_texts():
    texts = ["", "a\nb", "\n", "x", None, "", "end\n", "A!! B!!"]
    got = lines(texts)
    assert got.counts.tolist() == [len((t or "").split("\n")) for t in texts]
    assert got.sizes.tolist() == [len(x) + 1 for t in texts for x in (t or "").split("\n")]
    assert np.isfinite(got.features).all()
    assert got.features.shape == (int(got.counts.sum()), line_crf.FEATURES)


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] for r in odd_documents()]
    together = lines(texts)
    apart = np.concatenate([lines([t]).features for t in texts])
    assert np.allclose(together.features, apart)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    scores, transitions = rng.standard_normal(int(counts.sum())), rng.standard_normal((2, 2))
    good, pairs = line_crf.marginals(scores, counts, transitions)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts.tolist():
        s = scores[at : at + n]
        weights = {}
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = math.exp(sum(s[k] * y[k] for k in range(n)) + sum(transitions[y[k], y[k + 1]] for k in range(n - 1)))
        z = sum(weights.values())
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
        for y, w in weights.items():
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += w / z
        at += n
    assert np.allclose(pairs, want_pairs)


def labelled(spark, n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rng, rng.randint(20, 120))
        if not good:
            part = prose(rng, 30)
            text = text + "\n" + (part.upper().replace(" ", "!! ") if i % 2 else part.replace(" ", "*** "))
        docs.append((i, text, "en", "s", 1, None, None))
        if i % 4:
            labels.append((i, int(good), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, start string"
    return spark.createDataFrame(docs, schema).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_is_learned_and_held_out(spark):
    docs, labels = labelled(spark)
    got = line_crf.score_documents(docs, labels).collect()
    right = sum(r.predicted == int(r.doc_id % 3 != 0) for r in got)
    assert right >= 0.97 * len(got) == 0.97 * 600
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    # labels of the held-out fold change nothing
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in line_crf.score_documents(docs, turned).collect()}
    assert again == {r.doc_id: r.score for r in got}
    kept = line_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_of_odd_rows(spark):
    docs, labels = odd_frame(spark), labelled(spark)[1]
    got = line_crf.score_documents(docs, labels).collect()
    assert len(got) == len(odd_documents()) and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {r.score for r in line_crf.score_documents(docs, none).collect()} == {0.5}
    assert line_crf.keep_good(docs, none).count() == len(odd_documents())
    assert line_crf.score_documents(empty_frame(spark), labels).collect() == []
    odd = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0), (9, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert line_crf.score_documents(docs, odd).count() == len(odd_documents())


# --- language ----------------------------------------------------------------------------------------------------

ALPHABETS = {"aa": "aeioulmnrst", "bb": "xyzqwkjvbgh", "cc": "абвгдежзикл"}


def spoken(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        words = ["".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang if i % 7 else None, "s", 1, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, start string").repartition(3)


def test_language_is_learned(spark):
    docs = spoken(spark)
    got = language.identify(docs, per_language=40).collect()
    assert sum(r.lang_pred == ("aa", "bb", "cc")[r.doc_id % 3] for r in got) >= 0.98 * 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    other = docs.selectExpr(
        "doc_id", "text", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 'zz', lang) AS lang", "source", "n_chars", "component_id", "start")
    assert {(r.doc_id, r.lang_pred, r.score) for r in language.identify(other, per_language=40).collect()} == {
        (r.doc_id, r.lang_pred, r.score) for r in got}


def test_language_of_odd_rows(spark):
    got = language.identify(odd_frame(spark)).collect()
    assert len(got) == len(odd_documents())
    for r in got:
        assert 0 <= r.score <= 1
    blank = {r[0] for r in odd_documents() if r[1] is None or not any(c.isalpha() for c in r[1])}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == blank
    nobody = language.identify(odd_frame(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {(r.lang_pred, r.score) for r in nobody.collect()} == {("und", 0.0)}
    assert language.identify(empty_frame(spark)).collect() == []


def test_frequencies_cover_all_rows_and_long_texts(spark, monkeypatch):
    texts = ["abc", "ABC", None, "", "zzz" * 50]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    frequency, n = language.document_frequencies(frame)
    whole = np.concatenate(list(language.gram_counts(texts)))
    assert n == 5 and (frequency == (whole > 0).sum(axis=0)).all()
    assert whole[0].sum() == 3 + 2 + 1 and (whole[0] == whole[1]).all()
    monkeypatch.setattr(language, "_PIECE", 4)
    assert (np.concatenate(list(language.gram_counts(texts))) == whole).all()


def test_lasso_leaves_zeros_and_temperature_calibrates():
    rng = np.random.default_rng(2)
    rows = [(np.array([k % 2, 2 + int(rng.integers(0, 30))]), np.array([1.0, 0.3])) for k in range(200)]
    classes = np.arange(200) % 2
    weights, bias = language.ftrl(rows, classes, 2, features=40)
    assert (weights[2:] == 0).mean() > 0.8 and weights[0, 0] > 0 > weights[0, 1]
    logits = rng.standard_normal((4000, 3)) * 2
    drawn = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert language.temperature(logits * 5, drawn) == pytest.approx(5, rel=0.1)


# --- cross-entropy difference ------------------------------------------------------------------------------------


def plain_scores(rows, wanted):
    """The same models from dictionaries of strings and of contexts."""
    streams = [(doc, b"\xfe" * 4 + (text or "").encode() + b"\xff") for doc, text in rows]
    target, background = (Counter(), Counter()), (Counter(), Counter())
    for doc, s in streams:
        for i in range(4, len(s)):
            for k in range(1, 6):
                for grams, contexts in [background] + [target] * (doc in wanted):
                    grams[s[i + 1 - k : i + 1]] += 1
                    contexts[k, s[i + 1 - k : i]] += 1
    sizes = [contexts[1, b""] for _, contexts in (target, background)]
    scale = sizes[0] / sizes[1] if sizes[0] else 1.0
    out = []
    for doc, s in streams:
        losses = []
        for (grams, contexts), ratio in ((target, 1.0), (background, scale)):
            loss = 0.0
            for i in range(4, len(s)):
                p = (grams[s[i : i + 1]] * ratio + cross_entropy.FLOOR) / (contexts[1, b""] * ratio + cross_entropy.FLOOR * cross_entropy.SYMBOLS)
                for k in range(2, 6):
                    seen = contexts[k, s[i + 1 - k : i]] * ratio
                    p = (grams[s[i + 1 - k : i + 1]] * ratio + cross_entropy.STRENGTH * p) / (seen + cross_entropy.STRENGTH)
                loss -= math.log(p)
            losses.append(loss / (len(s) - 4))
        out.append((doc, len(s) - 4, *losses, losses[1] - losses[0]))
    return out


@pytest.mark.parametrize("wanted", [{0, 9, 12, 24}, set()])
def test_cross_entropy_difference(spark, wanted):
    ids = spark.createDataFrame([(w,) for w in wanted] + [(None,), (999,)] + [(w,) for w in wanted], "doc_id long")
    got = cross_entropy.cross_entropy_difference(odd_frame(spark), ids).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(plain_scores([(r[0], r[1]) for r in odd_documents()], wanted), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-11)
    assert cross_entropy.cross_entropy_difference(empty_frame(spark), ids).collect() == []


def test_losses_add_up_over_all_symbols(spark):
    """A context's chances of all 257 symbols, seen or not, would sum to one: those of seen ones stay below."""
    rows = [(i, text) for i, text in enumerate(["abcab", "abd", "", "xyzzy" * 9])]
    s = [b"\xfe" * 4 + text.encode() + b"\xff" for _, text in rows]
    counts = Counter(int.from_bytes(x[i - 4 : i + 1]) for x in s for i in range(4, len(x)))
    frame = spark.createDataFrame([(g, n, n) for g, n in counts.items()], "gram long, wanted long, seen long")
    chances = Counter()
    for r in cross_entropy.models(frame).collect():
        assert r.loss_target == pytest.approx(r.loss_background)
        chances[r.gram >> 8] += math.exp(-r.loss_target)
    assert len(chances) > 10 and all(0 < p < 1 for p in chances.values())


def test_small_chunks_and_parts_score_alike(spark, monkeypatch):
    ids = spark.createDataFrame([(0,), (12,)], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    whole = sorted(map(tuple, cross_entropy.cross_entropy_difference(odd_frame(spark), ids).collect()), key=key)
    for name, size in (("PART", 100), ("_SEGMENT", 64)):
        monkeypatch.setattr(cross_entropy, name, size)
    data = np.frombuffer("".join(t or "" for _, t, *_ in odd_documents()).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len((t or "").encode()) for _, t, *_ in odd_documents()])))
    spans = list(cross_entropy._parts(at))
    assert [s[0] for s in spans[1:]] == [s[1] for s in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == len(at) - 1
    stream, places, _ = cross_entropy.token_stream(data, at)
    found, tokens = Counter(), []
    for string, start, token in cross_entropy.runs(stream, places):
        found.update(dict(zip(string.tolist(), np.diff(start, append=len(token)).tolist())))
        tokens.extend(token.tolist())
    assert found == Counter(int.from_bytes(stream[p - 4 : p + 1].tobytes()) for p in places.tolist())
    assert sorted(tokens) == list(range(len(places))) and len(whole) == len(odd_documents())


def test_target_texts_score_higher(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 2 else "".join(rng.choice("qwxyz ") for _ in range(300))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.where("doc_id % 2 = 1 AND doc_id < 60").select("doc_id")
    score = {r.doc_id: r.score for r in cross_entropy.cross_entropy_difference(docs, wanted).collect()}
    assert min(score[i] for i in range(61, 120, 2)) > max(score[i] for i in range(60, 120, 2))


def test_numerals_are_no_letters():
    assert not any(language.has_letter(t) for t in (None, "", " \n", "½", "² 3", "Ⅷ", "①②", "_-1", "٣", "\u0301"))
    assert all(language.has_letter(t) for t in ("a", "½ b", "漢", "ª", "1é", "Ⅷ и"))
