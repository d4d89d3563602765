import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import empty_frame, odd_documents, odd_frame
from wardline.llm import harmonic, rans, tokens
from wardline.llm.common import workspace

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_equal_whole_texts(path):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "́", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x85", "\x1c", "!", "'s", "'", "12", "|", "Σ", "ς", "<|endoftext|>", "漢", "\U0001f600", "the", " of"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [r[1] for r in odd_documents()]
    encode = library(path)
    for cut in range(0, len(texts), 500):
        part = texts[cut : cut + 500]
        ids, sizes = tokens.PieceEncoder(path).encode(pa.array(part, pa.string()))
        ends = np.cumsum(sizes)
        for text, a, b in zip(part, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == encode(text), repr(text)


def thue_morse(length):
    """A string and its complement, which polynomial hashes modulo 2**64 cannot tell apart."""
    bits = [bin(n).count("1") % 2 for n in range(length)]
    return ["".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_are_told_apart_by_their_bytes(path):
    encoder, encode = tokens.PieceEncoder(path), library(path)
    for texts in (thue_morse(2048), [" " + t for t in thue_morse(4096)], [t + "1" for t in thue_morse(1024)]):
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in encode(t)] and sizes.tolist() == [len(encode(t)) for t in texts]
        for t in reversed(texts):  # across batches as well
            assert encoder.encode(pa.array([t]))[0].tolist() == encode(t)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_strings_of_added_tokens(path):
    """The library gives them their own ids wherever they stand, and so do pieces."""
    encode = library(path)
    texts = ["a <|endoftext|> b", "plain text, as ever", "x<|endoftext|>", "<|endoftext|><|endoftext|>", None, "", "<|endoftext |>", "<|startoftext|> a.b c"]
    ids, sizes = tokens.PieceEncoder(path).encode(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(encode(t)) for t in texts] and ids.tolist() == [i for t in texts for i in encode(t)]
    assert (ids >= 49406).any()


def test_frequent_pieces_stay_in_the_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 20)
    encode = tokens.PieceEncoder(BYTES)
    asked, fresh = [], encode._fresh
    monkeypatch.setattr(encode, "_fresh", lambda pieces, sure: asked.extend(pieces) or fresh(pieces, sure))
    for n in range(40):
        encode.encode(pa.array([f"x water {chr(97 + n % 26)}{chr(97 + n // 26)}q {chr(97 + n % 26)}{chr(97 + n // 26)}z"]))
    assert asked.count(b" water") == 1 and len(asked) == 2 + 2 * 40
    assert len(encode.known) + len(encode.earlier) <= 20 + 4


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 3)
    encoder, encode = tokens.PieceEncoder(BYTES), library(BYTES)
    for _ in range(3):
        texts = [r[1] for r in odd_documents()]
        ids, _ = encoder.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in encode(t)]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, 65536, 200_001])
def test_segments_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint16)
    sizes = np.array([n // 3, n - n // 3])
    row = rans.encode_segment(1, 2, np.array([4, 9]), sizes, ids).to_pylist()[0]
    docs, back, out = rans.decode_segment(row)
    assert docs.tolist() == [4, 9] and back.tolist() == sizes.tolist() and (out == ids).all()
    if n > 60_000:
        assert sum(map(len, row["words"])) < 2 * n
    row["states"][0] = row["states"][0][:-1] + bytes([row["states"][0][-1] ^ 1])
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_segment(row)


def test_every_table_of_a_segment_is_covered():
    """Frequencies swapped, ids moved from one document to the next, another step count: none goes unnoticed."""
    ids = (np.random.default_rng(3).zipf(1.3, 20_000) % 500).astype(np.uint16)
    row = rans.encode_segment(1, 2, np.array([4, 9]), np.array([9_000, 11_000]), ids).to_pylist()[0]
    freq = np.frombuffer(row["frequencies"], "<u4").copy()
    freq[[0, 1]] = freq[[1, 0]]
    changes = {
        "frequencies": freq.tobytes(), "symbols": row["symbols"][2:4] + row["symbols"][:2] + row["symbols"][4:],
        "doc_sizes": np.array([9_500, 10_500], "<u8").tobytes(), "doc_ids": np.array([4, 8], "<i8").tobytes(),
        "block_steps": bytes(len(row["block_steps"])), "n_tokens": 19_999, "segment": 3}
    for name, value in changes.items():
        assert row[name] != value
        with pytest.raises(ValueError, match="damaged"):
            rans.decode_segment({**row, name: value})
    assert (rans.decode_segment(row)[2] == ids).all()


def test_one_id_only_and_every_id():
    for ids in (np.full(300, 7, np.uint16), np.arange(1 << 16).astype(np.uint16)):
        assert (rans.decode_segment(rans.encode_segment(0, 0, np.array([1]), np.array([len(ids)]), ids).to_pylist()[0])[2] == ids).all()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    path = workspace(spark, "tokens")
    rans.write_tokens(odd_frame(spark), path, BYTES)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read_documents(spark, path).collect())
    encode = library(BYTES)
    rows = spark.createDataFrame([(r[0], r[1]) for r in odd_documents() if r[0] is not None], "doc_id long, text string")
    start, want = 0, []
    for r in rows.selectExpr("*", "xxhash64(text) AS h").orderBy("doc_id", "h", "text").collect():
        ids = [*encode(r.text), 2]
        want.append((start, r.doc_id, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    path = workspace(spark, "tokens")
    rans.write_tokens(empty_frame(spark), path, BYTES)
    assert rans.read_documents(spark, path).collect() == []


def test_packing(spark):
    rows = odd_documents()
    got = harmonic.pack_documents(odd_frame(spark), WORDS).collect()
    encode = library(WORDS)
    whole = {}
    for r in rows:
        if r[0] is not None:
            whole.setdefault(r[0], []).append([*encode(r[1]), 2])
    pieces = {}
    for g in got:
        pieces.setdefault((g.doc_id, g.doc_tokens), []).append(g)
    for doc, all_ids in whole.items():
        for ids in all_ids:
            own = sorted(pieces[doc, len(ids)], key=lambda g: g.start)
            if sum(1 for other in all_ids if len(other) == len(ids)) == 1:
                assert [g.start for g in own] == np.cumsum([0, *(g.length for g in own)])[:-1].tolist()
                assert [g.ids_crc32 for g in own] == [crc(ids[g.start : g.start + g.length]) for g in own]
            assert sum(g.length for g in own) == len(ids) * sum(1 for other in all_ids if len(other) == len(ids))
    filled = {}
    for g in got:
        filled.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= 4096 and total & (total - 1) == 0
    assert harmonic.pack_documents(empty_frame(spark), WORDS).collect() == []


def test_workers_fill_bins_on_their_own(spark):
    rows = [(i, i, 0, 1 << (i % 13), 0, 0) for i in range(4000)]
    cuts = spark.createDataFrame(rows, "doc_id long, row_key long, start long, length int, ids_crc32 long, doc_tokens long")
    one = harmonic.pack(cuts, workers=1).groupBy("sequence_id").sum("length").collect()
    many = harmonic.pack(cuts, workers=7).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in one) == sum(r[1] for r in many) == sum(r[3] for r in rows)
    assert all(r[1] & (r[1] - 1) == 0 and r[1] <= 4096 for r in one + many)
    assert sum(r[1] == 4096 for r in one) >= sum(r[1] == 4096 for r in many) > 0
