"""Token ids of whole texts by the tokenizers library, piece by piece with a cache.

The vocabulary files in use never form a token across two kinds of places:
where ASCII white space follows anything but white space, and where ASCII
punctuation follows an ASCII letter.  So a text is cut there, each distinct
piece of a batch is encoded once, and the pieces' ids are strung together;
that equals encoding the whole text (``tests/llm`` holds this against the
library).
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from wardline.llm.common import column_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER
_MARK[48:58] = False

CACHED_PIECES = 600_000  # held by each Python worker; of more, those go that were not met for the longest time
CACHED_BYTES = 64  # longer pieces hardly come again
JOINED = 256  # single words that go to the library in one text


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder:
    """Ids of texts under one vocabulary file of fewer than 65,536 ids, as the library gives for whole texts.

    Where a text holds the string of an added token, which the library finds
    before anything else, it is not cut at all.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("added tokens that are looked for in normalised text")
        self.added = [t.content.encode() for t in added]
        self.known: dict[bytes, bytes] = {}  # pieces met since ``earlier`` was last replaced
        self.earlier: dict[bytes, bytes] = {}
        # where one word ends among the ids of many: by the words' bytes, or by the tokens that end a word
        vocabulary = self.tokenizer.get_vocab()
        self.ends_words = sum(t.endswith("</w>") for t in vocabulary) > len(vocabulary) // 4
        self.measure = np.zeros(1 << 16, np.int64)
        for token, n in vocabulary.items():
            self.measure[n] = token.endswith("</w>") if self.ends_words else len(token)

    def _one_word(self, piece: bytes) -> bool:
        """Whether a piece stays one word beside others: letters alone, after one blank where blanks belong to tokens."""
        if self.ends_words:
            word = piece.lstrip(b" \n")
            if word.isascii():
                return word.isalpha()
            text = word.decode()
            return text.isalpha() and text.lower().isalpha()
        return piece[:1] == b" " and (piece[1:].isalpha() if piece.isascii() else piece[1:].decode().isalpha())

    def _surely_one_word(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``_one_word`` of pieces that are ASCII letters after one blank; False says nothing."""
        letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
        return (data[start] == 32) & (end - start > 1) & (letters[end] - letters[start] == end - start - 1)

    def _fresh(self, pieces: list[bytes], sure: list[bool]) -> list[bytes]:
        """The ids of each piece, packed."""
        out: list[bytes] = [b""] * len(pieces)
        single = [known or self._one_word(p) for p, known in zip(pieces, sure, strict=True)]
        others = [n for n, alone in enumerate(single) if not alone]
        words = [n for n, alone in enumerate(single) if alone]
        texts = [pieces[n].decode() for n in others]
        for n, found in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[n] = np.array(found.ids, np.uint16).tobytes()
        if not words:
            return out
        asked = [pieces[n] for n in words]
        glue = b" " if self.ends_words else b""
        joined = [glue.join(asked[k : k + JOINED]).decode() for k in range(0, len(asked), JOINED)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(f.ids for f in found), np.uint16)
        passed = np.cumsum(self.measure[ids])
        goal = np.arange(1, len(asked) + 1) if self.ends_words else np.cumsum(np.fromiter(map(len, asked), np.int64, len(asked)))
        ends = np.searchsorted(passed, goal) + 1
        if ends[-1] != len(ids) or (passed[ends - 1] != goal).any():
            raise AssertionError("words were not kept apart")
        raw, first = ids.tobytes(), 0
        for n, end in zip(words, (2 * ends).tolist(), strict=True):
            out[n] = raw[first:end]
            first = end
        return out

    def _uncut(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        """The texts that hold the string of an added token."""
        places = []
        for content in self.added:
            here = raw.find(content)
            while here >= 0:
                places.append(here)
                here = raw.find(content, here + 1)
        return np.unique(np.searchsorted(at, places, side="right") - 1) if places else np.zeros(0, np.int64)

    def _look_up(self, keys: list[bytes], sure: list[bool]) -> list[bytes]:
        """The packed ids of different pieces; pieces met again move up, so that frequent ones stay."""
        ids = list(map(self.known.get, keys))
        missing = []
        for n in [n for n, x in enumerate(ids) if x is None]:
            found = self.earlier.get(keys[n])
            if found is None:
                missing.append(n)
            else:
                ids[n] = self.known[keys[n]] = found
        for n, found in zip(missing, self._fresh([keys[n] for n in missing], [sure[n] for n in missing]), strict=True):
            ids[n] = found
            if len(keys[n]) <= CACHED_BYTES:
                self.known[keys[n]] = found
        if len(self.known) > CACHED_PIECES // 2:
            self.known, self.earlier = {}, self.known
        return ids

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end as uint16, number of ids of each); a null text has none."""
        data, at = column_bytes(texts)
        lengths = np.diff(at)
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(lengths), np.int64)
        raw = data.tobytes()
        space = _SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if any(w in raw for w in _WIDE_SPACE):  # white space beyond ASCII before a cut could join what follows
            cut[1:] &= data[:-1] < 128
            for odd in (0x1C, 0x1D, 0x1E, 0x1F):
                cut[1:] &= data[:-1] != odd
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        for n in self._uncut(raw, at).tolist():
            cut[at[n] : at[n + 1]] = False
        cut[at[:-1][lengths > 0]] = True
        start = np.flatnonzero(cut)
        bounds = np.append(start, len(data))
        # equal pieces meet by their bytes
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        of = np.asarray(coded.indices)
        _, offsets, distinct = coded.dictionary.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1]
        different, places = distinct.to_pybytes(), edges.tolist()
        keys = [different[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        sure = self._surely_one_word(np.frombuffer(different, np.uint8), edges[:-1], edges[1:]).tolist()
        ids = self._look_up(keys, sure)
        flat = np.frombuffer(b"".join(ids), np.uint16)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        begin = np.cumsum(sizes) - sizes
        per_piece = sizes[of]
        ends = np.cumsum(per_piece)
        out = flat[np.repeat(begin[of] - (ends - per_piece), per_piece) + np.arange(int(ends[-1]) if len(ends) else 0)]
        before = np.concatenate(([0], ends))
        text_cut = np.searchsorted(start, at)  # first piece at or after each text's start
        return out, np.diff(before[text_cut])


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that its cache outlives a task."""
    return PieceEncoder(path)
