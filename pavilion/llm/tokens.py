"""Token ids of texts, by word.

The tokenizer's pre-tokenisation never joins text across ASCII white space, so the ids of a text are those of its words
in order. It lower-cases, and a letter followed by an ASCII mark other than an apostrophe always ends a token, so texts are
lower-cased and split there as bytes, all at once, before words are told apart: ``Word,`` is ``word`` and ``,``. Most words
repeat: a bounded table from word to ids takes the place of encoding them again. Words of letters alone are encoded many
at a time: each ends with a token that the vocabulary marks as a word's end, which tells where the next one begins.
Wherever that doesn't hold, words are encoded one by one, and with a tokenizer of another kind texts are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from pavilion.llm.words import buffers

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers (twice: new ones and those before; some 200 bytes each), the longest of them in bytes, and words encoded at once.
MOST_WORDS, MOST_LENGTH, AT_ONCE = 250_000, 64, 64
#: Fixed value: how a tokenizer of this kind splits texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII letters; the marks that end a token after a letter (all but the apostrophe).
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Letters of two bytes, by the first: U+00C0 to U+017F but the signs of times and division, and I with a dot, which is two characters in lower case.
_PAIRS = ((0xC3, (0x97, 0xB7)), (0xC4, (0xB0,)), (0xC5, ()))
#: What forbids to lower-case a text as bytes: special tokens, and the first bytes of marks that compose with ASCII letters.
_AS_IS = (b"<|", b"\xcc", b"\xcd")

_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int = 4) -> WordEncoder:
    """The worker's encoder; its vocabulary and what it learns serve all tasks of the worker."""
    if (path, width) not in _encoders:
        _encoders[path, width] = WordEncoder(path, width)
    return _encoders[path, width]


def split_marks(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space between each letter and a mark after it, and the offsets of rows among them."""
    if len(raw) < 2:
        return raw, offs
    letter = _LETTER[raw]
    for first, others in _PAIRS:
        second = np.flatnonzero(raw[:-1] == first) + 1
        letter[second[~np.isin(raw[second], others)]] = True
    cuts = np.flatnonzero(letter[:-1] & _MARK[raw[1:]]) + 1
    return np.insert(raw, cuts, 0x20), offs + np.searchsorted(cuts, offs)


class WordEncoder:
    """Little-endian unsigned ids of ``width`` bytes each."""

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.kind = Tokenizer.from_file(path), width, f"<u{width}"
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        end = made["model"].get("end_of_word_suffix")
        kinds = json.dumps([made.get("normalizer"), made.get("pre_tokenizer")])
        self.by_word = bool(end) and '"Lowercase"' in kinds and json.dumps(_PATTERN) in kinds
        self.ends = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in made["model"]["vocab"].items() if end and token.endswith(end)]] = True
        self.old: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        ids = np.array(ids, np.int64)
        if len(ids) and ids.max() >> 8 * self.width:
            raise ValueError(f"an id has more than {self.width} bytes")
        return ids.astype(self.kind).tobytes()

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters alone."""
        out, width = [], self.width
        groups = [words[k : k + AT_ONCE] for k in range(0, len(words), AT_ONCE)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int64)
            at = (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1).tolist()
            if len(at) == len(group) and at[-1] == len(ids):
                data = self._packed(ids)
                out += [data[a * width : z * width] for a, z in zip([0, *at], at, strict=False)]
            else:
                out += self._one_by_one(group)
        return out

    def _learn(self, words: list[bytes]) -> None:
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        letters = [k for k, text in enumerate(texts) if text.isalpha()]
        others = sorted({*range(len(words))}.difference(letters)) if len(letters) < len(words) else []
        for at, encode in ((letters, self._letters), (others, self._one_by_one)):
            self.known.update(zip([words[k] for k in at], encode([texts[k] for k in at]), strict=True))

    def rows(self, column: pa.Array) -> list[bytes]:
        """The ids of each row of a string column; of a null row, none."""
        raw, offs = buffers(column)
        if not self.by_word:
            data = raw.tobytes()
            return self._one_by_one([data[a:z].decode("utf-8", "replace") for a, z in zip(offs.tolist(), offs[1:].tolist(), strict=False)])
        data = raw.tobytes()
        if not any(x in data for x in _AS_IS):
            raw, offs = split_marks(raw, offs)
            data = raw.tobytes().lower()
        offs = offs.tolist()
        texts = [data[a:b].split() for a, b in zip(offs, offs[1:], strict=False)]
        if len(self.known) > MOST_WORDS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        fresh = set(chain.from_iterable(texts)).difference(known)
        again = fresh.intersection(old)
        known.update(zip(again, map(old.__getitem__, again), strict=True))
        self._learn([*(fresh - again)])
        out = [b"".join(map(known.__getitem__, words)) for words in texts]
        for w in fresh:
            if len(w) > MOST_LENGTH:
                del known[w]
        return out
