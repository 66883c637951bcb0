"""Ids of whole texts by a word-level BPE tokenizer file, word by word.

The tokenizer drops white space and never merges across it, so a text's ids are those of its
space-separated stretches in turn. Each worker keeps the ids of the stretches it has met; a new one
is taken apart (plain letters, then one closing point or comma) where that provably cannot change
its ids, and goes through the library otherwise.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Letters that the file's normaliser only lower-cases, so that a run of them is one piece.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
CLOSING = (b".", b",")
MOST_KEPT = 250_000  # in each of two generations
SLICE_BYTES = 2 << 20


def by_bytes(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Runs of ``texts`` of about ``most`` bytes, so that few texts are held as words at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class WordEncoder:
    """Encodes UTF-8 texts to arrays of ids, as bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = _byte_letters()
        each = np.arange(self.tokenizer.get_vocab_size()).astype(dtype)
        self.packed = [x.tobytes() for x in each]
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.closing = {c: self._pack(self._library([c.decode()])[0]) for c in CLOSING}

    def _library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(map(self.packed.__getitem__, ids))

    def _learn(self, words: set[bytes]) -> None:
        kept, older, hard = self.kept, self.older, []
        piece, packed = self.tokenizer.model.tokenize, self.packed
        known = words & older.keys()
        kept.update(zip(known, map(older.__getitem__, known)))
        for word in words - known:
            end = word[-1:] if word.endswith(CLOSING) else b""
            core = word[:-1] if end else word
            if core.isalpha():  # of bytes: ASCII letters, which stand for themselves in the byte-level alphabet
                raw = core.lower()
                spelt = raw.decode("ascii")
            elif PLAIN.fullmatch(text := core.decode()):
                raw = text.lower().encode()
                spelt = None
            else:
                hard.append(word)
                continue
            if (ids := kept.get(raw) or older.get(raw)) is None:
                spelt = spelt or raw.decode("latin-1").translate(self.letters)
                ids = kept[raw] = b"".join([packed[t.id] for t in piece(spelt)])
            kept[word] = ids + self.closing[end] if end else ids
        for word, ids in zip(hard, self._library([w.decode() for w in hard])):
            kept[word] = self._pack(ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [ids for part in by_bytes(texts) for ids in self._encode(part)]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.kept) > MOST_KEPT:
            self.older, self.kept = self.kept, {}  # what is in use comes back, what is rare goes
        split = [t.split() for t in texts]  # of bytes: at the six ASCII white space characters
        self._learn(set().union(*split).difference(self.kept))  # of a dict: looks words up, where its keys would all be gone through
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
