"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts each text where its content says so; equal passages
of any documents therefore yield equal chunks, which a worker encodes once. What a cut has split is
mended: the text around it is encoded anew, over a window that reaches past a whole piece on either
side which the neighbours have encoded themselves. If the new ids of both pieces agree with the
neighbours' own exactly, the window takes the cut's place; if not, it is widened, in the end to the
whole text. Windows begin and end at sure edges, a single space between two plain ASCII characters:
no piece of the pattern reaches over one. A chunk with too few edges to be checked is joined to the
next one before it is encoded.

Edge cases: null and empty texts have no ids and decode to the empty text; the special token's own
letters become its id, as in the library; texts without a cut or an edge are encoded whole; an empty
table gives an empty result; repeated rows and null ids are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_STEPS = 4  # the hash covers 2 ** WINDOW_STEPS bytes
CUT_BITS = 9  # a chunk has 2 ** CUT_BITS bytes on the mean
KEPT_BYTES = 64 << 20
KEPT_WINDOWS = 200_000
EDGES = 4  # edges kept of either end of a chunk: a window is widened so often before the whole text is encoded
EDGE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(body: bytes, cut_bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``body``, the last one excepted; never inside a character."""
    raw = np.frombuffer(body, np.uint8)
    h = _GEAR[raw]
    for k in range(WINDOW_STEPS):
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step) if len(h) > step else 0
    at = np.flatnonzero(h >> np.uint32(32 - cut_bits) == 0) + 1
    at = at[at < len(raw)]
    return at[(raw[at] & 0xC0) != 0x80].tolist()


class Chunk:
    """Ids of a chunk, with its first and last sure edges as (bytes, tokens) from its start."""

    __slots__ = ("ids", "heads", "tails")

    def __init__(self, body: bytes, ids: list[int], lengths: np.ndarray):
        self.ids = ids
        at = [m.start() for m in EDGE.finditer(body)]
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])
        token = np.searchsorted(ends, at)
        edges = [(b, t) for b, t in zip(at, token.tolist()) if ends[t] == b]
        self.heads, self.tails = edges[:EDGES], edges[-EDGES:]


class ChunkEncoder:
    """Encodes and decodes UTF-8 bytes as the library does with the file at ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        alphabet = {c: b for b, c in _byte_letters().items()}
        assert set(alphabet) == set(pre_tokenizers.ByteLevel.alphabet())
        ranks = {bytes(alphabet[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token not in special}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = {t.encode(): i for t, i in special.items()}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if special else None
        self.chunks: dict[bytes, Chunk] = {}
        self.windows: dict[bytes, list[int]] = {}
        self.held = 0

    def plain(self, body: bytes) -> list[int]:
        text = body.decode()
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the pattern's engine gives up on endless white space with a panic, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.library.encode(text, add_special_tokens=False).ids

    def chunk(self, body: bytes) -> Chunk:
        found = self.chunks.get(body)
        if found is None:
            if self.held > KEPT_BYTES:
                self.chunks, self.held = {}, 0
            found = self.chunks[body] = Chunk(body, self.plain(body), self.lengths)
            self.held += len(body) * 4
        return found

    def window(self, body: bytes) -> list[int]:
        found = self.windows.get(body)
        if found is None:
            if len(self.windows) > KEPT_WINDOWS:
                self.windows = {}
            found = self.plain(body)
            if len(body) < 96:
                self.windows[body] = found
        return found

    def section(self, body: bytes) -> list[int]:
        """Ids of a text without special tokens."""
        cuts = cut_points(body)
        if not cuts:
            return self.plain(body)
        first = self.chunk(body[: cuts[0]])
        out, sure = list(first.ids), [(0, 0), *first.tails]
        start = seen = cuts[0]
        edges = 0
        for end in [*cuts[1:], len(body)]:
            while edges < 2 and (edge := EDGE.search(body, seen, end)):
                edges, seen = edges + 1, edge.end()
            if edges == 2 or end == len(body):
                if not self.mend(body, out, sure, start, end):
                    return self.plain(body)
                start, edges = end, 0
            seen = end
        return out

    def mend(self, body: bytes, out: list[int], sure: list[tuple[int, int]], start: int, end: int) -> bool:
        """Adds the ids of ``body[start:end]`` to ``out``, which holds those of what comes before, with
        its last ``sure`` edges; False if no window agrees with both sides."""
        own = self.chunk(body[start:end])
        for reach in range(1, EDGES):
            left, last = sure[max(0, len(sure) - 1 - reach)], sure[-1]
            right = own.heads[reach] if len(own.heads) > reach else (end - start, len(own.ids))
            before = out[left[1] : last[1]]
            after = own.ids[own.heads[0][1] : right[1]] if own.heads else []
            new = self.window(body[left[0] : start + right[0]])
            if new[: len(before)] == before and new[len(new) - len(after) :] == after:
                del out[left[1] :]
                out += new
                shift = len(out) - right[1]
                out += own.ids[right[1] :]
                known = [e for e in sure if e[0] <= left[0]] + [(start + b, t + shift) for b, t in sorted({*own.tails, right}) if t >= right[1] and start + b < end]
                sure[:] = known[-2 * EDGES :]
                return True
        return False

    def encode(self, body: bytes) -> list[int]:
        if self.split is None:
            return self.section(body) if body else []
        out: list[int] = []
        for part in self.split.split(body):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.section(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")


#: Fixed value: the split pattern of byte-level BPE, as the vocabulary's notes give it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a file; it lives as long as the worker."""
    return ChunkEncoder(path)


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            encode = chunk_encoder(tokenizer).encode
            yield pd.DataFrame({"key": batch["key"], "ids": [encode(t or b"") for t in batch["body"]]})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("body"))
    return rows.mapInPandas(run, "key string, ids array<int>").select(F.col("key").cast(docs.schema[key].dataType).alias(key), "ids")


def decode_texts(rows: DataFrame, tokenizer: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of every row of ``ids``; null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decode = chunk_encoder(tokenizer).decode
            yield pd.DataFrame({"key": batch["key"], "text": [None if x is None else decode(x.tolist()) for x in batch["ids"]]})

    out = rows.select(F.col(key).cast("string").alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInPandas(run, "key string, text string")
    return out.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "text")


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens`` and digests of the ids and of the text decoded from them, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            encoder = chunk_encoder(tokenizer)
            n, ids_digest, text_digest = [], [], []
            for body in batch["body"]:
                ids = encoder.encode(body or b"")
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_digest.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"key": batch["key"], "n_tokens": n, "ids_sha256": ids_digest, "decoded_sha256": text_digest})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("body"))
    made = rows.mapInPandas(run, "key string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_tokens", "ids_sha256", "decoded_sha256")
