"""Alignment of the ids of two tokenizers, each distinct segment taken apart once.

A text is split before runs of white space, at those characters alone where neither vocabulary holds
an entry that could merge across (``cut_characters`` reads both vocabularies for it), so the ids of a
text are those of its segments in turn. Tasks number the segments of blocks of documents and write
the blocks with their segments; a segment's occurrences meet only as one row for each block. Distinct
segments are then tokenised and aligned once, the links they hold are counted over the corpus, the
alignments are joined back to the blocks' segments, and each block's documents are composed of them.

No group grows with the corpus but a segment's rows, one for each block that holds it, which are
added up before they are shuffled and joined as rows. Blocks are bounded by BLOCK_BYTES (or one
document), the ids linked to one id by the size of a vocabulary.

Edge cases: null and empty texts, and texts that either tokenizer does not give back byte for byte,
have no tokens: zeros and an empty digest; their links are not counted. Repeated rows and null ids are
each composed; texts without white space are one segment; an empty table gives an empty result; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .staging import scratch, stage

BLOCK_BYTES = 32 << 20
BATCH = 4_000  # segments given to a tokenizer at a time
ANCHOR = "a"  # stands before a segment, so that the second tokenizer's own first space is not the segment's

#: White space of any kind that a pattern might know, and what the second vocabulary writes for a space.
SPACES = r"\s\u2581\u180e\u200b\ufeff"
CANDIDATES = " \t\n\r\f\v"


def cut_characters(entries: list[str]) -> str:
    """Those white space characters that no entry holds behind something other than white space."""
    crossing = set().union(*(re.findall(rf"(?<=[^{SPACES}])[{CANDIDATES}]", e) for e in entries))
    return "".join(c for c in CANDIDATES if c not in crossing)


class Segments:
    """Splits texts where a run of white space begins with one of ``cut``."""

    def __init__(self, cut: str):
        w = f"[{re.escape(cut)}]"
        other = rf"(?:[^\S{re.escape(cut)}]|[\u2581\u180e\u200b\ufeff])"
        self.other = re.compile(other)
        self.plain = re.compile(rf"{w}*[^{re.escape(cut)}]+|{w}+").findall
        # a run that another kind of white space begins is not cut
        self.mixed = re.compile(rf"{w}*(?:{other}{w}*|[^{re.escape(cut)}])+|{w}+").findall

    def split(self, text: str) -> list[str]:
        return self.mixed(text) if self.other.search(text) else self.plain(text)


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class TokenPair:
    """A byte-level tokenizer file (A) and a piece model (B) with the bytes of all their entries."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        if self.a.normalizer is not None or type(self.a.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("the first tokenizer must be byte-level without a normaliser")
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = {c: b for b, c in _byte_letters().items()}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a: dict[int, bytes] = {i: e.encode() if e in special else bytes(alphabet[c] for c in e) for e, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if not all(self.bytes_a.values()) or not all(self.bytes_b):
            raise ValueError("an entry without bytes would end where another ends")
        entries = [e.decode(errors="replace") for e in (*self.bytes_a.values(), *self.bytes_b)]
        self.segments = Segments(cut_characters(entries))
        self.lead = self.b.encode(ANCHOR, num_threads=1)

    def faithful(self, text: str) -> bool:
        """Whether B's pieces spell the text: they spell what its normaliser makes of it."""
        return self.b.normalize(text).replace("▁", " ") == f" {text}"

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both for each segment, as inside any text."""
        ids_a = (e.ids for e in self.a.encode_batch(segments, add_special_tokens=False))
        ids_b = self.b.encode([ANCHOR + s for s in segments], num_threads=1)
        for s, a, b in zip(segments, ids_a, ids_b):
            if b[: len(self.lead)] != self.lead:
                raise ValueError(f"a piece reaches over the cut before {s!r}")
            yield a, b[len(self.lead) :]

    def align(self, segments: list[str]) -> Iterator[dict]:
        """Ids counted, groups between common ends, and pairs of ids that end together."""
        for s, (a, b) in zip(segments, self.encode(segments)):
            ends_a = np.cumsum([len(self.bytes_a[i]) for i in a]).tolist()
            ends_b = np.cumsum([len(self.bytes_b[i]) for i in b]).tolist()
            if not ends_a or not ends_b or not ends_a[-1] == ends_b[-1] == len(s.encode()):
                raise ValueError(f"ids do not spell the segment {s!r}")
            links, groups = [], []
            i = j = from_i = from_j = 0
            while i < len(a) and j < len(b):
                if ends_a[i] == ends_b[j]:
                    links.append((a[i], b[j]))  # no entry is empty, so a group ends in one link
                    groups.append(",".join(map(str, a[from_i : i + 1])) + "|" + ",".join(map(str, b[from_j : j + 1])))
                    from_i, from_j = i + 1, j + 1
                    i, j = i + 1, j + 1
                elif ends_a[i] < ends_b[j]:
                    i += 1
                else:
                    j += 1
            yield {"n_a": len(a), "n_b": len(b), "groups": ";".join(groups), "links": links}


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(path_a: str, path_b: str) -> TokenPair:
    """This worker's pair of tokenizers; it lives as long as the worker."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = TokenPair(path_a, path_b)
    return _pairs[path_a, path_b]


def _blocks(docs: DataFrame, text: str, key: str, paths: tuple[str, str], block_bytes: int) -> DataFrame:
    """For each block of documents one row with its segments and how often its texts hold them, and one
    row for each document with its segments' numbers (none where it has no tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, block = token_pair(*paths), TaskContext.get().partitionId() << 32
        number, size, keys, ids = Numbered(), 0, [], []

        def close() -> Iterator[pd.DataFrame]:
            n = len(keys)
            yield pd.DataFrame({"block": [block] * n, "key": keys, "ids": ids, "segments": [None] * n, "times": [None] * n})
            if number:
                times = np.bincount(np.frombuffer(b"".join(ids), "<i4"), minlength=len(number))
                yield pd.DataFrame({"block": [block], "key": [None], "ids": [None], "segments": [list(number)], "times": [times]})

        for batch in batches:
            for own, body in zip(batch["key"], batch["text"]):
                keys.append(own)
                if body and pair.faithful(body):
                    ids.append(np.array([number[s] for s in pair.segments.split(f" {body}")], "<i4").tobytes())
                    size += len(body)
                else:
                    ids.append(b"")
                if size >= block_bytes:
                    yield from close()
                    block, number, size, keys, ids = block + 1, Numbered(), 0, [], []
        if keys:
            yield from close()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "block long, key string, ids binary, segments array<string>, times array<long>")


def _aligned(words: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each distinct segment with its occurrences and its alignment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = token_pair(*paths)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                made = pd.DataFrame(pair.align(part["segment"].tolist()))
                yield pd.concat([part.reset_index(drop=True), made], axis=1)

    distinct = words.groupBy("segment").agg(F.sum("times").alias("times"))
    aligned = distinct.mapInPandas(run, "segment string, times long, n_a int, n_b int, groups string, links array<struct<a:int,b:int>>")
    return aligned.withColumn("sid", F.monotonically_increasing_id())


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` over the corpus, and whether it is the highest of its ``b``."""
    links = aligned.select("times", F.explode("links").alias("l")).select("times", "l.a", "l.b")
    counted = links.groupBy("a", "b").agg(F.sum("times").alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _composed(paths: tuple[str, str]):
    """The function that makes a block's documents out of its segments' alignments."""
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("local")
        words["n_groups"] = words["n_links"] = words["groups"].str.count(";") + 1
        values, groups = words[numbers].to_numpy(np.int64).reshape(-1, len(numbers)), words["groups"].tolist()
        sums, digests = np.zeros((len(docs), len(numbers)), np.int64), []
        for k, packed in enumerate(docs["ids"]):
            ids = np.frombuffer(packed, "<i4")
            sums[k] = values[ids].sum(axis=0) if len(ids) else 0
            digests.append(hashlib.sha256(";".join(map(groups.__getitem__, ids.tolist())).encode()).hexdigest() if len(ids) else "")
        return pd.DataFrame({"key": docs["key"], **dict(zip(numbers, sums.T)), "groups_sha256": digests})

    return run, "key string, " + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key``, counts of ids, groups, links and best links, sum of the links' counts and digest of the groups of every document."""
    paths = (path_a, path_b)
    with scratch(docs.sparkSession) as keep:
        blocks = keep(stage(_blocks(docs, text, key, paths, block_bytes), "align-blocks"))
        words = blocks.where("segments is not null").select("block", F.posexplode(F.arrays_zip("segments", "times")).alias("local", "w"))
        words = words.select("block", "local", F.col("w.segments").alias("segment"), F.col("w.times").alias("times"))
        aligned, _ = stage(_aligned(words, paths), "align-segments")
        counts, _ = stage(link_counts(aligned), "align-pairs")
        links = aligned.select("sid", F.explode("links").alias("l")).select("sid", "l.a", "l.b").join(counts.hint("merge"), ["a", "b"])
        weighed = links.groupBy("sid").agg(F.sum(F.col("best").cast("int")).cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        known = aligned.select("sid", "segment", "n_a", "n_b", "groups").join(weighed.hint("merge"), "sid")
        joined = words.select("block", "local", "segment").join(known.hint("merge"), "segment")
        back = keep(stage(joined.drop("segment", "sid"), "align-words"))
    compose, schema = _composed(paths)
    made = blocks.where("ids is not null").select("block", "key", "ids").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(compose, schema)
    return made.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
