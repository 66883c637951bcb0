import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from bidweave.llm import alignment
from bidweave.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def whole(texts):
    """Contract by whole texts, without segments."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = {c: k for k, c in alignment._byte_letters().items()}
    spell_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made = []
    for text in texts:
        if not text:
            made.append(([], [], [], []))
            continue
        want = f" {text}".encode()
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        if b"".join(map(spell_a, x)) != want or b"".join(map(spell_b, y)) != want:
            made.append(([], [], [], []))
            continue
        ends = []
        for ids, spell in ((x, spell_a), (y, spell_b)):
            at, own = 0, {}
            for k, i in enumerate(ids):
                at += len(spell(i))
                own[at] = k
            ends.append(own)
        common = sorted(ends[0].keys() & ends[1].keys())
        groups, p, q = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, x[p : ends[0][e] + 1])) + "|" + ",".join(map(str, y[q : ends[1][e] + 1])))
            p, q = ends[0][e] + 1, ends[1][e] + 1
        made.append((x, y, groups, [(x[ends[0][e]], y[ends[1][e]]) for e in common]))
    count = Counter(p for m in made for p in m[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(len(x), len(y), len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), digest(g)) for x, y, g, k in made]


def held(table, **more):
    rows = table.collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows, whole([r["text"] for r in rows]))), key=str)
    got = sorted((tuple(r) for r in alignment.align(table, A, B, **more).collect()), key=str)
    assert got == want
    return got


def test_against_whole_texts(docs, awkward, nothing):
    assert len(held(docs)) == docs.count()
    held(awkward)
    assert held(nothing) == []


@pytest.mark.parametrize("block_bytes", [1, 300, 8 << 20])
def test_white_space_and_odd_characters(spark, block_bytes):
    texts = [
        "a b", " a", "a ", "  ", "\n", "a\nb", "a\r\nb", "a \r b", "x\r y", "a\t\tb\f\vc", "a b", "a   b", "a  b", "a!\x1c b\x1fc", "a  b", "it's  he'll\n's",
        "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a▁b", "a ▁ b", "​ ​", "﻿ a", "漢字 かな 😀👍🏽", "é é ﬁ ½", "\x00 \x00", "a" * 500 + " " * 500 + "b", "1234567 89,0.1", "a᠎ b", "　 a", ");\r\n */\r x",
    ]
    rnd = random.Random(8)
    alphabet = " \n\t\r \u0085 ▁ab'sé漢<|>1,.  "
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    texts += texts[:50]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sum(r[7] == "" for r in held(table, block_bytes=block_bytes)) > 50


def test_cuts_are_read_from_the_vocabularies():
    assert alignment.cut_characters(["ab", " a", "\n\n", " \t"]) == alignment.CANDIDATES
    assert alignment.cut_characters(["a b", ";\r", " \t"]) == "\t\n\f\v"
    pair = alignment.token_pair(A, B)
    assert pair.segments.split(" a  b\nc\r\nd  e f") == [" a", "  b", "\nc\r\nd  e", " f"]
    assert "".join(pair.segments.split(" x   y\r \n z ")) == " x   y\r \n z "


def test_segments_are_taken_apart_once(spark, monkeypatch):
    table = spark.createDataFrame([(i, "the same words stand here") for i in range(100)], "doc_id long, text string").repartition(4)
    blocks = alignment._blocks(table, "text", "doc_id", (A, B), 1 << 20).where("segments is not null")
    words = blocks.select("block", alignment.F.explode("segments").alias("segment"), alignment.F.lit(1).alias("times"))
    assert words.count() == 20 and alignment._aligned(words, (A, B)).count() == 5
