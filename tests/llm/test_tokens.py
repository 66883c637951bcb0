import hashlib
import random
import zlib

import numpy as np
import pytest

from bidweave.llm import bpe, huffman, wordtokens
from bidweave.llm.queries import vocabulary

PIECES = ["a", "the", "The", " ", "  ", "\n", "'s", "don't", "1", "23", "é", "É", "ü,", "über.", "漢字", "😀", "<|endoftext|>", ".", ",", "!?", "\t", "\xa0", "\x1c", "́", "x y", "İ", "Σας", "\x00"]


def mixed(n, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 400))) for _ in range(n)]
    return texts + [t[:60] * 30 for t in texts[:10]] + ["", "a" * 20_000, " " * 20_000 + "b"]


def test_chunks_encode_as_the_library():
    encoder = bpe.ChunkEncoder(vocabulary("byte_bpe_50k.json"))
    for text in mixed(300, 1):
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text.encode()) == want
        assert encoder.decode(want) == encoder.library.decode(want, skip_special_tokens=False)


def test_joins_are_mended_until_they_agree(monkeypatch):
    """With chunks of a few bytes every join matters; a chunk whose own ids are wrong near the join is
    found out by comparing, and the window is widened past the damage."""
    monkeypatch.setattr(bpe, "CUT_BITS", 4)
    monkeypatch.setattr(bpe.cut_points, "__defaults__", (4,))
    encoder = bpe.ChunkEncoder(vocabulary("byte_bpe_50k.json"))
    windows = []
    plain_window = encoder.window
    encoder.window = lambda body: windows.append(len(body)) or plain_window(body)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(("the", "tion", "antidisestablishment", "don't", "x1y2", "über", "漢字", "a,b")) for _ in range(300)) for _ in range(30)]
    for text in texts + mixed(60, 8):
        assert encoder.encode(text.encode()) == encoder.library.encode(text, add_special_tokens=False).ids
    assert windows
    text = texts[0].encode()
    want, narrow = encoder.encode(text), len(windows)
    damaged = encoder.chunk(text[bpe.cut_points(text)[0] : bpe.cut_points(text)[-1]])
    good = list(damaged.ids)
    out, sure = list(encoder.chunk(text[: bpe.cut_points(text)[0]]).ids), [(0, 0)]
    damaged.ids[damaged.heads[0][1]] += 1  # wrong before the second edge: the first window disagrees
    assert not encoder.mend(text, out, sure, bpe.cut_points(text)[0], bpe.cut_points(text)[-1])
    assert len(windows) == narrow + bpe.EDGES - 1
    damaged.ids[:] = good
    assert encoder.encode(text) == want


def test_words_encode_as_the_library():
    encoder = wordtokens.WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = mixed(300, 2)
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_query(docs, awkward, nothing):
    encoder = bpe.ChunkEncoder(vocabulary("byte_bpe_50k.json"))
    for table in (docs, awkward, nothing):
        got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(table, vocabulary("byte_bpe_50k.json")).collect())
        want = []
        for r in table.collect():
            text = r["text"] or ""
            ids = encoder.library.encode(text, add_special_tokens=False).ids
            want.append((r["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want)


def test_code_is_best_and_canonical():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 700):
        counts = rng.zipf(1.3, n) % 10_000 + 1
        lengths = huffman.code_lengths(counts)
        assert n < 2 or sum(2.0**-x for x in lengths) == pytest.approx(1)
        heap = sorted(counts.tolist())
        cost = 0
        while len(heap) > 1:
            merged = heap.pop(0) + heap.pop(0)
            cost += merged
            heap.append(merged)
            heap.sort()
        free = int((huffman.code_lengths(counts, 60) * counts).sum())
        assert n < 2 or free == cost
        code = huffman.Code(list(range(n)), lengths.tolist())
        ids = rng.choice(n, 5000, p=counts / counts.sum()).astype(huffman.IDS)
        for m in (1, 128, 129, 5000):
            assert (code.decode(*code.encode(ids[:m]), m) == ids[:m]).all()


def test_limit_holds():
    counts = np.array([1 << min(i, 50) for i in range(60)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0 ** -int(x) for x in lengths) <= 1


def test_words_of_ascii_letters_take_the_short_way(monkeypatch):
    """Nearly all new words are such; they are neither matched as text nor translated, and words of the older
    generation come back without being taken apart again."""
    encoder, matched = wordtokens.WordEncoder(vocabulary("word_bpe_49k.json")), []
    plain = wordtokens.PLAIN

    class Counted:
        def fullmatch(self, text):
            matched.append(text)
            return plain.fullmatch(text)

    monkeypatch.setattr(wordtokens, "PLAIN", Counted())
    monkeypatch.setattr(wordtokens, "MOST_KEPT", 4)
    texts = ["the Thinorst ieesado, enquechtre. . ,", "Über naïve, a.b x1 É.", "THE ieesado Ieesado. the"]
    want = [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(3):
        assert [encoder.encode([t.encode()])[0] for t in texts] == want
    assert not {"the", "The", "THE", "Thinorst", "ieesado", "Ieesado", "enquechtre"} & set(matched) and "naïve" in matched


def test_files_in_order(spark, docs, awkward, nothing, tmp_path):
    encoder = wordtokens.WordEncoder(vocabulary("word_bpe_49k.json"))
    for k, table in enumerate((docs, awkward, nothing)):
        huffman.save(table, f"{tmp_path}/{k}", vocabulary("word_bpe_49k.json"))
        got = sorted((r["start"], r["key"], r["n_tokens"], r["ids_crc32"]) for r in huffman.read_files(spark, f"{tmp_path}/{k}").collect())
        rows = [(r["doc_id"], encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [huffman.END_ID]) for r in table.collect()]
        keys = [None if k is None else int(k) for _, k, _, _ in got]
        assert keys == sorted(keys, key=lambda x: (x is not None, x or 0))
        at = 0
        for start, _, n, _ in got:
            assert start == at
            at += n
        want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
        assert sorted((str(k), n, c) for _, k, n, c in got) == want
