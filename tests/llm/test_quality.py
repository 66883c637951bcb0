import random
import re
from collections import Counter

from bidweave.llm import quality


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts_against_brute_force(docs, awkward, nothing):
    for table in (docs, awkward, nothing):
        got = sorted(
            (str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            for r in quality.score(table).collect()
        )
        assert got == sorted((str(r["doc_id"]), *counts(r["text"])) for r in table.collect())


def test_line_separators_at_the_end_are_words(spark):
    """White space before a final U+0085, U+2028 or U+2029 separates words like any other."""
    ends = ["\u0085", "\u2028", "\u2029", "\r\n", "\n", ""]
    texts = [f"{a}one two {b}{c}" for a in ends for b in ends for c in ends] + [f"foo {e}" for e in ends] + ends
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.score(table).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_failed_rows_are_not_kept(docs):
    rows = quality.score(docs).collect()
    assert not any(r["kept"] and r["base_failed"] for r in rows) and all(0 <= r["quality"] <= 1 for r in rows)
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in rows if r["kept"]}


def test_variety_does_not_switch_with_length(spark):
    few, many = [f"w{i}" for i in range(100)], [f"w{i}" for i in range(9000)]
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(few) for _ in range(n)) for n in (3999, 4000, 4001, 20_000)] + [" ".join(rnd.choice(many) for _ in range(n)) for n in (4000, 4001, 20_000)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    votes = {r["doc_id"]: r["vote_variety"] for r in quality.votes(quality.features(table)).collect()}
    assert [votes[i] for i in range(len(texts))] == [-1] * 4 + [1] * 3
