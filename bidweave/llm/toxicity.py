"""Toxicity by a support vector machine over a gapped subsequence kernel, with Nyström landmarks.

The kernel of two tokens counts the ORDER-letter subsequences they share, each weighed by DECAY to
the power of the letters it spans in either, and is normalised by length. An insult with letters
put in between keeps most of its subsequences, so it stays near its plain form. Landmark tokens span
the feature space (Nyström): tokens that cover the toxic texts, usual clean tokens, and the clean
tokens that a first machine takes for insults most easily. A linear machine with squared hinge loss
is trained there as a multiple-instance problem: a labelled text is a bag of tokens, a toxic one has
at least one toxic token, a clean one none, and each round takes a toxic text's most toxic token
under the machine of the round before. Insults of several words are learned only by their words.
Since the machine is linear in the kernel values, its weights are summed once for each subsequence,
and a token is scored by its own subsequences alone, without a pass over the landmarks.

A text's margin is that of its most toxic token; runs
of pieces of one or two letters count as one token, and a token of over WINDOW letters is read in overlapping
windows. A logistic curve fitted to the training texts turns the margin into a probability.

Fitted on FIT_DOCS labelled texts at most, of FIT_BYTES each and FIT_SUM together at most, picked by hash of the id; scoring
reads every text in full, in one pass without a shuffle.

Edge cases: null and empty texts have the margin of a text without tokens; rows with a null id are
scored and never trained on; null labels are no labels, and of several labels for an id the greatest
counts; if the sample lacks one of the classes every score is that class's share; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .wordtokens import by_bytes

ORDER = 3
DECAY = 0.7
LANDMARKS = 72
CLEAN_LANDMARKS = 24
HARD_LANDMARKS = 64
WINDOW, STRIDE = 24, 12
FIRST, LAST = "\x02", "\x03"  # the ends of a token are letters too: a stem is not the words that start with it
FIT_DOCS = 6_000
FIT_BYTES = 100_000
FIT_SUM = 64 << 20
CLEAN_TOKENS = 6_000
HARD_TOKENS = 1_500
ROUNDS = 4
CHANCE = 0.15
MARGIN_COST = 10.0
HELD_OUT_OF = 5
SPANS_AT_ONCE = 1 << 18  # subsequences of tokens worked on together
MOST_KEPT = 250_000  # in each of two generations
ALPHABET = 128
EDGES = ".,;:!?\"'()[]{}<>«»„“”’…-–—*_|/\\~`"
#: Three or more pieces of one or two letters, and of one letter, with any white space between them.
PIECES = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}(?!\S)){2,}")
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")

_spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _spans_of(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of a token of ``length`` letters, and their weights."""
    if length not in _spans:
        at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
        _spans[length] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return _spans[length]


def _letters(token: str) -> bytes:
    """Letter codes: ASCII and the Latin-1 lower-case letters have their own, others share by code point."""
    return bytes([c - 31 if 32 <= c < 127 else c - 128 if 224 <= c < 256 else c % (ALPHABET - 1) + 1 for c in map(ord, token)])


def coded(tokens: Iterable[str]) -> np.ndarray:
    """Letter codes of tokens of WINDOW letters at most; no code is zero."""
    return np.array([_letters(t) for t in tokens], f"S{WINDOW}")


def subsequences(tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For coded tokens of each length: their indices, subsequence codes (row by token) and weights."""
    lengths = np.char.str_len(tokens)
    letters = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, WINDOW)
    for length in np.unique(lengths).tolist():
        if length < ORDER:
            continue
        at, weight = _spans_of(length)
        index = np.flatnonzero(lengths == length)
        step = max(1, SPANS_AT_ONCE // len(at))
        for a in range(0, len(index), step):
            part = index[a : a + step]
            own = letters[part, :length].astype(np.int32)
            codes = np.zeros((len(part), len(at)), np.int32)
            for k in range(ORDER):
                codes *= ALPHABET
                codes += own[:, at[:, k]]
            yield part, codes, weight


def self_kernel(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Kernel of each token with itself: squares of the summed weights of equal subsequences."""
    order = np.argsort(codes, axis=1, kind="stable")
    ranked, w = np.take_along_axis(codes, order, 1), weight[order]
    starts = np.ones(ranked.shape, bool)
    starts[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(starts.ravel()))
    rows = np.flatnonzero(starts.ravel()) // ranked.shape[1]
    return np.bincount(rows, sums**2, len(codes))


def readings(token: str) -> list[str]:
    """What is scored of a token: its bare form and its letters alone, in windows where they are long."""
    bare = token.lower().strip(EDGES)
    forms = [f"{FIRST}{bare}{LAST}"]
    letters = bare if bare.isalpha() else "".join(filter(str.isalpha, bare))
    if letters != bare and (len(letters) > ORDER or 2 * len(letters) > len(bare)):
        forms.append(f"{FIRST}{letters}{LAST}")
    return [f[a : a + WINDOW] for f in forms for a in range(0, max(1, len(f) - WINDOW + STRIDE), STRIDE)]


def disturbed(token: bytes) -> list[bytes]:
    """The coded token with one strange character put in at each place or in each letter's, and with each letter doubled."""
    inner, strange = range(2, len(token) - 1), _letters("\u0111")
    put_in = [token[:i] + strange + token[i:] for i in inner] + [token[:i] + token[i - 1 : i] + token[i:] for i in inner]
    return put_in + [token[:i] + strange + token[i + 1 :] for i in inner if len(token) > 2 * ORDER]


def text_tokens(body: bytes) -> list[bytes]:
    runs = PIECES.findall(body.lower().decode("utf-8", "replace"))
    runs += [single for run in runs for single in SINGLES.findall(run) if single != run]
    return body.lower().split() + ["".join(run.split()).encode() for run in runs]


class Kernel:
    """Normalised kernel values against landmarks."""

    def __init__(self, landmarks: np.ndarray):
        self.landmarks = landmarks
        self.table = np.zeros(ALPHABET**ORDER, np.int32)
        known: dict[int, dict[int, float]] = {}
        for index, codes, weight in subsequences(landmarks):
            norm = np.sqrt(self_kernel(codes, weight))
            for i, row, n in zip(index.tolist(), codes.tolist(), norm.tolist()):
                for code, w in zip(row, weight.tolist()):
                    own = known.setdefault(code, {})
                    own[i] = own.get(i, 0.0) + w / n
        self.codes = np.array(sorted(known), np.int64)
        self.table[self.codes] = np.arange(1, len(self.codes) + 1)
        self.weights = np.zeros((len(self.codes) + 1, len(landmarks)))  # row 0: in no landmark
        for r, code in enumerate(self.codes.tolist(), 1):
            for i, w in known[code].items():
                self.weights[r, i] = w

    def values(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tokens), len(self.landmarks)))
        for index, codes, weight in subsequences(tokens):
            norm = np.sqrt(self_kernel(codes, weight))
            rows = self.table[codes]
            for i, r, n in zip(index, rows, norm):
                hit = r > 0
                out[i] = weight[hit] @ self.weights[r[hit]] / n
        return out

    def collapsed(self, alpha: np.ndarray) -> np.ndarray:
        """Weight of every subsequence in the sum of kernel values weighed by ``alpha``."""
        out = np.zeros(ALPHABET**ORDER, np.float32)
        out[self.codes] = self.weights[1:] @ alpha
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of the linear machine, by Newton steps on the primal problem."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w, active = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active, a = now, x[now] * cost[now, None]
        w = np.linalg.solve(ridge + a.T @ x[now], a.T @ y[now])
    return w


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, with targets drawn in from 0 and 1; the
    rarer label weighs more by the root of its rarity: unweighed, the few toxic texts are called clean up to
    margins far above zero, and weighed to balance, too many clean texts are called toxic."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, (n0 / max(1, n1)) ** 0.5, 1.0)
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)))
        w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return float(w[0]), float(w[1])


class Model:
    """Token margins and text probabilities; keeps the margins of tokens it has met."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, offset: float):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset
        self.kept: dict[bytes, float] = {}
        self.older: dict[bytes, float] = {}

    def token_margins(self, tokens: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """Margins of coded tokens, whose ``norms`` may be known."""
        out = np.full(len(tokens), self.bias)
        for index, codes, weight in subsequences(tokens):
            out[index] += self.table[codes] @ weight / (np.sqrt(self_kernel(codes, weight)) if norms is None else norms[index])
        return out

    def _learn(self, tokens: Iterable[bytes]) -> None:
        tokens = list(tokens)
        known = [t for t in tokens if t in self.older]
        self.kept.update(zip(known, map(self.older.__getitem__, known)))
        tokens = [t for t in tokens if t not in self.older]
        read = [readings(t.decode("utf-8", "replace")) for t in tokens]
        flat = [r for own in read for r in own]
        margin = self.token_margins(coded(flat))
        at = 0
        for token, own in zip(tokens, read):
            self.kept[token] = float(margin[at : at + len(own)].max())
            at += len(own)

    def margins(self, bodies: list[bytes]) -> list[float]:
        return [m for part in by_bytes(bodies) for m in self._margins(part)]

    def _margins(self, bodies: list[bytes]) -> list[float]:
        split = [text_tokens(b) for b in bodies]
        if len(self.kept) > MOST_KEPT:
            self.older, self.kept = self.kept, {}  # what is in use comes back, what is rare goes
        self._learn(set().union(*split) - self.kept.keys())
        get = self.kept.__getitem__
        return [max(map(get, tokens), default=self.bias) for tokens in split]

    def probabilities(self, bodies: list[bytes]) -> np.ndarray:
        m = np.array(self.margins(bodies)).reshape(-1)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))


def norms_of(tokens: np.ndarray) -> np.ndarray:
    out = np.ones(len(tokens), np.float32)
    for index, codes, weight in subsequences(tokens):
        out[index] = np.sqrt(self_kernel(codes, weight))
    return out


def pick_landmarks(owners: list[np.ndarray], in_toxic: np.ndarray, in_clean: np.ndarray, long: np.ndarray, n1: int, n0: int, most: int) -> list[int]:
    """Tokens that together cover the toxic texts, of which ``owners`` holds the tokens."""
    # of tokens that c texts hold, p ** c would be found in toxic texts alone by chance
    by_count = np.bincount(in_toxic + in_clean)
    alone = np.bincount(in_toxic[in_clean == 0], minlength=len(by_count))
    chance = by_count * (n1 / (n1 + n0)) ** np.arange(len(by_count)) / np.maximum(1, alone)
    only = (in_clean == 0) & (chance[in_toxic] < CHANCE)
    mostly = (in_clean > 0) & (in_toxic >= 10) & (in_toxic / n1 > 30 * in_clean / n0)
    able = long & (in_toxic >= 2) & (only | mostly)
    left = [(1.0, own[able[own]].tolist()) for own in owners]
    gain = Counter()
    for w, own in left:
        for t in own:
            gain[t] += w
    out: list[int] = []
    while gain and len(out) < most:
        best = min(gain, key=lambda t: (-gain[t], t))
        out.append(best)
        del gain[best]
        for k, (w, own) in enumerate(left):
            if best in own:
                for t in own:
                    if t in gain:
                        gain[t] -= w / 2
                left[k] = (w / 2, own)
    return out


def _token_table(bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct readings of all texts, coded, and of each text the numbers of its own. Readings are sorted
    by a 64-bit hash of their codes, which takes a third of the memory of sorting the codes themselves."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    parts, hashes = [], []
    for body in bodies:
        readable = sorted({r for t in set(text_tokens(body)) for r in readings(t.decode("utf-8", "replace"))})
        parts.append(coded(readable))
        mixed = (parts[-1].view(np.uint64).reshape(-1, WINDOW // 8) * odd).sum(axis=1, dtype=np.uint64)
        hashes.append((mixed ^ (mixed >> np.uint64(31))) * odd[1])
    ends = np.cumsum([len(h) for h in hashes])
    _, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    del hashes
    owner = np.searchsorted(ends, first, "right")
    words = np.zeros(len(first), f"S{WINDOW}")
    starts = ends - np.array([len(p) for p in parts])
    by_owner = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by_owner], np.arange(len(parts) + 1))
    for k, part in enumerate(parts):
        own = by_owner[cuts[k] : cuts[k + 1]]
        words[own] = part[first[own] - starts[k]]
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    return words[order], [np.unique(x) for x in np.split(rank[at], ends[:-1])]


class Trainer:
    """One machine: landmarks, and rounds in which toxic texts choose a token and clean tokens are added."""

    def __init__(self, words: np.ndarray, norms: np.ndarray, in_clean: np.ndarray, owners: list[np.ndarray]):
        self.words, self.norms, self.in_clean = words, norms, in_clean
        self.other = np.flatnonzero(in_clean > 0)
        self.usual = self.other[np.lexsort((self.other, -in_clean[self.other]))]
        # only what no clean text holds can make a text toxic; a token is numbered within the candidates
        self.candidates = np.unique(np.concatenate(owners)) if owners else np.zeros(0, np.int64)
        self.owners = [np.searchsorted(self.candidates, own) for own in owners]

    def run(self, landmarks: np.ndarray, sure: np.ndarray, rounds: int) -> tuple[Model, np.ndarray]:
        """The machine over ``landmarks``, and the clean tokens that came nearest to being toxic."""
        kernel = Kernel(landmarks)
        gram = kernel.values(landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        strange = np.array(sorted({v for t in sure.tolist() for v in disturbed(t)}), self.words.dtype)
        strange = strange[~np.isin(strange, self.words[self.other])]
        able, norms = self.words[self.candidates], self.norms[self.candidates]
        certain, odd = kernel.values(sure) @ root, kernel.values(strange) @ root
        easy = kernel.values(self.words[self.usual[:: max(1, len(self.usual) // CLEAN_TOKENS)]]) @ root
        score = np.zeros(len(self.candidates))
        score[np.isin(able, sure)] = 1.0
        found = np.zeros(0, np.int64)
        hard = np.zeros((0, len(landmarks)))
        model = Model(kernel.table, 0.0, 1.0, 0.0)
        for turn in range(rounds):
            worst = np.array([own[np.argmax(score[own])] for own in self.owners if len(own)], np.int64)
            worst = worst[score[worst] > 0] if turn else worst  # a text that nothing explains teaches nothing
            groups = [(kernel.values(able[worst]) @ root, 1.0, 1.0), (certain, 1.0, 1.0), (odd, 1.0, 0.5), (easy, -1.0, 2.0), (hard, -1.0, 2.0)]
            target = np.concatenate([np.full(len(g), t) for g, t, _ in groups])
            cost = np.concatenate([np.full(len(g), MARGIN_COST * 1000 * part / max(1, len(g))) for g, _, part in groups])
            w = squared_hinge(np.concatenate([g for g, _, _ in groups]).astype(np.float64), target, cost)
            model = Model(kernel.collapsed(root @ w[:-1]), float(w[-1]), 1.0, 0.0)
            score = model.token_margins(able, norms)
            near = model.token_margins(self.words[self.other], self.norms[self.other])
            order = np.argsort(-near, kind="stable")[:HARD_TOKENS]
            more = np.setdiff1d(self.other[order[near[order] > -1]], found)
            found = np.concatenate([found, more])
            hard = np.concatenate([hard, kernel.values(self.words[more]) @ root])
        return model, self.other[order]


def fit(bodies: list[bytes], y: list[int]) -> Model:
    """Train on texts and their labels."""
    share = sum(y) / len(y) if y else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(ALPHABET**ORDER, np.float32), 0.0, 0.0, 30.0 if share else -30.0)
    words, sets = _token_table(bodies)
    norms, target = norms_of(words), np.array(y)
    count = lambda label: np.bincount(np.concatenate([s for s, t in zip(sets, y) if t == label]), minlength=len(words))
    in_toxic, in_clean = count(1), count(0)
    long = np.char.str_len(words) > ORDER
    toxic_sets = [s for s, t in zip(sets, y) if t]
    chosen = pick_landmarks(toxic_sets, in_toxic, in_clean, long, int(target.sum()), int((1 - target).sum()), LANDMARKS)
    trainer = Trainer(words, norms, in_clean, [s[long[s] & (in_clean[s] == 0)] for s in toxic_sets])
    usual = trainer.usual[long[trainer.usual]][:CLEAN_LANDMARKS]
    sure = words[chosen]
    first = np.concatenate([sure, words[usual]])
    _, near = trainer.run(first, sure, 2)
    # the clean tokens most like insults span the space too, so that the machine can tell the two apart
    beside = words[near[long[near]][:HARD_LANDMARKS]]
    model, _ = trainer.run(np.concatenate([first, beside[~np.isin(beside, first)]]), sure, ROUNDS)
    of_token = model.token_margins(words, norms)
    margin = np.array([of_token[s].max() if len(s) else model.bias for s in sets])
    explained = (target == 0) | (margin > 0)
    model.slope, model.offset = logistic(margin[explained], target[explained])
    return model


_at_work: dict[tuple, Model] = {}


def _worker_model(parts: tuple) -> Model:
    """This worker's model, with the tokens it has met in earlier tasks."""
    name = (*parts[1:], float(parts[0].sum()), float(parts[0].max()))
    if name not in _at_work:
        _at_work.clear()
        _at_work[name] = Model(*parts)
    return _at_work[name]


def held_out(key: str) -> Column:
    """True where the checksum of the id, as text, is divisible by HELD_OUT_OF."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row with the machine fitted to all rows; they are ordered first, so their order does not matter."""
    pairs = sorted((bytes(body), int(y)) for batch in batches for body, y in zip(batch["body"], batch["y"]))
    model = fit([body for body, _ in pairs], [y for _, y in pairs])
    yield pd.DataFrame({"table": [model.table.astype("<f4").tobytes()], "bias": [model.bias], "slope": [model.slope], "offset": [model.offset]})


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", limit: int = FIT_DOCS, most_bytes: int = FIT_SUM) -> DataFrame:
    """``body``, ``y`` of the labelled texts to fit on, none of them held out; bounded in rows and in bytes."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out("key"))
    known = known.groupBy("key").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).where(F.octet_length("body") <= FIT_BYTES)
    able = texts.select("key", F.octet_length("body").alias("size")).join(known, "key").groupBy("key", "y").agg(F.max("size").alias("size"))
    order = [F.xxhash64("key"), F.col("key")]
    first = able.orderBy(*order).limit(limit)  # so the window below has at most that many rows
    usable = first.withColumn("sum", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most_bytes).select("key", "y")
    # of equal texts with several labels the greatest counts, and of one id's texts the first
    return texts.join(F.broadcast(usable), "key").groupBy("body").agg(F.max("y").alias("y")).orderBy(F.md5("body")).limit(2 * limit)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", limit: int = FIT_DOCS) -> Model:
    """Fit on the sample, in one task; the driver receives the machine's table alone."""
    rows = sample(docs, labels, text, key, label, limit)
    made = rows.coalesce(1).mapInPandas(_fitted, "table binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(bytes(made["table"]), "<f4"), made["bias"], made["slope"], made["offset"]) if made else fit([], [])


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability of label 1 as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.slope, model.offset))  # 8 MB

    @F.pandas_udf("double")
    def probability(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _worker_model(shared.value)
        for batch in bodies:
            yield pd.Series(own.probabilities(batch.tolist()))

    return probability(F.coalesce(F.col(text), F.lit("")).cast("binary"))
