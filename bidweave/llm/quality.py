"""Quality by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over
the table of distinct vote vectors (at most 3 ** number of rules rows, whatever the corpus size)
estimates how each rule votes on good and on bad documents; a document's verdict is the posterior
probability of "good", so that no single rule rejects it.

Edge cases: a null text counts as empty; an empty text has zero counts, fails the base test and is
not kept; repeated rows and ids are judged row by row; an empty table gives an empty result; the
input's other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import SPACE_CLASS, scratch, stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Votes: name, condition for good, condition for bad; anything else abstains.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_size", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 10 * n_words"),
    ("marked", "100 * n_marked <= n_words", "100 * n_marked > 8 * n_words"),
    ("spelling", "10 * (word_chars - n_letters) <= word_chars", "100 * (word_chars - n_letters) > 18 * word_chars"),
    ("lines", "n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    ("repeats", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    # a fifth and a tenth of the words up to 4,000 of them, from there on in proportion to the root of their number
    ("variety", "5 * n_distinct >= n_words or n_words > 4000 and n_distinct * n_distinct >= 160 * n_words", "10 * n_distinct < n_words and (n_words <= 4000 or n_distinct * n_distinct < 40 * n_words)"),
    ("stops", "n_stops between n_words / 80 and n_words / 3", "n_stops = 0 and n_words >= 20 or n_stops > n_words / 2"),
    ("capitals", "5 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
)

ROUNDS = 25
SETTLED = 1e-4
SMOOTHING = 1.0
THRESHOLD = 0.5


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each whole text, beside the columns ``keep``."""
    space = f"[{SPACE_CLASS}]+"
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = base.withColumn("_w", F.split(F.regexp_replace("_t", rf"\A{space}|{space}\z", ""), space))
    base = base.withColumn("_w", F.when(F.element_at("_w", 1) == "", F.slice("_w", 1, 0)).otherwise(F.col("_w")))
    base = base.withColumn("_n", F.size("_w").cast("long"))
    window = lambda i: F.xxhash64(F.slice("_w", i, WINDOW))
    none = F.array().cast("array<bigint>")
    base = base.withColumn("_h", F.when(F.col("_n") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), window)).otherwise(none))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]"))
    base = base.withColumn("_l", lines)
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    base = base.withColumn("_s", F.when(some, ranked))

    def twice(e: Column, i: Column) -> Column:
        before, after = F.get("_s", i - 1)["h"], F.get("_s", i + 1)["h"]
        return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

    base = base.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twice), lambda e: e["p"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_p", i - 1), F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return base.select(
        *keep,
        F.col("_n").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit(rf"[.!?]+(?=[{SPACE_CLASS}]|\z)")).cast("long").alias("n_stops"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]+")).cast("long").alias("n_marked"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def votes(counts: DataFrame) -> DataFrame:
    """Adds one column ``vote_<rule>`` for each rule."""
    vote = lambda good, bad: F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)
    return counts.withColumns({f"vote_{name}": vote(good, bad) for name, good, bad in RULES})


class VoteModel:
    """Class prior and, for each rule and class, the probabilities of bad, abstain and good votes."""

    def __init__(self, prior: float, tables: dict[str, dict[int, dict[int, float]]]):
        self.prior, self.tables = prior, tables

    def distance(self, other: VoteModel) -> float:
        """Greatest difference between two models' probabilities."""
        return max(abs(t[y][v] - other.tables[n][y][v]) for n, t in self.tables.items() for y in (0, 1) for v in (-1, 0, 1))

    def accuracies(self) -> dict[str, float]:
        """Of each rule, the probability that a vote it casts is right."""
        out = {}
        for name, t in self.tables.items():
            right = self.prior * t[1][1] + (1 - self.prior) * t[0][-1]
            cast = right + self.prior * t[1][-1] + (1 - self.prior) * t[0][1]
            out[name] = right / cast if cast else 0.5
        return out

    def posterior(self) -> Column:
        """Probability of "good" given the votes. The log ratios stand in one array literal, so that
        every round of the fit runs the same generated code."""
        start = math.log(self.prior / (1 - self.prior))
        ratios = [math.log(t[1][v] / t[0][v]) for t in self.tables.values() for v in (-1, 0, 1)]
        known = F.array(*(F.lit(x) for x in [start, *ratios]))
        odds = F.get(known, F.lit(0))
        for i, name in enumerate(self.tables):
            odds = odds + F.get(known, F.col(f"vote_{name}") + (3 * i + 2))
        return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> VoteModel:
    """EM over the distinct vote vectors with their ``weight``; each round is one aggregation, and
    the rounds end once no probability moves by more than SETTLED.

    The first expectation is the vote balance. A rule may never be more likely to vote bad on good
    documents than on bad ones (its tables are then pooled), which keeps the classes from swapping.
    """
    names = [name for name, _, _ in RULES]
    against = sum((F.when(F.col(f"vote_{n}") == -1, 1).otherwise(0) for n in names), F.lit(0))
    good: Column = F.when(against == 0, 0.95).when(against == 1, 0.3).otherwise(0.05)
    model = VoteModel(0.5, {})
    for _ in range(rounds):
        w1, w0 = F.col("weight") * F.col("_g"), F.col("weight") * (1 - F.col("_g"))
        cells = [
            F.coalesce(F.sum(F.when(F.col(f"vote_{n}") == v, w)), F.lit(0.0)).alias(f"{n}:{y}:{v}")
            for n in names
            for y, w in ((1, w1), (0, w0))
            for v in (-1, 0, 1)
        ]
        row = patterns.withColumn("_g", good).agg(F.sum(w1).alias("w1"), F.sum(w0).alias("w0"), *cells).first()
        total = {1: row["w1"] or 0.0, 0: row["w0"] or 0.0}
        prior = (total[1] + SMOOTHING) / (total[1] + total[0] + 2 * SMOOTHING)
        tables = {}
        for n in names:
            t = {y: {v: (row[f"{n}:{y}:{v}"] + SMOOTHING) / (total[y] + 3 * SMOOTHING) for v in (-1, 0, 1)} for y in (0, 1)}
            if t[1][-1] > t[0][-1]:
                pooled = {v: prior * t[1][v] + (1 - prior) * t[0][v] for v in (-1, 0, 1)}
                t = {0: pooled, 1: pooled}
            tables[n] = t
        before, model = model, VoteModel(prior, tables)
        if before.tables and model.distance(before) < SETTLED:
            break
        good = model.posterior()
    return model


def score(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base test, votes, posterior ``quality`` and ``kept`` of every document.

    Documents that fail the base test are decided; the vote model is fitted to all the others.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = [f"vote_{name}" for name, _, _ in RULES]
    with scratch(docs.sparkSession) as kept:
        judged = kept(stage(votes(features(docs, text, keep)).withColumn("base_failed", failed), "quality-votes"))
        open_cases = judged.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").cast("double").alias("weight"))
        patterns, _ = stage(open_cases.coalesce(1), "quality-patterns")
        out = judged.withColumn("quality", fit(patterns).posterior())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, in whatever number they come.

    The rows travel beside their votes in one column, so a verdict needs no join to find its row and
    no name of theirs can clash.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    return score(rows, "text", ("row",)).where("kept").select("row.*")
