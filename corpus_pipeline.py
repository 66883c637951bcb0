"""Corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's ``docs``. The first three return the columns of ``documents`` for the
rows they keep; the last returns every piece of every document left, with its sequence. ``run`` owns
the tables that its stages leave: once a stage's result is written, those it was read from go, and so does the
copy before it. What a stage called by itself leaves goes with the application.

Edge cases, alike in all stages: an empty table gives an empty result; columns that are null are
carried along, a null text counts as empty (quality drops it); rows with a null id are judged like
any others; repeated rows are each judged, and of near copies one stays; extra columns are kept
under their names, whatever these are, by all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidweave.llm import nearcopies, packing, quality, toxicity
from bidweave.llm.staging import drop_stage, noted, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half."""
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones among them, does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(docs, model) < 0.5).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies."""
    return nearcopies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, best fitted into sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("simhash_neardup", one_of_each), ("best_fit_packing", pack)]

#: Trained models and fingerprints have no SQL form; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES:
        own: list[str] = []
        with noted(own):
            made = step(spark, docs, sf_dir)
        docs, path = stage(made, f"pipeline-{name}")
        for unread in left + own:
            drop_stage(spark, unread)
        left = [path]
    return docs
