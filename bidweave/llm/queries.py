"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, extraction, huffman, lloyd, neardup, ngram_lm, packing, quality, sharding, topk, toxicity, warc
from .oracles import ORACLE_SQL  # noqa: F401  (registered by the entry)
from .staging import drop_stage, new_path, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from the labels of those not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vectors by inner product for every hundredth id, against all rows."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base test and weak-supervision verdict of every document."""
    scored = quality.score(_table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes; equal texts stay together."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, lengths and checksums of all documents' ids, from the coded files."""
    docs = _table(spark, sf_dir, "documents")
    path = new_path(spark, "huffman")
    huffman.save(docs, path, vocabulary("word_bpe_49k.json"))
    read = huffman.read_files(spark, path)
    return read.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = neardup.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, add-one base score and Katz log10 probability of every document."""
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload, kind and original of every page, read back from normalised archives."""
    pages = _table(spark, sf_dir, "pages")
    folder, kind = new_path(spark, "warc"), pages.schema["page_id"].dataType
    warc.archive(pages, folder)
    found = warc.read(warc.index(spark, f"{folder}/archives"))
    ids = (F.col(c).cast(kind).alias(name) for c, name in (("key", "page_id"), ("refers_to", "refers_to")))
    out, _ = stage(found.select(*ids, "payload_bytes", "payload_digest", F.col("type").alias("record_type")), "warc-result")
    drop_stage(spark, folder)
    return out


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' ids of every document."""
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector, with sums and centroid digests."""
    return lloyd.cluster(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules, toxicity, near-duplicates and packing, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_huffman_tokens": op6_huffman_tokens,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_katz_lm": op10_katz_lm,
    "op11_warc": op11_warc,
    "op12_token_alignment": op12_token_alignment,
    "op13_lloyd": op13_lloyd,
    "pipeline": pipeline,
}
