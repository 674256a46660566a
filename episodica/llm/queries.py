"""The corpus operators over the sample tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe, decontaminate, divergence, jaccard, language, licences, oracles, packing, pii, quality, sharding, suffixes, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A tokenizer's file as installed with the public tokenizers, by default the word tokenizer's."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances to language references and verdict of every document."""
    return quality.assess(_documents(spark, sf_dir))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, equal texts together."""
    return sharding.shard_documents(_documents(spark, sf_dir), shards=40)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on three-word shingles at a similarity of 0.9."""
    return jaccard.similar_groups(_documents(spark, sf_dir), size=3, threshold=0.9)


def op4_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 4096."""
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(), end_id=2, window=4096)


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find(_documents(spark, sf_dir))


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified captures of the pages' archive with their full responses."""
    return warc.resolved_pages(_table(spark, sf_dir, "pages"))


def op7_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a file of a tree, its own or a directory's."""
    return licences.scan(licences.document_files(_documents(spark, sf_dir))).drop("text")


def op8_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with copies of benchmark items, edited or not."""
    return decontaminate.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removing every byte that a repeated 100-byte string covers."""
    return suffixes.remove_repeats(_documents(spark, sf_dir), threshold=100, with_bytes=False)


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labels."""
    return language.learn_and_identify(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the other sources of its language, and the terms it has more often than the language."""
    return divergence.audit(_documents(spark, sf_dir))


def op12_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    both = bpe.round_trip(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first 16 components, to unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (op1_distribution_quality, op2_label_propagation_shards, op3_ngram_jaccard, op4_bounded_packing, op5_pii_boosting,
             op6_revisit_resolution, op7_licence_inheritance, op8_seeded_alignment, op9_suffix_dedup, op10_compression_language,
             op11_source_divergence, op12_tokenization_automaton, op13_embedding_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
