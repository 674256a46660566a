"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's documents; all but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm import decontaminate, jaccard, packing, pii, quality
from episodica.llm.queries import tokenizer_path
from episodica.llm.shared import small, staged

#: SQL cannot express alignment, trained spans or tokens; the stages are tested against plain versions.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows without an id stay; of rows that share an id and are kept, the one whose text sorts first stays.
    """
    groups = staged(jaccard.similar_groups(docs, size=5, threshold=0.8), "groups")
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_p_gone")).distinct()
    kept = docs.join(small(gone), F.col("doc_id").cast("long") == F.col("_p_gone"), "left_anti")
    twice = groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL")
    if twice.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return kept.withColumn("_p_row", first).where("_p_row = 1 OR doc_id IS NULL").drop("_p_row")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return packing.pack(docs, tokenizer_path(), end_id=2, window=4096)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
