"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import free_name, scratch_path, table
from brindle.llm.mixing import mixed
from brindle.llm.packing import pack, tokenizer_path
from brindle.llm.quality import quality
from brindle.llm.simhash import keep_one_similar
from brindle.llm.windows import remove_passages


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as it is for the text now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    into = free_name(docs, "quality")
    judged = quality(docs, "text", into).where(F.col(f"{into}.kept"))
    return _sized(judged.withColumn("text", F.col(f"{into}.clean")).drop(into))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity 0.8 or more in 5-word shingles."""
    return keep_one_similar(docs, "doc_id", "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier text has too."""
    return _sized(remove_passages(docs, "doc_id", "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs, "doc_id", "text", "source")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Fingerprints, passages and token ids are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
