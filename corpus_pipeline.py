"""The corpus pipeline: stages of training-data operators, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import automaton, jaccard, mixing, packing, quality
from brindle.llm.common import checkpointed, table
from brindle.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    return quality.classify(docs).where("keep").select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays."""
    return jaccard.keep_rows(docs, width=5, share=80)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; n_chars follows the text."""
    kept = automaton.dedup_substrings(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn by source, some twice and some not at all, in the mix's order."""
    return mixing.mix(docs).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096; a row that the mix took twice is packed twice."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1, payload="crc32")


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicates_stage), ("substring dedup", substrings_stage), ("mixing sources", mixing_stage), ("best-fit packing", packing_stage)]
#: Training and tokenising can't be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on a checkpoint of what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
