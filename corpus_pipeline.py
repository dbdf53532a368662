"""A corpus from raw documents: language, exact copies, near copies, benchmark passages, then tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's docs.
Language and decontamination decide where a document lies; the two de-duplications move each document once, to the decision
about it. Decisions themselves are ids and digests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold, shared_path, table
from tidemark.llm.decontamination import keep_clean
from tidemark.llm.exact_dedup import exact_dedup, keep_one
from tidemark.llm.language_id import keep_identified, learn_languages
from tidemark.llm.near_copies import near_copies
from tidemark.llm.queries import encoded_digests

#: A document whose most frequent language labels a smaller share of its letters is rejected as mixed.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that labels half of their letters, go."""
    model = learn_languages(docs, crc_fold(F.col("doc_id"), 4) != 2)
    return keep_identified(docs, model, LEAST_SHARE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_one(docs, exact_dedup(docs, keep="max"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a Jaccard similarity of 0.8 or more over five-word shingles join, the smallest doc_id stays."""
    return keep_one(docs, near_copies(docs, words=5, least=0.8))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a part within the edit budget of a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, and digests of its ids and of what they decode to."""
    return encoded_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: Language scores, edit distances and tokens are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
