"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of ``documents``; the last
one adds the tokens. ``run`` writes every stage as Parquet in the shared folder and reads it back for the next one, so
a lost executor never replays an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm import bpe, language, personal_data, spaced_seeds, weighted_dedup
from sitegraph.session import write_stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language can be found: null, empty or without a letter."""
    return language.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates."""
    return weighted_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return spaced_seeds.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the name of its kind in the place of each piece of personal data; other texts stay as they are."""
    found = personal_data.find_personal_data(docs, personal_data.fit(docs), mask=True)
    changed = F.size("pii") > 0
    columns = [F.when(changed, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return found.select(*columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids (little-endian, 32 bits) and a digest of the text that they decode to."""
    words = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    encoded = bpe.encode_documents(docs, words)
    return encoded.select(*docs.columns, "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("tokens", encode_tokens),
]

# Classes of similar texts, a trained field and byte-pair merges are beyond SQL; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
