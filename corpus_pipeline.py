"""The training-data pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage but the last returns the columns of ``documents`` for the rows it keeps.
Stages take the columns they need by name; extra columns pass through untouched, whatever their names;
nulls, empty texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewalk.llm import bitplanes, byte_cnn, decontaminate, mixing, parity_join
from tracewalk.llm.scratch import discard, materialize, release, small_batches

#: Share of the tokens that the mix keeps, in expectation.
MIX_RATE = 0.8
#: Ids up to which a list is broadcast (8 MB); a longer one is a shuffled join.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or score far lower than held-back texts of the learned languages."""
    small_batches(spark)
    model = byte_cnn.fit(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    return byte_cnn.keep_recognised(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked at 0.8 on five-word shingles; repeated rows of one doc_id are one document, and a row without id stays."""
    small_batches(spark)
    groups = parity_join.near_duplicates(docs, k=5, percent=80)
    gone = materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards tempered shares of source, language and topic."""
    small_batches(spark)
    return mixing.sample(docs, rate=MIX_RATE)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns (doc_id, start, n_tokens, ids_crc32), read back from them."""
    small_batches(spark)
    return bitplanes.read_token_files(bitplanes.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: No SQL expresses the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
