"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next one's input.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffixloom.llm import byte_bpe, decontaminate, language_id, line_dedup, minhash_dedup
from suffixloom.llm._common import Scratch, read_table

#: Least mean probability of a document's language.
LANGUAGE_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of none for sure, go.  The model learns from the rows that aren't held out."""
    model = language_id.fit(docs.where("doc_id IS NOT NULL").where(~language_id.held_out()))
    return language_id.keep_identified(docs, model, LANGUAGE_SCORE)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that near-repeat an earlier one go, and documents that consist of such lines only."""
    left = line_dedup.line_dedup(docs)
    n_dropped = F.col(f"`{left.columns[-1]}`")  # the operator's own column, whatever the input's are named
    left = left.where((n_dropped == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return minhash_dedup.keep_one_of_each(docs, similarity=80, width=5)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned 32-bit integers)."""
    import public_tokenizers

    return byte_bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", known_language),
    ("line dedup", fresh_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express a trained field, fuzzy lines or merges by rank; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
