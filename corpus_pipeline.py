"""The cleaning pipeline over `documents`: one operator a stage, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of documents, but for the last, which returns the encoded corpus.  Stages join on
doc_id only; other columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, common, decontaminate, exact_dedup, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from the rows that its query learns from."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents equal up to white space: the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    return bpe.encode_with_digests(docs, bpe.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: The stages train, stream and sketch; SQL can't express them, so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs


