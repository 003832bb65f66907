"""The document pipeline: toxic texts and near copies go, then benchmark leaks; secrets are masked; the rest is packed.

Part of the training-data operators (tarnline.llm). Every stage takes nulls in any column, empty and very long texts,
repeated rows and empty tables (which stay empty), and leaves all columns of documents as they were but where it says so.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnline.llm import decontam, neardup, packing, secretscan, toxicity
from tarnline.llm.common import Staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose score is 0.5 or more. Null and empty texts have the score of the bias alone; equal texts have equal scores, so repeated rows stay or go together. Labels with a null id or value teach nothing; without labels nothing is learned and nothing goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words a shingle, similarity 0.8): that with the least id. Texts without words are copies of nothing, and rows without an id stay; of repeated rows of one id and text one stays."""
    return neardup.drop_near_duplicates(docs, Staged(spark, "neardup"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go (ten words; a shorter item is one window). Null texts have no words and stay; an empty benchmark takes nothing."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. A null text stays null; n_chars is brought up to date where a text changed."""
    return secretscan.redact(docs, secretscan.train_markov(secretscan.labelled_samples(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences; a null or empty text is the end mark alone, and rows of one id are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), Staged(spark, "packing"))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("packing", pack)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staged, before = table(spark, sf_dir, "documents"), Staged(spark, "pipeline"), None
    for _, stage in STAGES:
        docs = staged.keep(stage(spark, docs, sf_dir))
        if before is not None:
            staged.drop(before)
        before = docs
    return docs
