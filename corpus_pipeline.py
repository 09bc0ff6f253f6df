"""A training corpus from ``documents`` in five stages.

1. quality rules: rejected documents go;
2. n-gram Jaccard join: of every component one document stays, the one with the least id;
3. suffix-array dedup: repeated passages go from the texts (a text may end up empty);
4. mixing: documents are repeated or left out so that sources have their target shares;
5. BPE: the ids of every text.

Each stage reads what the one before has written. Columns of any name are carried
along; rows with null ids, null or empty texts, ties, repeated rows and texts of any
length have the results that the stages' modules define; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinspark.llm import bpe, mixing, ngram_join, quality_rules, suffix_dedup
from twinspark.llm.common import read, release, settled, written
from twinspark.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_texts(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, TOKENIZER, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoded),
]

#: The join's components, the mix's random numbers and BPE have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
            release(spark, before, docs)  # what the stage has written on its way, and its input
    return docs
