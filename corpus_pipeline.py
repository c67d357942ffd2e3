"""A training corpus from ``documents``: language, exact copies, near copies, mix, tokens.

Every stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as
the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, dedup, language, mixing, simhash
from tidemark.session import cut_lineage

#: What the codec of the last stage remembers: little, since the stages before it share its workers.
CODEC = 20_000


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return language.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each SimHash component with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document of the mix."""
    return bpe.encoded(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN,
                       keep=("doc_id", "lang", "source"), remember=CODEC)


STAGES = [
    ("language", languages),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Language identification and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
