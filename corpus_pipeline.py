"""Corpus pipeline over ``documents``: language ID, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's documents, so a lost
executor costs at most part of one stage. Every stage works on all rows that its predecessor kept.

The language stage lets documents go that are text of no learned language, and fills in a ``lang`` that is null. The near-dedup stage takes five-word
shingles and a similarity of 0.8 or more; of a group the document with the least id stays. The mixing stage
lets documents go whose rate is under one half (those of the toxic domain, whose weight is 0), keeps all others at least once
and repeats those of domains that are rarer than their weight. The last stage returns ``doc_id`` and token figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweave.llm import bpe, exact_dedup, lang_id, mixing, queries, simhash
from codeweave.llm.common import read_table, settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.mix(docs, read_table(spark, sf_dir, "labels")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, queries.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode_tokens),
]

#: SQL cannot express the learned stages; tests/llm holds the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
