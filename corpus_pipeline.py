"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.

1. ``language``: texts without any language go, ``lang`` becomes the one found.
2. ``near_dedup``: one document of each group of near copies stays (five-word shingles).
3. ``substring_dedup``: words in passages of 20 words or more that an earlier document holds are cut.
4. ``mix``: documents are repeated or left out to meet the sources' target weights.
5. ``encode``: token ids of each document taken, checked by decoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import byte_bpe, mixing, ppm_language, simhash, suffix_tree
from sparkloom.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm_language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_tree.strip(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("encode", encode)]

#: The stages are a trained model, similarity groups and an iteration, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
