"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  ``run`` applies them to ``documents``; each result is written
as Parquet in the session's shared checkpoint folder and read again, so a lost
executor never repeats an earlier stage.

Mixing returns a document as often as the mix takes it (a document that the
last pass cuts counts if at least half of it is taken), sorted by its place in
the curriculum.  Packing returns one row per piece of a document.

``ORACLE_SQL`` is None: shingle similarity over whole tables and the token ids
of packing cannot be expressed in SQL; ``tests/llm`` holds every stage against
a brute-force version.
"""
from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurelens.llm import exact_dedup, mixing, near_dedup, packing, quality
from tenurelens.llm.queries import trusted_ids
from tenurelens.session import ensure_checkpoint_dir

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, trusted_ids(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
