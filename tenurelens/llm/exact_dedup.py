"""Exact duplicates by 128-bit content hash, bytes compared inside groups.

Texts are equal when identical after every run of white space is replaced by
one space; null counts as the empty text.  Rows are grouped on the MD5 of the
normalised text *and* the text itself: the hash spreads the groups, and the
hash table of the aggregation compares whole keys byte by byte, so two texts
that collide on the hash stay two groups.  Copies collapse on the map side,
a hot group therefore reaches its reducer as one row per task.  Group values
go back to the rows by a join whose hot keys AQE can split.

Cases: equal texts keep the smallest id; rows repeated under one id share a
verdict; null ids rank after all others and are kept only where a whole group
has no id; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, text_of


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: __row (the whole input row), doc_id, keep_id,
    group_size, kept, text_sha256."""
    texts = docs.select(docs[id_col].alias("doc_id"), normalised(text_of(docs, text_col)).alias("norm"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    hashed = texts.select("doc_id", "__row", "norm", F.unhex(F.md5("norm")).alias("hash128"))
    groups = (hashed.groupBy("hash128", "norm")
              .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("hash128", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = hashed.select("doc_id", "__row", "hash128", F.sha2("norm", 256).alias("text_sha256"))
    return (rows.join(groups, ["hash128", "text_sha256"])
            .select("__row", "doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return grouped(docs, id_col, text_col).drop("__row")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return grouped(docs, id_col, text_col).where("kept").select("__row.*")
