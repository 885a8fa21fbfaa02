"""Jump consistent hashing of stable keys to shards.

The shard of a row depends on its key and the number of shards alone; no ring
table exists, and with one more shard a row either stays or moves into the
new one.  The jump loop runs over Arrow batches of keys as vectors.

Slots count the rows of a shard without gaps.  A shard can be far larger than
a task, so every shard is cut into ``SUB_BUCKETS`` hash buckets: a row's slot
is its rank in the bucket plus the rows of the earlier buckets, which a table
of at most shards x buckets rows gives.

Cases: a null key is key 0; null text has 16 bytes and checksum 0; repeated
rows get the same shard and slots of their own; an empty table stays empty.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SUB_BUCKETS = 256
ROW_OVERHEAD = 16  # bytes added to the text of every document


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys (Lamping and Veach, 2014)."""
    k = keys.astype(np.uint64)
    out = np.zeros(len(k), dtype=np.int64)
    live, nxt = np.arange(len(k)), np.zeros(len(k), dtype=np.int64)
    while len(live):
        out[live] = nxt
        kk = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
        k[live] = kk
        step = float(1 << 31) / ((kk >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt = ((out[live] + 1) * step).astype(np.int64)
        go = nxt < shards
        live, nxt = live[go], nxt[go]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a 64-bit key column."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return place(key)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (the shard if there were one shard more)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(docs[id_col].alias("doc_id"), text.alias("text"),
                        F.xxhash64(F.coalesce(docs[id_col].cast("long"), F.lit(0))).alias("key"))
    placed = keyed.select("doc_id", "text", F.pmod("key", F.lit(SUB_BUCKETS)).alias("sub"),
                          shard_of(F.col("key"), shards).alias("shard"),
                          shard_of(F.col("key"), shards + 1).alias("grown_shard"))
    rows = placed.select("doc_id", "sub", "shard", "grown_shard",
                         (F.octet_length("text") + ROW_OVERHEAD).cast("long").alias("size"),
                         F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    earlier = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    rank = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("rank", F.row_number().over(rank))
            .join(F.broadcast(offsets), ["shard", "sub"])  # at most shards x SUB_BUCKETS rows
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"))
