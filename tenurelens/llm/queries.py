"""Registered queries of the training-data operators, with their SQL."""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import scan
from . import (alignment, conversations, exact_dedup, jaccard_join, language_id, mixing, near_dedup, packing, quality,
               repeated_bytes, secrets, sharding, warc)
from .base import ORACLE, QUERIES, query

__all__ = ["QUERIES", "ORACLE"]


def documents(spark, sf_dir) -> DataFrame:
    return scan(spark, sf_dir, "documents")


def trusted_ids(spark, sf_dir) -> DataFrame:
    return scan(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir), trusted_ids(spark, sf_dir))


@query("op2_secret_scans")
def op2(spark, sf_dir):
    return secrets.scan_secrets(documents(spark, sf_dir))


@query("op3_warc")
def op3(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(scan(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest).drop("target_uri")


SHARDS = 40


@query("op4_sharding")
def op4(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


@query("op5_suffix_array_dedup")
def op5(spark, sf_dir):
    return repeated_bytes.remove_repeats(documents(spark, sf_dir))


@query("op6_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)""")
def op6(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


MIX_SQL = r"""
d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(n % 3 + 1)::INT] AS weight, [0.5::DOUBLE, 0.0, -0.5][(n % 3 + 1)::INT] AS tilt,
             source_size * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / ((sum(weight) OVER ())
                 - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                AS level FROM c),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap / weight > level),
t AS (SELECT source, source_size, tilt, least(cap, coalesce((SELECT level FROM f), 0) * weight) AS target FROM l),
o AS (SELECT d.*, source_size, target, tilt, round(target)::BIGINT AS asked,
             (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start_at
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS passes,
             (start_at + size / 2.0::DOUBLE) / greatest(asked, 1) AS part FROM o),
mixed AS (SELECT doc_id, source, size, source_size, target,
             (passes * size + greatest(0, least(size, asked - passes * source_size - start_at)))::BIGINT AS taken,
             CASE WHEN tilt = 0 THEN part ELSE
               (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(part, 1.0)) - (1 - tilt)) / (2 * tilt) END AS spot
      FROM p)"""


@query("op9_mixing", "WITH " + MIX_SQL.format(docs="documents") + """
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       CASE WHEN taken > 0 THEN round(least(spot, 1.0), 9) END AS position FROM mixed""")
def op9(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken",
                        F.round("position", 9).alias("position"))


@query("op7_minhash_near_dedup")
def op7(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_language_id")
def op10(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    rows = scan(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@query("op12_cross_tokenizer_alignment")
def op12(spark, sf_dir):
    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_ngram_jaccard_join")
def op13(spark, sf_dir):
    return jaccard_join.link_documents(documents(spark, sf_dir))
