"""Stable md5-based hashing as native column expressions.

The reference seeds attributes and draws from md5 digests.  A 128-bit digest
never has to be materialised: its residue modulo ``m`` is folded from four
32-bit hex chunks (Horner's rule on residues), which stays inside BIGINT and
inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_chunk(md5_hex: Column, i: int) -> Column:
    """32-bit unsigned value of hex chunk ``i`` (0..3) of an md5 digest."""
    return F.conv(F.substring(md5_hex, 8 * i + 1, 8), 16, 10).cast("bigint")


def md5_mod(text: Column, m: int) -> Column:
    """int(md5(text), 16) mod m, exactly."""
    h = F.md5(text)
    base = (1 << 32) % m
    acc = md5_chunk(h, 0) % m
    for i in (1, 2, 3):
        acc = (acc * base + md5_chunk(h, i) % m) % m
    return acc


def md5_prefix_int(text: Column) -> Column:
    """int(md5(text)[:8], 16): the leading 32 bits as a number."""
    return md5_chunk(F.md5(text), 0)


def md5_unit(text: Column) -> Column:
    """A repeatable uniform draw in [0, 1) from the leading 32 bits."""
    return md5_prefix_int(text) / F.lit(float(1 << 32))


def weighted_bucket(group_text: Column, member_text: Column, n: int,
                    w_group: int = 7, w_member: int = 3, width: int = 1000) -> Column:
    """min((w_group*md5(group) + w_member*md5(member)) mod (n*width) div width, n-1).

    The project-assignment rule: the group digest dominates the bucket, the
    member digest spreads members of one group over neighbouring buckets.
    """
    m = n * width
    combined = (md5_mod(group_text, m) * w_group + md5_mod(member_text, m) * w_member) % m
    return F.least((combined / width).cast("bigint"), F.lit(n - 1))


def half_even_div(numer: Column, denom: int) -> Column:
    """Integer numer/denom rounded half-to-even, for non-negative numer."""
    q = F.floor(numer / denom).cast("bigint")
    r = numer - q * denom
    up = (r * 2 > denom) | ((r * 2 == denom) & (q % 2 == 1))
    return F.when(up, q + 1).otherwise(q)


def hash_index(key_text: Column, n: Column) -> Column:
    """A repeatable index in [0, n) for draws ("pick member #k of a group")."""
    return md5_mod(key_text, 1 << 30) % n
