"""Synthetic attributes seeded by stable md5 hashes (repeatable across runs
and engines): project assignment, hash-seeded performance score, department
slug, and the hash-based exposure fallback."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import half_even_div, md5_prefix_int, md5_unit, weighted_bucket
from ..functions.labels import PROJECTS_PER_DEPARTMENT


def slug(col: Column) -> Column:
    """' ' → '_', '&' → 'and' (file-name form of a department)."""
    return F.replace(F.replace(col, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def project(dept: Column, role: Column, level: Column, emp: Column) -> Column:
    """<dept slug>_Project_<A..D>: bucket dominated by md5(dept|role|level),
    spread by md5(employee)."""
    group = F.concat_ws("|", dept, role, level)
    idx = weighted_bucket(group, emp, PROJECTS_PER_DEPARTMENT)
    return F.concat(slug(dept), F.lit("_Project_"), F.chr(F.lit(65) + idx))


def hash_score(emp: Column, a: Column, b: Column, c: Column, spread: float = 0.6) -> Column:
    """clamp(round_half_even((a+b+c)/3 + noise), 1, 4), noise uniform in
    [-spread, spread) from md5(employee)."""
    base = (a + b + c).cast("double") / 3.0
    noise = F.lit(-spread) + F.lit(2 * spread) * md5_unit(emp)
    return F.least(F.greatest(F.bround(base + noise, 0), F.lit(1.0)), F.lit(4.0)).cast("int")


def exposure_fallback(emp: Column, general_risk: Column) -> Column:
    """Hash exposure used when the graph yields nothing: md5 prefix mod 1000
    scaled by 2.5 / 1.2 / 0.4 for scores > 50 / > 25 / otherwise, rounded
    half-even to 2 decimals (exact integer arithmetic in 1e-4 units)."""
    seed = md5_prefix_int(emp) % 1000
    tenths = (F.when(F.coalesce(general_risk > 50, F.lit(False)), F.lit(25))
              .when(F.coalesce(general_risk > 25, F.lit(False)), F.lit(12))
              .otherwise(F.lit(4)))
    units = seed * tenths  # value * 10^4
    return half_even_div(units, 100).cast("double") / 100.0
