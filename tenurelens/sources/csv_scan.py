"""Lenient CSV scan: explicit schema; lines with more fields than the schema
are skipped (short lines keep NULLs, values of a wrong type become NULL), and
null tokens such as 'nan' become NULL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES — text spellings of a missing value
NULL_TOKENS = ("nan", "NaN", "")

QUOTED = r'"(?:[^"\\]|\\.)*"'


def normalise_nulls(df: DataFrame, cols, tokens=NULL_TOKENS) -> DataFrame:
    """Null-token normalisation: each listed text token → NULL."""
    outs = {}
    for c in cols:
        cond = F.col(c).isin(*tokens)
        outs[c] = F.when(cond, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c))
    return df.withColumns(outs)


def field_count(line: Column, sep: str) -> Column:
    """Fields of a CSV line: separators outside quotes, plus one."""
    bare = F.regexp_replace(line, QUOTED, "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1


def lenient_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                header: bool = False) -> DataFrame:
    """Each line of the files in ``path`` as one record (quoted fields may
    hold separators, not line ends).  ``header`` skips the lines that spell
    the schema's names."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        lines = lines.where(F.col("value") != sep.join(schema.names))
    fits = lines.where(field_count(F.col("value"), sep) <= len(schema.fields))
    parsed = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"sep": sep, "mode": "PERMISSIVE"})
    return fits.select(parsed.alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in schema.names])
