"""Secret scans: fixed patterns, and a battery of randomness tests.

Fixed kinds (``assign``, ``access``, ``hex``) are the leftmost matches, not
overlapping, of one pattern each; matches that are too short are dropped.
Positions are code points: the gaps between matches come from splitting the
text at the pattern, so a running sum of lengths gives every start.

The battery looks at the other runs of key characters that hold a digit and a
letter.  The smallest alphabet that fits a run is its encoding.  Three tests
ask whether its symbols are uniform and independent draws: chi-squared
uniformity, runs above and below the middle of the alphabet, and serial
correlation.  Fisher's method combines them.  Runs of similar length (powers
of two) form a class, and Benjamini-Hochberg at level ``FDR`` in each class
decides which runs are declared *not* random: at most that share of them is
random in truth.  The runs that stay and hold ``MIN_BITS`` bits, below which
the tests have no power, are reported as kind ``random``.  The procedure needs
only how many runs of a class fall into each of ``BINS`` bins of log p.

Cases: null text is empty; texts without secrets have the digest of the empty
list; equal spans of repeated rows are reported for each row; an empty table
stays empty; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import let, text_of

# Patterns and lengths of the fixed kinds, in the order of kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
KINDS = ("assign", "access", "hex", "random")

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+"  # key characters with a digit
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
             UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
             UPPER + LOWER + DIGITS + "+/-_")
MIN_BITS = 96
FDR = 0.01
BINS = 300  # tenths of a power of ten
SPAN = "array<struct<start:int,kind:int,end:int,class:int,bin:int>>"


def located(text: Column, pattern: str, group: int, keep: Callable[[Column], Column],
            more: Callable[[Column], Column], kind: int) -> Column:
    """Spans of the matches whose ``group`` passes ``keep``; ``more`` gives
    their class and bin from the match."""
    whole = F.lit(f"({pattern})")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, whole, F.lit(1)).alias("match"),
                         F.regexp_extract_all(text, whole, F.lit(group + 1)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = let(more(x["match"]), lambda m: F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                                                        m["class"].alias("class"), m["bin"].alias("bin")))
        spans = F.when(x["match"].isNotNull() & keep(x["part"]), F.concat(acc["spans"], F.array(span)))
        return F.struct(F.coalesce(end, begin).alias("at"), F.coalesce(spans, acc["spans"]).alias("spans"))

    empty = F.array().cast(SPAN)
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["spans"])).otherwise(empty)


def upper_tail(value: Column) -> Column:
    """P(N > value) of a standard normal (Abramowitz and Stegun 26.2.17)."""
    def tail(z: Column, t: Column) -> Column:
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series

    sided = lambda z, p: F.greatest(F.when(z >= 0, p).otherwise(1 - p), F.lit(1e-30))
    return let(value, lambda z: let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: let(tail(z, t), lambda p: sided(z, p))))


def alphabet_of(run: Column) -> Column:
    out = F.lit(ALPHABETS[-1])
    for a in reversed(ALPHABETS[:-1]):
        letters = a.replace("-", r"\-")
        out = F.when(run.rlike(f"^[{letters}]+$"), F.lit(a)).otherwise(out)
    return out


def randomness(run: Column) -> Column:
    """class (log2 of the length) and bin (tenths of -log10 p) of a run."""
    n = F.length(run).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    pairs = lambda x: F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"),
                                   F.slice(x, 2, F.size(x)).alias("b"))
    two_sided = lambda z: F.least(2 * upper_tail(z), F.lit(1.0))

    def uniform(alphabet: Column, a: Column) -> Column:
        of = lambda c: (F.length(run) - F.length(F.replace(run, c, F.lit("")))).cast("double")
        equal = total(F.transform(F.split(alphabet, ""), lambda c: let(of(c), lambda k: k * k)))
        return (equal - n - n * (n - 1) / a) / F.sqrt(2 * n * (n - 1) * (a - 1) / (a * a))

    def runs(high: Column) -> Column:
        turns = 1 + F.size(F.filter(pairs(high), lambda p: p["a"] != p["b"])).cast("double")
        mean = let(total(high), lambda up: 1 + 2 * up * (n - up) / n)
        return let(mean, lambda m: let(F.sqrt((m - 1) * (m - 2) / (n - 1)), lambda s: F.when(
            s > 0, F.abs(turns - m) / s).otherwise(F.lit(10.0))))

    def serial(moved: Column) -> Column:
        together = F.abs(total(F.transform(pairs(moved), lambda p: p["a"] * p["b"])))
        return let(total(F.transform(moved, lambda x: x * x)), lambda square: F.when(
            square > 0, together / square * F.sqrt(n)).otherwise(F.lit(10.0)))

    def tests(alphabet: Column, v: Column) -> Column:
        a = F.length(alphabet).cast("double")
        high = F.transform(v, lambda x: (2 * x >= a).cast("double"))
        centred = let(total(v) / n, lambda m: F.transform(v, lambda x: x - m))
        # half of Fisher's statistic, which has 6 degrees of freedom
        half = -(F.log(upper_tail(uniform(alphabet, a))) + F.log(two_sided(let(high, runs)))
                 + F.log(two_sided(let(centred, serial))))
        log_p = let(half, lambda x: -x + F.log(1 + x + x * x / 2))
        return F.struct(F.floor(F.log2(n)).cast("int").alias("class"),
                        F.least(F.floor(-log_p / math.log(10) * 10), F.lit(BINS)).cast("int").alias("bin"))

    symbol = lambda alphabet: F.transform(F.split(F.substring(run, 1, 1 << 30), ""),
                                          lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return let(alphabet_of(run), lambda a: let(symbol(a), lambda v: tests(a, v)))


def has_power(run: Column) -> Column:
    return (F.length(run) * F.log2(F.length(alphabet_of(run))) >= MIN_BITS) & run.rlike("[A-Za-z]")


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id with the spans of the fixed kinds and of the tested runs."""
    text = F.col("text")
    plain = lambda m: F.struct(F.lit(0).alias("class"), F.lit(0).alias("bin"))
    kinds = [located(text, ASSIGN, 2, lambda g: F.length(g) >= ASSIGN_CHARS, plain, 0),
             located(text, ACCESS, 0, lambda g: F.length(g) >= ACCESS_CHARS, plain, 1),
             located(text, HEX, 0, lambda g: F.lit(True), plain, 2)]
    runs = located(text, RUN, 0, has_power, randomness, 3)
    rows = (docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
            .select("doc_id", F.concat(*kinds).alias("fixed"), runs.alias("runs")))
    free = F.filter("runs", lambda r: ~F.exists("fixed", lambda f: (f["start"] < r["end"]) & (r["start"] < f["end"])))
    return rows.select("doc_id", "fixed", free.alias("runs"))


def last_random_bins(rows: DataFrame) -> DataFrame:
    """One row: for each class 0 to 31 the first bin declared not random."""
    tested = rows.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("class").orderBy(F.desc("bin"))  # at most BINS + 1 rows a class
    ranked = tested.select("class", "bin", F.sum("n").over(above).alias("k"),
                           F.sum("n").over(Window.partitionBy("class")).alias("m"))
    cuts = (ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= F.col("k") * FDR / F.col("m"))
            .groupBy("class").agg(F.min("bin").alias("first")))
    every = rows.sparkSession.range(32).select(F.col("id").cast("int").alias("class"))
    return (every.join(F.broadcast(cuts), "class", "left")  # at most 32 rows
            .agg(F.sort_array(F.collect_list(F.struct("class", F.coalesce("first", F.lit(BINS + 1)).alias("first"))))
                 .alias("c")).select(F.transform("c", lambda x: x["first"]).alias("c")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random,
    base_sha256, spans."""
    rows = scanned(docs, id_col, text_col)
    found = (rows.withColumn("first", last_random_bins(rows).scalar())
             .withColumn("random", F.filter("runs", lambda r: r["bin"] < F.get("first", r["class"]))))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[number("fixed", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
                        F.size("random").cast("long").alias("n_random"),
                        F.sha2(listed(F.col("fixed")), 256).alias("base_sha256"),
                        listed(F.concat("fixed", "random")).alias("spans"))
