"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows of the whole text.  The verdict on the rest is a likelihood ratio:
words, the character trigrams that end them and pairs of neighbouring words
are hashed into ``BUCKETS`` cells; the trusted target (documents labelled of
good quality and not toxic) and the raw corpus (every document) are two multinomials over the cells, and a text's
score is its mean log ratio per n-gram.  ``kept`` is score >= ``THRESHOLD``,
the same for every document.

The raw multinomial counts all documents.  The target is fitted on the
``TRUSTED_ROWS`` trusted labels of smallest key hash, a documented bound, so
that the id list can be broadcast; the fitted table has ``BUCKETS`` rows.

Everything is built-in functions on arrays inside a row: no explode of
windows, no shuffle of documents.

Cases: null text has no words; texts under 20 words fail the base rules; with
no trusted labels every ratio is 0 and only the base rules decide; repeated
rows get equal verdicts; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, let, text_of, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
BUCKETS = 8192
TRUSTED_ROWS = 8192
SMOOTHING = 1.0
THRESHOLD = -0.35  # nats per n-gram
ENDING = 3  # characters of a word's ending


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(h: Column) -> Column:
    """Hashes of all windows of ``WINDOW`` words, given the word hashes."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))


def repeated_words(words: Column, windows: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words found twice or more.

    ``windows`` are the window hashes: a text without an equal pair of them
    has no repeated window.  Only the others compare the windows themselves,
    so a hash collision changes nothing.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))

    def covered(at: Column) -> Column:
        """``at``: ascending starts of repeated windows."""
        reach = lambda s, i: F.when(i + 1 < F.size(at), F.least(F.get(at, i + 1) - s, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, lambda s, i: F.coalesce(reach(s, i), F.lit(WINDOW))),
                           F.lit(0), lambda a, x: a + x)

    def exact(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["w"] == F.get(pairs, j)["w"]
        hit = F.filter(pairs, lambda p, i: F.coalesce(same(i, i - 1), F.lit(False))
                       | F.coalesce(same(i, i + 1), F.lit(False)))
        return let(F.array_sort(F.transform(hit, lambda p: p["s"])), covered)

    pairs = F.sort_array(F.transform(starts, lambda s: F.struct(
        F.array_join(F.slice(words, s, WINDOW), " ").alias("w"), s.alias("s"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, exact))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, the hashed n-grams, and the whole
    input row as the struct __row."""
    texts = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))

    def measures(words: Column) -> Column:
        return let(word_hashes(words), lambda h: F.struct(
            F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("chars"),
            let(window_hashes(h), lambda windows: repeated_words(words, windows)).alias("repeated"),
            ngrams_of(words, h).alias("ngrams")))

    measured = texts.select(
        "doc_id", "__row", F.monotonically_increasing_id().alias("__no"), let(words_of(F.col("text")), measures).alias("w"), symbols.alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    counts = measured.select("doc_id", "__row", "__no", long("w.n", "n_words"), long("w.chars", "word_chars"),
                             long("n_symbols", "n_symbols"), long("n_dup_lines", "n_dup_lines"),
                             long("w.repeated", "n_repeat_words"), F.col("w.ngrams").alias("ngrams"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def ending(word: Column) -> Column:
    """Hash of the character n-gram that ends a word."""
    return F.xxhash64(F.substring(word, -ENDING, ENDING), F.lit(ENDING))


def ngrams_of(words: Column, h: Column) -> Column:
    """Hashes of the words, their endings and the pairs of neighbours, given
    the word hashes."""
    pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
    return F.concat(h, F.transform(words, ending), pairs)


def cell(ngram: Column) -> Column:
    return F.pmod(ngram, F.lit(BUCKETS)).cast("int")


def fit_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cell, ratio) for all ``BUCKETS`` cells; ``trusted``: a column doc_id."""
    spark = docs.sparkSession
    chosen = (trusted.select(F.col("doc_id").alias("__t")).where("__t IS NOT NULL").distinct()
              .orderBy(F.xxhash64("__t"), "__t").limit(TRUSTED_ROWS).withColumn("good", F.lit(1)))
    text = text_of(docs, text_col)
    ngrams = (docs.select(docs[id_col].alias("__id"), text.alias("text"))
              .join(F.broadcast(chosen), F.col("__id") == F.col("__t"), "left")  # at most TRUSTED_ROWS ids
              .select(F.coalesce("good", F.lit(0)).alias("good"),
                      F.explode(let(words_of(F.col("text")), lambda words: let(
                          word_hashes(words), lambda h: ngrams_of(words, h)))).alias("ngram")))
    cells = (ngrams.groupBy(cell(F.col("ngram")).alias("cell"))
             .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")))
    table = (spark.range(BUCKETS).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left")
             .select("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))
    whole = Window.partitionBy(F.lit(0))  # BUCKETS rows
    share = lambda n: (F.col(n) + SMOOTHING) / (F.sum(n).over(whole) + SMOOTHING * BUCKETS)
    return table.select("cell", F.when(F.sum("target").over(whole) > 0, F.log(share("target") / share("raw")))
                        .otherwise(F.lit(0.0)).alias("ratio"))


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: __row, __no (a row number, in no order that
    matters), base counts, base_failed, score, kept."""
    ratios = (fit_ratios(docs, trusted, id_col, text_col)
              .agg(F.sort_array(F.collect_list(F.struct("cell", "ratio"))).alias("r"))
              .select(F.transform("r", lambda x: x["ratio"]).alias("r"))).scalar()
    total = F.aggregate("ngrams", F.lit(0.0), lambda a, h: a + F.get("ratios", cell(h)))
    score = F.when(F.size("ngrams") > 0, total / F.size("ngrams")).otherwise(F.lit(0.0))
    return (base_counts(docs, id_col, text_col).withColumn("ratios", ratios)
            .withColumn("score", score).drop("ngrams", "ratios")
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD)))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, base_failed, score, kept."""
    return judged(docs, trusted, id_col, text_col).drop("__row", "__no")


def drop_rejected(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    # the row number keeps the filter above the counts: pushed below them it
    # would evaluate every count once for each time the verdict uses it
    return judged(docs, trusted, id_col, text_col).where("kept AND __no >= 0").select("__row.*")
