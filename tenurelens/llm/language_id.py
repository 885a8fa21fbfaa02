"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary.  The
probability of a word is the sum over all ways to cut it into pieces, which a
forward pass over its characters computes for all languages at once; a text's
likelihood is the product over its words.  The prediction is the language of
highest likelihood, ``score`` its posterior under equal priors.

Piece probabilities are fitted by expectation maximisation (forward-backward
expected counts, starting from equal probabilities) on the words of about
``TRAIN_DOCS`` documents a language, chosen by the hash of their id: a
documented bound on the labelled rows.  Word counts and expected counts are
grouped by Spark; the model has languages x vocabulary numbers.  Every text is
scored whole, each distinct word of a block of texts once.

Cases: null texts and texts without a letter are ``und`` with score 0, as is
everything where no language was learned; equal likelihoods go to the first
language in order; words of any length are summed whole, with prefixes scaled by powers
of two so that none underflows; characters outside the vocabulary have the probability ``UNKNOWN``; repeated
rows get equal results; an empty table stays empty.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut

TRAIN_DOCS = 2000  # documents a language, about
ROUNDS = 2
UNKNOWN = 1e-7
SMOOTHING = 0.1
SAFE = 256  # bits a prefix may grow or shrink before it is scaled
BLOCK = 1024  # texts scored at a time
WORDS, CHARS = 16384, 1 << 19  # distinct words and their characters scored at a time, or one longer word
PLAIN = 32  # characters of a word whose prefixes cannot underflow
UNDETERMINED = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_U = np.uint64
_BASE, _SPREAD = _U(0x100000001B3), _U(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numbers like superscripts are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of a public sentence-piece model; U+2581 marks the
    start of a word."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p})


class Lattice:
    """The pieces that occur in a block of words, as index arrays."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._key(p) for p in pieces], dtype=_U)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.keys >> _U(64 - _FILTER_BITS)] = True
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)  # characters of a piece

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return (h + len(piece)) * int(_SPREAD) % (1 << 64)

    def steps(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """Words must come longest first.  Start and length of each word in a
        buffer with one place more than characters, and per position the
        (places, piece ids, length) of the pieces that begin there; piece id
        ``size`` stands for a character outside the vocabulary."""
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        chars = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), dtype=np.uint32).astype(_U) + _U(1)
        inside = chars != _U(11)  # not the line end between words
        ids = np.full((self.longest, len(chars)), -1, dtype=np.int32)
        h, fits = np.zeros(len(chars), dtype=_U), np.ones(len(chars), dtype=bool)
        for n in range(1, self.longest + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            fits = fits[:m] & inside[n - 1:n - 1 + m]
            h = h[:m] * _BASE + chars[n - 1:n - 1 + m]
            key = (h + _U(n)) * _SPREAD
            at = np.flatnonzero(fits & self.filter[key >> _U(64 - _FILTER_BITS)])
            slot = np.minimum(np.searchsorted(self.keys, key[at]), self.size - 1)
            hit = self.keys[slot] == key[at]
            ids[n - 1, at[hit]] = self.order[slot[hit]]
        ids[0, ids[0] < 0] = self.size
        steps = []
        for j in range(int(lengths[0]) if len(words) else 0):
            live = starts[:np.searchsorted(-lengths, -j, side="left")] + j
            for n in range(1, self.longest + 1):
                found = ids[n - 1, live]
                ok = found >= 0
                if ok.any():
                    steps.append((live[ok], found[ok], n))
        return starts, lengths, steps

    def forward(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Probability of every prefix under ``p`` (pieces + 1, languages), as
        a number and the power of two it is multiplied with (None: all 0)."""
        starts, lengths, steps = lattice = self.steps(words)
        alpha = np.zeros((int((lengths + 1).sum()) + 1, p.shape[1]))
        power = np.zeros(alpha.shape, dtype=np.int32) if lengths[0] > PLAIN else None
        alpha[starts] = 1.0
        for at, ids, n in steps:
            _add(alpha, power, at + n, alpha[at] * p[ids], at)
        return alpha, power, lattice

    def word_scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word (longest first) in each language."""
        alpha, power, (starts, lengths, _) = self.forward(words, p)
        ends = starts + lengths
        return np.log(alpha[ends]) + (0 if power is None else power[ends] * math.log(2))

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; ``weights``: words x languages."""
        alpha, power, (starts, lengths, steps) = self.forward(words, p)
        ends = starts + lengths
        beta, less = np.zeros_like(alpha), None if power is None else np.zeros_like(power)
        beta[ends] = weights / alpha[ends]
        if power is not None:
            less[ends] = -power[ends]
        counts = np.zeros_like(p)
        for at, ids, n in reversed(steps):
            use = p[ids] * beta[at + n]
            uses = alpha[at] * use
            np.add.at(counts, ids, uses if power is None else np.ldexp(uses, power[at] + less[at + n]))
            _add(beta, less, at, use, at + n)
        return counts


def _add(value: np.ndarray, power: np.ndarray | None, at: np.ndarray, more: np.ndarray, source: np.ndarray) -> None:
    """value[at] 2^power[at] += more 2^power[source], for distinct places
    ``at``; numbers under 2^-SAFE or over 2^SAFE get a new power."""
    if power is None:
        value[at] += more
        return
    more_power = power[source]
    old, old_power = value[at], power[at]
    if (old_power != more_power).any():
        new = np.where(old == 0, more_power, np.where(more == 0, old_power, np.maximum(old_power, more_power)))
        old, more = np.ldexp(old, old_power - new), np.ldexp(more, more_power - new)
    else:
        new = old_power
    total = old + more
    far = (total != 0) & ((total < 2.0 ** -SAFE) | (total > 2.0 ** SAFE))
    if far.any():
        total, bits = np.where(far, np.frexp(total)[0], total), np.where(far, np.frexp(total)[1], 0)
        new = new + bits
    value[at], power[at] = total, new


def marked_words(text: str) -> list[str]:
    """Lower-case words with their start mark."""
    return ["▁" + w for w in text.lower().split()]


def _blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of ``words``, longest first, at most ``WORDS`` and about
    ``CHARS`` characters at a time, those over ``PLAIN`` apart."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    sums = np.concatenate(([0], np.cumsum(lengths[order] + 1)))
    long, at = int((lengths > PLAIN).sum()), 0
    while at < len(order):
        end = int(np.searchsorted(sums, sums[at] + CHARS, side="right")) - 1
        end = max(at + 1, min(end, at + WORDS, long if at < long else len(order)))
        yield order[at:end]
        at = end


def fit(docs: DataFrame, pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces + 1, languages) from
    ``docs`` (doc_id, text, lang)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    p[-1] = UNKNOWN
    if not languages:
        return languages, p
    spark = docs.sparkSession
    shares = spark.createDataFrame([(x, i, min(1.0, TRAIN_DOCS / sizes[x])) for i, x in enumerate(languages)],
                                   "lang string, n int, share double")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(shares), "lang").where(unit < F.col("share")).select("n", "text")  # a row a language

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, str], int] = {}
            for n, text in zip(batch["n"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for w in marked_words(text):
                    found[n, w] = found.get((n, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()),
                                              pa.array([k[1] for k in found], pa.string()),
                                              pa.array(list(found.values()), pa.int64())], names=["n", "word", "uses"])

    words = cut(sample.mapInArrow(split, "n int, word string, uses long").groupBy("n", "word")
                .agg(F.sum("uses").alias("uses")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(pieces), np.zeros_like(p)
        for batch in batches:
            text, n, uses = (batch[c].to_pylist() for c in ("word", "n", "uses"))
            for at in _blocks(text):
                weights = np.zeros((len(at), len(languages)))
                weights[np.arange(len(at)), [n[i] for i in at]] = [uses[i] for i in at]
                total += lattice.expected([text[i] for i in at], weights, p)
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)),
                                          pa.array(total[piece, lang])], names=["n", "piece", "uses"])

    for _ in range(ROUNDS):
        rows = (words.mapInArrow(count, "n int, piece int, uses double").groupBy("n", "piece")
                .agg(F.sum("uses").alias("uses")).collect())  # at most languages x pieces rows
        uses = np.full((len(pieces), len(languages)), SMOOTHING)
        for n, piece, amount in rows:
            uses[piece, n] += round(amount, 6)
        p = np.vstack([uses / uses.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
    return languages, p


def predict(docs: DataFrame, pieces: list[str], languages: list[str], p: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with lang_pred and score for text."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                        ("score", pa.float64())])

    def judge(lattice: Lattice, texts: list[str]) -> tuple[list[str], np.ndarray]:
        ids: dict[str, int] = {}
        rows = [np.array([ids.setdefault(w, len(ids)) for w in marked_words(t)], dtype=np.int64) for t in texts]
        words = list(ids)
        logs = np.empty((len(words), len(languages)))
        for at in _blocks(words):
            logs[at] = lattice.word_scores([words[i] for i in at], p)
        totals = np.array([logs[r].sum(axis=0) for r in rows]).reshape(len(rows), len(languages))
        best = totals.argmax(axis=1)
        odds = np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return [languages[i] for i in best], 1.0 / odds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part["text"].to_pylist()
                known = [i for i, t in enumerate(texts) if languages and t and has_letter(t)]
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if known:
                    for i, name, score in zip(known, *judge(lattice, [texts[i] for i in known]), strict=True):
                        names[i], scores[i] = name, float(score)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.  Documents
    whose id has a CRC-32 of 1 modulo 3 are never learned from."""
    crc = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc % 3 == 1).alias("held_out"),
                       docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    pieces = vocabulary(model_path)
    languages, p = fit(rows.where(~F.col("held_out")), pieces)
    return predict(rows.select("doc_id", "held_out", "text"), pieces, languages, p)
