"""Alignment of two tokenizers over a corpus.

Each text is encoded twice: a space and the text by a byte-level BPE (A), the
text by a sentencepiece model (B), which adds that space itself.  Byte offsets
where a token of A and one of B both end cut the tokens into groups, and at
each of them the two tokens that end there are linked.

Most groups hold one token of each side with the same bytes.  An array made
once (``identity_map``) holds for every id of A the id of B with those bytes,
so links of such groups are counted in vectors as long as the vocabulary, and
those vectors are all that leaves a task.  Only the links of the other,
irregular groups are counted by a shuffle of id pairs.  Counts come back to the
documents the same two ways: the vectors travel with the tasks (bounded by the
vocabularies), counts of irregular pairs are joined to blocks of documents,
each block asking once for each of its pairs.

Cases: null and empty texts, and texts whose tokens do not spell the space and
the text (the model normalises some), have no tokens: zeros and an empty
``groups_sha256``.  Strings of special tokens are plain text.  Repeated rows
and rows without an id are documents like any other and count as often as they
come.  Long texts stay whole: a task holds one text and its offsets at a time.
An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut
from .byte_bpe import ByteBpe

BLOCK_DOCS = 4096  # documents of a task that ask together for the counts of their pairs
BLOCK_PAIRS = 1 << 20
ID_BITS = 24  # of an id in a pair's code
_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
FOUND = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                   ("same", pa.binary()), ("same_n", pa.binary()), ("pairs", pa.binary()), ("pairs_n", pa.binary())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def identity_map(a: list[bytes | None], b: list[bytes]) -> np.ndarray:
    """For each id of A an id of B with the same bytes, or -1."""
    of_bytes = {}
    for i, token in enumerate(b):
        if token:
            of_bytes[token] = i  # a piece, where a byte token says the same: pieces come later
    return np.array([of_bytes.get(token, -1) if token else -1 for token in a], dtype=np.int64)


class Aligner:
    """Both tokenizers with their tables."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.a = ByteBpe(path_a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = self.a.bytes_of, piece_bytes(self.b)
        self.length_a = np.array([len(t or b"") for t in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)
        self.same = identity_map(self.bytes_a, self.bytes_b)
        self.text_a, self.text_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.text_same = [f"{i}|{j}" for i, j in enumerate(self.same)]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and B, or none if they do not spell the text."""
        if not text:
            return [], []
        raw = b" " + text.encode()
        a, b = self.a.encode(" " + text), self.b.encode(text)
        if (b"".join(map(self.bytes_b.__getitem__, b)) != raw
                or b"".join([self.bytes_a[i] or b"" for i in a]) != raw):
            return [], []
        return a, b

    def align(self, text: str):
        """(n_a, n_b, n_groups, groups text, ids of A in identity groups,
        codes of the other linked pairs)."""
        a, b = self.tokens(text)
        if not a:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        _, last_a, last_b = np.intersect1d(np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b]),
                                           assume_unique=True, return_indices=True)
        first_a = np.concatenate(([0], last_a[:-1] + 1))
        first_b = np.concatenate(([0], last_b[:-1] + 1))
        linked_a, linked_b = ids_a[last_a], ids_b[last_b]
        plain = (first_a == last_a) & (first_b == last_b) & (self.same[linked_a] == linked_b)
        odd = np.flatnonzero(~plain)
        parts, at, seq = [], 0, linked_a.tolist()
        for g, fa, la, fb, lb in zip(odd.tolist(), first_a[odd].tolist(), last_a[odd].tolist(), first_b[odd].tolist(),
                                     last_b[odd].tolist(), strict=True):
            parts += map(self.text_same.__getitem__, seq[at:g])
            parts.append(",".join(map(self.text_a.__getitem__, a[fa:la + 1])) + "|"
                         + ",".join(map(self.text_b.__getitem__, b[fb:lb + 1])))
            at = g + 1
        parts += map(self.text_same.__getitem__, seq[at:])
        return len(a), len(b), len(seq), ";".join(parts), linked_a[plain], linked_a[odd] << ID_BITS | linked_b[odd]


def found_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document (``FOUND``): its figures, its identity links as
    ids of A with their numbers, its irregular links as pair codes with
    theirs, and the block of documents that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block, docs_in, pairs_in = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n_a, n_b, groups, spelled, same, pairs = both.align(text)
                same, same_n = np.unique(same, return_counts=True)
                pairs, pairs_n = np.unique(pairs, return_counts=True)
                if docs_in >= BLOCK_DOCS or pairs_in >= BLOCK_PAIRS:
                    block, docs_in, pairs_in = block + 1, 0, 0
                docs_in, pairs_in = docs_in + 1, pairs_in + len(pairs)
                rows.append((doc_id, block, n_a, n_b, groups, groups,
                             hashlib.sha256(spelled.encode()).hexdigest() if n_a else "",
                             same.astype("<u4").tobytes(), same_n.astype("<u4").tobytes(), pairs.tobytes(),
                             pairs_n.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)],
                                             schema=FOUND)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).mapInArrow(
        run, f"doc_id long, block long, {_COUNTS}, groups_sha256 string, same binary, same_n binary, pairs binary, "
             "pairs_n binary")


def identity_counts(found: DataFrame) -> np.ndarray:
    """Links of identity groups by id of A, from one vector per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["same"].to_pylist()), dtype="<u4")
            n = np.frombuffer(b"".join(batch["same_n"].to_pylist()), dtype="<u4")
            if len(ids):
                more = np.bincount(ids, weights=n).astype(np.int64)  # exact below 2^53 links
                size = max(len(more), len(total))
                total = np.pad(total, (0, size - len(total))) + np.pad(more, (0, size - len(more)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["a", "n"])

    rows = found.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r.a for r in rows), default=-1), dtype=np.int64)  # bounded by A's vocabulary
    for r in rows:
        out[r.a] = r.n
    return out


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): links of irregular groups by id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch["pairs"].to_pylist()), dtype=np.int64)
            n = np.frombuffer(b"".join(batch["pairs_n"].to_pylist()), dtype="<u4")
            unique, place = np.unique(pairs, return_inverse=True)
            total = np.bincount(place, weights=n, minlength=len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(total)], names=["pair", "n"])

    return found.select("pairs", "pairs_n").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def asked_pairs(found: DataFrame) -> DataFrame:
    """(block, pair): each block's distinct irregular pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block or 0, dtype=np.int64)), pa.array(pairs)],
                                              names=["block", "pair"])

        for batch in batches:  # rows of a block lie together
            for of, pairs in zip(batch["block"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
                if of != block:
                    yield out()
                    block, held = of, []
                held.append(np.frombuffer(pairs, dtype=np.int64))
        yield out()

    return found.select("block", "pairs").mapInArrow(run, "block long, pair long")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256."""
    spark = docs.sparkSession
    found = cut(found_links(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), path_a, path_b))
    counts = cut(pair_counts(found))
    same_n = identity_counts(found)
    both = Aligner(path_a, path_b)
    same = both.same[:len(same_n)]
    best = np.zeros(len(both.bytes_b), dtype=np.int64)  # the highest count of each id of B
    for r in counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b")).agg(F.max("n").alias("n")).collect():
        best[r.b] = r.n  # one row per id of B
    np.maximum.at(best, same[same >= 0], same_n[same >= 0])
    tables = spark.sparkContext.broadcast((same_n, np.where(same >= 0, best[same], -1) == same_n, best))

    def score(found: pa.Table, known: pa.Table) -> pa.Table:
        same_n, same_best, best = tables.value
        order = np.argsort(pairs := known["pair"].to_numpy())
        pairs, n = pairs[order], known["n"].to_numpy()[order]
        top = best[pairs & ((1 << ID_BITS) - 1)] == n
        best_links, sums = [], []
        for row in zip(*(found[c].to_pylist() for c in ("same", "same_n", "pairs", "pairs_n")), strict=True):
            ids, ids_n, asked, asked_n = (np.frombuffer(x, dtype=t).astype(np.int64)
                                          for x, t in zip(row, ("<u4", "<u4", np.int64, "<u4"), strict=True))
            at = np.searchsorted(pairs, asked)
            best_links.append(int(ids_n[same_best[ids]].sum() + asked_n[top[at]].sum()))
            sums.append(int((ids_n * same_n[ids]).sum() + (asked_n * n[at]).sum()))
        return pa.table({**{c: found[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                         "n_best": pa.array(best_links, pa.int64()), "count_sum": pa.array(sums, pa.int64()),
                         "groups_sha256": found["groups_sha256"]})

    known = asked_pairs(found).join(counts, "pair").select("block", "pair", "n")
    return found.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, RESULT)
