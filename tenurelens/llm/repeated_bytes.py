"""Repeated byte strings by bucket-pointer refinement.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts
elsewhere in the corpus, in the same text or another.

Candidates.  Every window of ``LENGTH`` bytes has a leftmost smallest hash of
``GRAM`` bytes, its anchor; equal windows have equal anchors.  Neighbouring
windows with one anchor form a run, and the bytes of a run its context.  Runs
are counted by anchor hash: where one occurs once, nothing repeats.  Where all
contexts of an anchor are equal (64-bit hashes beside that of the anchor), all
of them repeat.

Refinement.  Different contexts of one anchor are refined as suffixes: initial
buckets hold positions with equal ``QGRAM`` bytes, and each round sorts a
bucket's positions by the bucket pointers at the offset reached so far, which
doubles the depth; the pointers of a round serve the next one, until buckets
are equal in exactly ``LENGTH`` bytes.  Windows in a bucket with another
position repeat.  A task refines many anchors at once, ``BLOCK_BYTES`` at a
time.  An anchor with more than ``BUCKET`` different contexts (a passage in
very many texts, at its edges) would be too large for a task: its windows are
counted by their 128-bit hashes in a pre-aggregated group-by instead, which
decides the same question for any number of contexts.

Cases: null text has no bytes; texts shorter than ``LENGTH`` are kept whole;
overlapping and adjacent spans count as one; rows of one id or
of none are documents of their own, told apart by their texts; an empty table stays empty; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

LENGTH = 200
GRAM = 32
QGRAM = 8
BUCKET = 4096
BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 23  # windows of a text that are handled at a time; positions must fit into 24 bits
_U = np.uint64
_LOW = _U((1 << 24) - 1)
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_JOIN = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                         0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM`` (a power of two) bytes long substrings."""
    h, n, i = _BYTE[data], 1, 0
    while n < GRAM:
        h = h[:-n] * _JOIN[i] + h[n:]
        h ^= h >> _U(29)
        n, i = 2 * n, i + 1
    return h * _JOIN[0]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, n = values, 1
    while 2 * n <= width:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    return out if n == width else np.minimum(out[:len(values) - width + 1], out[width - n:])


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in blocks; windows of long texts are
    spread over several segments, each window in one."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, SEGMENT):
            part = text[at:at + SEGMENT + LENGTH - 1]
            if block and size + len(part) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((i, at, part))
            size += len(part)
    if block:
        yield block


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays text number, start, windows, anchor hash, two context hashes."""
    for block in segments(texts):
        data = b"".join(b for _, _, b in block)
        sizes = np.array([len(b) for _, _, b in block])
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        h = gram_hashes(np.frombuffer(data, dtype=np.uint8))
        place = np.arange(len(h), dtype=_U)
        anchor = (window_minimum((h & ~_LOW) | place, LENGTH - GRAM + 1) & _LOW).astype(np.int64)
        inside = np.zeros(len(anchor), dtype=bool)  # windows within one segment
        first = np.zeros(len(anchor) + 1, dtype=bool)
        for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
            inside[b:b + n - LENGTH + 1] = True
            first[b] = True
        new = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], anchor[1:] != anchor[:-1]))))
        at = np.flatnonzero(inside)
        windows = np.diff(np.append(np.searchsorted(at, new), len(at)))
        segment = np.searchsorted(begin, new, side="right") - 1
        number = np.array([i for i, _, _ in block])[segment]
        offset = np.array([o for _, o, _ in block])[segment]
        spans = zip(new.tolist(), (new + windows + LENGTH - 1).tolist(), strict=True)
        context = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in spans]), dtype=np.int64)
        yield (number, new - begin[segment] + offset, windows, h[anchor[new]].astype(np.int64),
               context[::2], context[1::2])


def refine(groups: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text whether each of its windows of ``length`` bytes also
    starts elsewhere in the texts of its group (``groups``: one number a text)."""
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts) + bytes(QGRAM), dtype=np.uint8).astype(_U)
    left = np.repeat(begin[1:], sizes) - np.arange(begin[-1])  # bytes up to the end of the text
    code = np.zeros(begin[-1], dtype=_U)
    for k in range(QGRAM):
        code = (code << _U(8)) | data[k:k + begin[-1]]

    def bucket(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket pointer (last place of the bucket) and size along ``order``."""
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        heads = np.append(np.flatnonzero(new), len(order))
        size = np.repeat(np.diff(heads), np.diff(heads))
        return np.repeat(heads[1:] - 1, np.diff(heads)), size

    pointer = np.zeros(begin[-1], dtype=np.int64)
    shared = np.zeros(begin[-1], dtype=bool)
    group = np.repeat(groups, sizes)
    live = np.flatnonzero(left >= QGRAM)
    order = live[np.lexsort((code[live], group[live]))]
    pointer[order], size = bucket(order, group, code)
    shared[order] = size > 1
    depth = QGRAM
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        shared &= left >= depth  # a bucket of one stays one, however deep
        live = np.flatnonzero(shared)
        later = np.zeros(begin[-1], dtype=np.int64)
        later[live] = pointer[live + step]
        order = live[np.lexsort((later[live], pointer[live]))]
        ends, size = bucket(order, pointer, later)
        heads, members = np.unique(pointer[order], return_counts=True)
        # places of a bucket are numbered downwards from its pointer
        base = heads + 1 - np.cumsum(members)
        pointer[order] = ends + base[np.searchsorted(heads, pointer[order])]
        shared[order] = size > 1
    return [shared[b:b + max(0, n - length + 1)] for b, n in zip(begin.tolist(), sizes.tolist(), strict=False)]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _records(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def context_runs(docs: DataFrame) -> DataFrame:
    """(id, start, windows, key, c1, c2): the runs of ``docs`` (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("key", pa.int64()),
                        ("c1", pa.int64()), ("c2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for number, *rest in runs_of([t.encode() for t in batch["text"].to_pylist()]):
                yield _records(schema, [ids[number], *rest])

    return docs.mapInArrow(run, "id long, start long, windows int, key long, c1 long, c2 long")


def context_bytes(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, c1, c2, bytes) of ``contexts`` (key, c1, c2, id, start, windows)."""
    schema = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found: list[list] = [[], [], [], []]
                for text, wanted in zip(part["text"].to_pylist(), part["wanted"].to_pylist(), strict=True):
                    text = text.encode()
                    for x in wanted:
                        row = (x["key"], x["c1"], x["c2"], text[x["start"]:x["start"] + x["windows"] + LENGTH - 1])
                        for column, value in zip(found, row, strict=True):
                            column.append(value)
                yield _records(schema, found)

    wanted = contexts.groupBy("id").agg(F.collect_list(F.struct("key", "c1", "c2", "start", "windows")).alias("wanted"))
    return docs.join(wanted, "id").select("text", "wanted").mapInArrow(run, "key long, c1 long, c2 long, bytes binary")


BROADCAST_IDS = 500_000  # repeated ids up to this many are broadcast
SPANS = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
SPANS_SQL = "key long, c1 long, c2 long, first int, end int"


def refined(contexts: DataFrame) -> DataFrame:
    """Repeated windows [first, end) of ``contexts`` (key, c1, c2, bytes)."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        found: list[list] = [[], [], [], [], []]
        numbers: dict[int, int] = {}
        groups = np.array([numbers.setdefault(r[0], len(numbers)) for r in rows])
        for row, flags in zip(rows, refine(groups, [r[3] for r in rows]), strict=True):
            for first, end in intervals(flags):
                for column, value in zip(found, (*row[:3], first, end), strict=True):
                    column.append(value)
        return _records(SPANS, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 2 * BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield block(rows)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS_SQL)


def counted(contexts: DataFrame) -> DataFrame:
    """The same for anchors with any number of contexts, by grouping windows."""
    schema = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("window", pa.int32()),
                        ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found: list[list] = [[], [], [], [], [], []]
                for key, c1, c2, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    for w in range(len(text) - LENGTH + 1):
                        h = xxhash.xxh3_128_intdigest(text[w:w + LENGTH])
                        row = (key, c1, c2, w, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63))
                        for column, value in zip(found, row, strict=True):
                            column.append(value)
                yield _records(schema, found)

    windows = contexts.mapInArrow(run, "key long, c1 long, c2 long, window int, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (windows.join(twice, ["h1", "h2"])
            .select("key", "c1", "c2", F.col("window").alias("first"), (F.col("window") + 1).alias("end")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, a, b): byte spans [a, b) of ``docs`` (id, text) that repeat; they
    may overlap."""
    runs = context_runs(docs)
    keys = (runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("lo"), F.max("c1").alias("hi"))
            .where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = cut(runs.join(keys, "key"))
    mixed = shared.where("mixed")
    contexts = cut(mixed.groupBy("key", "c1", "c2")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min_by("start", "id").alias("start"),
                        F.first("windows").alias("windows")))
    many = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
    sized = contexts.join(many, "key")
    small, large = F.col("contexts") <= BUCKET, F.col("contexts") > BUCKET
    parts = refined(context_bytes(sized.where(small), docs)).union(counted(context_bytes(sized.where(large), docs)))
    once = contexts.where("n = 1").select("key", "c1", "c2")
    verdicts = (parts.join(once, ["key", "c1", "c2"], "left_semi")
                .union(contexts.where("n > 1").select("key", "c1", "c2", F.lit(0).alias("first"),
                                                      F.col("windows").alias("end"))))
    whole = shared.where(~F.col("mixed")).select("id", *_span(F.lit(0), F.col("windows")))
    part = mixed.join(verdicts, ["key", "c1", "c2"]).select("id", *_span(F.col("first"), F.col("end")))
    return whole.union(part)


def _span(first: Column, end: Column) -> tuple[Column, Column]:
    return (F.col("start") + first).alias("a"), (F.col("start") + end + LENGTH - 1).alias("b")


def named_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with ``id``: the doc_id where it is one row's
    own, else a hash of it and the text."""
    again = cut(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    own = F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("text"))
    few = again.count()
    if not few:
        return rows.withColumn("id", F.coalesce("doc_id", own))
    again = again.withColumn("again", F.lit(True))
    marked = rows.join(F.broadcast(again) if few <= BROADCAST_IDS else again, "doc_id", "left")
    return marked.select("doc_id", "text", F.when(F.col("doc_id").isNull() | F.col("again"), own).otherwise(F.col("doc_id")).alias("id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = named_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")))
    spans = (repeated_spans(rows.where(F.octet_length("text") >= LENGTH).select("id", "text")).groupBy("id")
             .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for i in range(len(batch)):
                data, merged = batch["text"][i].as_py().encode(), []
                for span in batch["spans"][i].as_py() or ():
                    if merged and span["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span["b"])
                    else:
                        merged.append([span["a"], span["b"]])
                sha, at = hashlib.sha256(), 0
                for a, b in merged:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                row = (batch["doc_id"][i].as_py(), len(data), sum(b - a for a, b in merged), len(merged), sha.hexdigest())
                for column, value in zip(found, row, strict=True):
                    column.append(value)
            yield _records(schema, found)

    return (rows.join(spans, "id", "left").select("doc_id", "text", "spans")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
