"""Packing documents into sequences by minimum bin slack.

Documents become token ids (a public byte-level BPE, strings of its added
tokens as those tokens) plus an end id; only documents longer than a sequence
are cut.  Sequences are filled one after the other: the longest piece left
opens a sequence and a subset-sum table over the lengths left (a bitset of
reachable fills, each length up to as often as it is left) finds the fullest
combination for the rest, which is then removed.

Pieces of one length are alike, so the search needs only the number of pieces
of every length: at most ``CAPACITY`` numbers, whatever the size of the
corpus.  A combination found once is used as often as the numbers allow, each
use of it exhausts a length, and so the driver's work and the table of
combinations are bounded by the number of lengths, not by the data.

Which piece gets which place is a join: a piece's rank among the pieces of its
length is its rank in its input partition (counted while tokenising) plus the
pieces of that length in earlier partitions.  No group of equal lengths is
ever sorted or gathered.

Cases: null or empty text is the end id alone; pieces of full length are
sequences of their own; repeated rows are packed as often as they come; an
empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .byte_bpe import ByteBpe

CAPACITY = 2048
END_ID = 0
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces; only the first may be shorter."""
    full, rest = divmod(total, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
             capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with ``part`` (input partition) and ``place`` (rank
    among the pieces of its length in that partition)."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, bpe = TaskContext.get().partitionId(), Counter(), ByteBpe(tokenizer, special=True)
        for batch in batches:
            columns: list[list] = [[] for _ in PIECE]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data, start = np.array(bpe.encode(text), dtype="<u4").tobytes() + end, 0
                for i, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                    crc = zlib.crc32(data[4 * start:4 * (start + n)])
                    for column, value in zip(columns, (doc_id, i, start, n, crc, part, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)],
                                             schema=PIECE)

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length of ``left`` (length: pieces) so that their
    sum is as near to ``room`` as can be, never above."""
    mask, reach = (1 << (room + 1)) - 1, 1
    items, before = [], []
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        copies, step = min(left[length], room // length), 1
        while copies:
            step = min(step, copies)
            items.append((length, step))
            before.append(reach)
            reach |= (reach << (length * step)) & mask
            copies -= step
            step *= 2
        if reach >> room & 1:
            break
    fill, used = reach.bit_length() - 1, Counter()
    for (length, step), old in zip(reversed(items), reversed(before), strict=True):
        if not old >> fill & 1:
            used[length] += step
            fill -= length * step
    return used


def combinations(numbers: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: pieces in each}) until every piece is placed."""
    left, found = {k: v for k, v in numbers.items() if v}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        use = Counter({longest: 1}) + Counter(fullest(rest, capacity - longest))
        times = min(left[x] // n for x, n in use.items())
        found.append((times, dict(use)))
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return found


def places(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces per sequence,
    offset): where the pieces of each length go."""
    rows, used, sequence = [], Counter(), 0
    for times, use in found:
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    spark = docs.sparkSession
    pieces = cut(tokenise(docs, tokenizer, id_col, text_col, capacity))
    counts = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    numbers = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if len(numbers) > capacity:
        raise ValueError("more lengths than a sequence has places")
    table = spark.createDataFrame(places(combinations(numbers, capacity)),
                                  "len long, first long, end long, sequence long, per long, shift long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    turn = F.col("rank") - F.col("first")
    return (ranked.join(F.broadcast(table),  # bounded by the number of lengths
                        (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("end")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("sequence") + F.floor(turn / F.col("per"))).cast("long").alias("sequence_id"),
                    (F.col("shift") + F.pmod(turn, F.col("per")) * F.col("length")).cast("long").alias("offset")))
