"""Rows in ranges of time, for sums over risk sets.

Partial likelihoods need, at every event time, sums over all rows at risk then:
a running sum from the latest time to the earliest.  ``by_time`` deals the rows
once into ranges of (time, row), so that neither many distinct times nor one
time with a third of all rows meets in one task.  A pass reads each range as
arrays and returns a few numbers; a table of those, one row per range, carries
the running sums over to the next pass.  No pass shuffles rows, and what the
driver holds grows with the number of ranges (rows / ``ROWS``), not with rows,
times or ties.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS = 1 << 17  # of a range, about: what a task holds as arrays
FEW = 16  # ranges whose vectors the driver adds itself
_CHUNK = 8192
_SLICE = 4096  # numbers of a vector that travel as one value
_PACKED = "part int, n int, t binary, e binary, h binary, x binary"


class Range:
    """The rows of one range, latest first: times, events, ids and
    values (rows x columns)."""

    def __init__(self, part: int, t: np.ndarray, e: np.ndarray, h: np.ndarray, x: np.ndarray):
        self.part, self.t, self.e, self.h, self.x = part, t, e, h, x
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        self.start, self.end = start, np.concatenate((start[1:], [len(t)]))  # rows of each distinct time
        self.group = np.repeat(np.arange(len(start)), self.end - self.start)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` over the rows of each distinct time."""
        return np.add.reduceat(values, self.start, axis=0)


def _number_of(df: DataFrame, id_col: str | None) -> Column:
    if id_col is None:
        return F.monotonically_increasing_id()
    whole = df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    return F.col(id_col).cast("long") if whole else F.xxhash64(id_col)


def by_time(df: DataFrame, time: str, event: str, columns: list[str], id_col: str | None = None,
            dtype: str = "float64") -> DataFrame:
    """The packed table of ``df``: time, event, the id (the hash of a text, or
    the row's number) and ``columns``, without rows that miss any of them."""
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                     *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)],
                     _number_of(df, id_col).alias("h"))
    rows = cut_lineage(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))
    parts = max(1, math.ceil(rows.count() / ROWS))
    order = [F.col("t").desc(), F.col("salt")]
    width = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                b = batch.slice(at, _CHUNK)
                values = np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in ("t", "e", *(f"x{j}" for j in range(width)))])
                whole = ~np.isnan(values).any(axis=1)  # nulls read as nan
                values = values[whole]
                if not len(values):
                    continue
                cells = [values[:, 0].tobytes(), values[:, 1].tobytes(), b["h"].to_numpy()[whole].tobytes(),
                         np.ascontiguousarray(values[:, 2:]).astype(dtype).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(values)], pa.int32()),
                                                  *(pa.array([c], pa.binary()) for c in cells)],
                                                 names=["part", "n", "t", "e", "h", "x"])

    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    return cut_lineage(ordered.mapInArrow(pack, _PACKED))


def each_range(packed: DataFrame, of: Callable[[Range], list[tuple]], schema: str, dtype: str = "float64",
               extra: str | None = None) -> DataFrame:
    """The rows that ``of`` makes of each range.  ``extra``: a packed column of
    doubles that becomes ``Range.extra``."""
    def make(r: Range) -> pa.RecordBatch:
        rows = of(r)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)],
                                          names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]
    return packed.mapInArrow(_reader(make, dtype, extra), schema)


def _reader(make: Callable[[Range], pa.RecordBatch], dtype: str, extra: str | None):
    """The function over batches that hands each task's range to ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cells = [], {c: [] for c in ("t", "e", "h", "x", extra) if c}
        for batch in batches:
            parts += batch["part"].to_pylist()
            for c, found in cells.items():
                found += batch[c].to_pylist()
        if not parts:
            return
        array = lambda c, kind: np.frombuffer(b"".join(cells[c]), dtype=kind)
        t = array("t", np.float64)
        one = Range(parts[0], t, array("e", np.float64), array("h", np.uint64), array("x", dtype).reshape(len(t), -1))
        if extra:
            one.extra = array(extra, np.float64)
        yield make(one)

    return run


def vector_sum(packed: DataFrame, size: int, of: Callable[[Range], np.ndarray], ranges: int, dtype: str = "float64",
               extra: str | None = None) -> np.ndarray:
    """The sum over all ranges of the vector of ``size`` numbers that ``of``
    makes of each.  Vectors travel in slices, as arrays.  Those of more than
    ``FEW`` ranges are added up slice by slice after a shuffle, so that no more
    than ``FEW`` times ``size`` numbers come to the driver."""
    def make(r: Range) -> pa.RecordBatch:
        v = of(r)
        parts = [(k, x.tobytes()) for k, x in enumerate(np.split(v, range(_SLICE, size, _SLICE))) if x.any()]
        return _slices(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _slices([(k, v.tobytes()) for k, v in _added(batches).items()])

    found = packed.mapInArrow(_reader(make, dtype, extra), "k int, v binary")
    if ranges > FEW:
        found = found.repartition("k").mapInArrow(add, "k int, v binary")
    out = np.zeros(size)
    for k, v in _added([found.toArrow()]).items():
        out[k * _SLICE:(k + 1) * _SLICE] = v
    return out


def _slices(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([v for _, v in parts], pa.binary())], names=["k", "v"])


def _added(batches: Iterator) -> dict[int, np.ndarray]:
    """The sum of the slices of each number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch["k"].to_pylist(), batch["v"].to_pylist(), strict=True):
            v = np.frombuffer(v)
            sums[k] = sums[k] + v if k in sums else v
    return sums
