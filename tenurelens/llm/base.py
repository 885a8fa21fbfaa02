"""Shared pieces of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# White space of every contract here: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is its DuckDB oracle."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column used inside a higher-order function would otherwise be inlined
    into the lambda and evaluated once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text (``WORD``), split at runs of white space."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrays_of(column: pa.Array, dtype) -> list[np.ndarray]:
    """The cells of a binary column as arrays over its own memory, no copies.
    Cells without nulls; ``dtype`` must divide their lengths."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].tolist()
    size = np.dtype(dtype).itemsize
    return [np.frombuffer(data, dtype=dtype, count=(b - a) // size, offset=a) if b > a else np.zeros(0, dtype=dtype)
            for a, b in zip(at, at[1:], strict=False)]


# ---------------------------------------------------------------------------
# parity bitmaps of sets of 64-bit hashes
# ---------------------------------------------------------------------------
def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap whose bits count hashes modulo 2; 2 to 4 bits a hash.  Halves of
    it xored are the bitmap of half the size.  A hash in one of two sets only
    flips a bit, so the bits that differ bound the symmetric difference of the
    sets from below."""
    bits = 1 << max(6, int(2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def bits_apart(bitmaps: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of ``bitmaps[i]`` and ``bitmaps[j]``, pair by pair."""
    words = np.array([len(b) for b in bitmaps])
    least, out = np.minimum(words[i], words[j]), np.zeros(len(i), dtype=np.int64)
    for w in np.unique(least):
        mine = np.flatnonzero(least == w)
        used, at = np.unique(np.concatenate((i[mine], j[mine])), return_inverse=True)
        rows = np.stack([fold(bitmaps[k], w) for k in used])
        out[mine] = np.bitwise_count(rows[at[:len(mine)]] ^ rows[at[len(mine):]]).sum(axis=1)
    return out
