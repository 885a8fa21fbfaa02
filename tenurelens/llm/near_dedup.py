"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct word shingles as 64-bit hashes.  Its
signature has ``SYMBOLS`` b-bit MinHash symbols; two sets of similarity s
differ in about (1 - s) of them.  Documents whose signatures differ in at most
``DISTANCE`` symbols are found by pigeonhole: the signature is split into
chunks, some chunk has at most ``RADIUS`` errors, and every choice of symbols
that may err is left out in turn, which makes the keys of an ordinary equality
join.  All pairs within the distance share a key; a pair of similarity 0.8
lies beyond the distance with a probability of a few in a million.  Links are
confirmed on the full sets.

Documents with equal sets are one class and join as one row.  A bucket never
lists all its pairs: its members are first compared with its smallest and its
largest id.  The confirmed links give components; buckets that lie in one
component are done, and only pairs across components remain to be compared.
Buckets are found by pre-aggregated minima and joined back by key, so a hot
bucket is split by AQE and never gathered.

Cases: null, empty or blank texts have the empty set and no links; texts with
fewer words than a shingle are one shingle; rows repeated under an id share
its result; rows without an id link to nothing and are kept; an empty table
stays empty; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrays_of, bits_apart, cut, parity

SHINGLE = 4  # words
SIMILARITY_PCT = 80
SYMBOLS = 100
BITS = 16
DISTANCE = 39  # symbols that may differ
RADIUS = 1  # errors allowed in a chunk
BLOCK = 4096  # members of a bucket that are compared in one task
PAIRS = 1 << 17  # pairs of members that are compared at a time
BLOCK_BYTES = 1 << 20  # text that is hashed at a time
BROADCAST_IDS = 500_000  # id lists up to this many are broadcast, longer ones are joined by shuffle

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C13)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = _stream(256, 1)
_ORDER = _stream(SHINGLE, 2) | _U(1)
_XOR, _MUL = _stream(SYMBOLS, 3), _stream(SYMBOLS, 4) | _U(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a byte buffer."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * np.cumprod(np.full(len(data), _BASE)), out=total[1:])
    shift = np.cumprod(np.full(len(data), _INVERSE))
    return starts, mix((total[ends] - total[starts]) * shift[starts] + (ends - starts).astype(_U))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lowered = [(t or "").encode().lower() for t in texts]  # bytes: A-Z only
    at = 0
    while at < len(lowered):
        end, size = at, 0
        while end < len(lowered) and (end == at or size + len(lowered[end]) <= BLOCK_BYTES):
            size += len(lowered[end]) + 1
            end += 1
        block = lowered[at:end]
        starts, hashes = word_hashes(np.frombuffer(b" ".join(block), dtype=np.uint8))
        bounds = np.concatenate(([0], np.cumsum([len(b) + 1 for b in block])))
        cuts = np.searchsorted(starts, bounds)
        rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=_U)
        for k in range(SHINGLE):
            rolled += hashes[k:k + len(rolled)] * _ORDER[k]
        rolled = mix(rolled)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = b - a
            if n >= SHINGLE:
                yield np.unique(rolled[a:b - SHINGLE + 1])
            elif n:
                yield mix((hashes[a:b] * _ORDER[:n]).sum(keepdims=True, dtype=_U) + _U(n))
            else:
                yield np.zeros(0, dtype=_U)
        at = end


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MinHash symbols for each (non-empty) set."""
    joined = np.concatenate(sets)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((joined ^ _XOR[k]) * _MUL[k], offsets)
        out[:, k] = mix(least) & _U((1 << BITS) - 1)
    return out


def chunk_keys(sigs: np.ndarray, distance: int = DISTANCE, radius: int = RADIUS) -> np.ndarray:
    """The join keys of each signature: any two signatures that differ in at
    most ``distance`` symbols have one in common."""
    n = distance // (radius + 1) + 1  # one chunk of n has at most ``radius`` of ``distance`` errors
    each = mix(sigs.astype(_U) + (np.arange(sigs.shape[1], dtype=_U) << _U(BITS)))
    keys = []
    for chunk in np.array_split(np.arange(sigs.shape[1]), n):
        total = each[:, chunk].sum(axis=1, dtype=_U)
        for left_out in combinations(chunk, min(radius, len(chunk))):
            salt = _U(sum((p + 1) << (16 * i) for i, p in enumerate(left_out)) + (int(chunk[0]) << 48))
            keys.append(mix(total - each[:, list(left_out)].sum(axis=1, dtype=_U) + mix(np.array([salt]))))
    return np.stack(keys, axis=1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set), signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part["text"].to_pylist()))
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full) if full else ())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([next(rows).tobytes() if k else None for k in keys], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def bucket_keys(classes: DataFrame) -> DataFrame:
    """(key, id, n) for every chunk key of ``classes`` (id, n_shingles,
    signature); n is the size of the set."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                sigs = np.frombuffer(b"".join(part["signature"].to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
                keys = chunk_keys(sigs).astype(np.int64)
                ids, sizes = (np.repeat(part[c].to_numpy(), keys.shape[1]) for c in ("id", "n_shingles"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(sizes.astype(np.int32))],
                                                 schema=schema)

    return classes.mapInArrow(run, "key long, id long, n int")


def sizes_fit(m: Column, n: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(m, n) >= SIMILARITY_PCT * F.greatest(m, n)


def near_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures lie within the distance."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("signature").alias(f"sig_{x}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
                   for c in ("sig_a", "sig_b")]
            keep = pa.array((sig[0] != sig[1]).sum(axis=1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], schema=schema)

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(run, "a long, b long")


def across_components(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``members`` (key, id, component) that share a key,
    lie within the distance, and belong to different components.  ``classes``:
    id, n_shingles, signature, bitmap.

    The members of a bucket are compared by arrays of signatures, ``BLOCK`` of
    them at a time; larger buckets are cut into blocks and every two blocks
    meet in a task of their own.  Of the pairs within the distance those go on
    whose sets can be similar enough by their parity bitmaps, a bound that no
    link exceeds, each from the smallest key that both signatures have."""
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = (members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
              .withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("key", F.least("block", "met").alias("x"), F.greatest("block", "met").alias("y"), "block", "id",
                      "component").join(classes, "id"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All i < j with equal ``bucket`` (ascending), ``PAIRS`` at a time."""
        n = len(bucket)
        later = np.searchsorted(bucket, bucket, side="right") - np.arange(n) - 1
        upto = np.concatenate(([0], np.cumsum(later)))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(at, end), later[at:end])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[at:end] - upto[at], later[at:end])
            at = end

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, x, y, block, ids, part, sizes = (table[i].to_numpy() for i in range(7))
        sigs = np.frombuffer(b"".join(table[7].to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
        bitmaps = [np.frombuffer(b, dtype=_U) for b in table[8].to_pylist()]
        new = np.concatenate(([False], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        for i, j in pairs_of(np.cumsum(new)):
            use = part[i] != part[j]
            i, j = i[use], j[use]
            use = 100 * np.minimum(sizes[i], sizes[j]) >= SIMILARITY_PCT * np.maximum(sizes[i], sizes[j])
            use &= (x[i] == y[i]) | (block[i] != block[j])
            i, j = i[use], j[use]
            use = (sigs[i] != sigs[j]).sum(axis=1) <= DISTANCE
            i, j = i[use], j[use]
            both = sizes[i] + sizes[j]
            use = bits_apart(bitmaps, i, j) <= both - 2 * -(-SIMILARITY_PCT * both // (100 + SIMILARITY_PCT))
            i, j = i[use], j[use]
            if len(i):
                mine, theirs = chunk_keys(sigs[i]).astype(np.int64), chunk_keys(sigs[j]).astype(np.int64)
                first = np.where(mine == theirs, theirs, np.iinfo(np.int64).max).min(axis=1) == key[i]
                a, b = ids[i[first]], ids[j[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # whole buckets at a time
            last = np.flatnonzero(np.diff(batch["key"].to_numpy()))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield from compare(pa.Table.from_batches(held))

    order = ["key", "x", "y"]
    return (placed.select(*order, "block", "id", "component", "n_shingles", "signature", "bitmap")
            .repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long"))


def full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the documents whose ids are in ``wanted`` (doc_id)."""
    wanted = cut(wanted)
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [s.tobytes() for s in shingle_sets(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, pa.binary())], schema=schema)

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "id long, shingles binary").dropDuplicates(["id"])


def bitmaps(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, bitmap): parity bitmaps of the documents in ``wanted`` (doc_id)."""
    wanted = cut(wanted)
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [parity(s).tobytes() for s in shingle_sets(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(made, pa.binary())], names=["id", "bitmap"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, bitmap binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(arrays_of(batch["set_a"], _U), arrays_of(batch["set_b"], _U), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= SIMILARITY_PCT * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    ends = [pairs.select(F.col(x).alias("doc_id")).distinct() for x in ("a", "b")]
    full = cut(full_sets(ends[0].union(ends[1]).distinct(), docs))
    side = lambda x: full.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``links`` (a, b); the component is its
    smallest id.  Labels spread to neighbours and jump to their label's label
    until nothing changes."""
    edges = cut(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                             .alias("e")).select(F.col("e.a").alias("id"), F.col("e.b").alias("other")).distinct())
    labels = cut(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")))
    while True:
        near = (edges.join(labels.select(F.col("id").alias("other"), "component"), "other")
                .groupBy("id").agg(F.min("component").alias("near")))
        spread = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("root"))
        moved = cut(spread.join(jump, "component", "left")
                    .select("id", F.least("component", F.coalesce("root", "component")).alias("component"), "old"))
        labels = moved.select("id", "component")
        if moved.where("component != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = cut(features(docs))
    named = found.where("doc_id IS NOT NULL")
    first = named.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    members = found.join(first, "set_key", "left")
    classes = cut(members.where("doc_id = id").select("id", "n_shingles", "signature").dropDuplicates(["id"]))

    keys = bucket_keys(classes)
    buckets = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"),
                                      F.min_by("n", "id").alias("low_n"), F.max_by("n", "id").alias("high_n"))
    shared = cut(keys.join(buckets.where("low < high"), "key"))
    end = lambda a, b, m: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(m).alias("m"))
    ends = shared.select("n", F.explode(F.array(end("low", "id", "low_n"), end("id", "high", "high_n"))).alias("p"))
    tested = ends.where((F.col("p.a") < F.col("p.b")) & sizes_fit(F.col("p.m"), F.col("n"))).select("p.a", "p.b").distinct()
    links = cut(confirm(cut(near_signatures(cut(tested), classes)), docs))
    labels = components(links)

    label = F.coalesce("component", "id")
    placed = shared.select("key", "id").join(labels, "id", "left").select("key", "id", label.alias("component"))
    open_keys = (placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                 .where("x < y").select("key"))
    rest = cut(placed.join(open_keys, "key"))
    made = bitmaps(rest.select(F.col("id").alias("doc_id")).distinct(), docs)
    open_classes = classes.join(made, "id").select("id", "n_shingles", "signature", "bitmap")
    more = cut(confirm(cut(across_components(rest, cut(open_classes))), docs))
    if not more.isEmpty():
        labels = components(links.union(more))

    placed = members.join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return (placed.select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]), "left_semi")
