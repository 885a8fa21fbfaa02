"""Jaccard join of word n-gram sets by a size-aware heavy-light join.

Documents with equal sets are one class.  Classes whose sets differ link when
100 * intersection >= 85 * union, and a document's component is the smallest id
it reaches over links.

Light: for two small sets of m and n shingles the least intersection c(m, n) is
so near to their sizes that all subsets of c shingles can be listed; the two
link exactly if they list one in common.  All small sets that list the same
subset for the same (m, n) link across its two sizes, so each is linked to the
first set of the other side: as many links as listed subsets, none lost.

Heavy: a larger set scans inverted lists.  With the shingles of every set in
one order, the prefixes of two linked sets share two shingles (for the smaller
set the short prefix, as its partner is no smaller); the order puts shingles of
rarely used cells of a fixed table of counts first, so common passages come
last.  Lists of up to ``SHORT_LIST`` members give their pairs, of which those
met twice go on.  In longer lists members are compared by parity bitmaps: a
shingle in one set only flips a bit, so the number of bits that differ bounds
the symmetric difference from below and no link is lost.  They are first
compared inside small blocks, which joins most of a group of copies, and then
wherever members of a list still lie in different components.  Two sets that
share two shingles of their prefixes meet twice in short lists or once in a
longer one.  Pairs that remain are confirmed on the full sets.

The boundary between light and heavy is the size at which the listed subsets
and the scanned postings of all small sets together cost least.

Cases: null, empty and blank texts have an empty set and link to nothing; a
text of fewer words than a shingle is one shingle of all its words; repeated
rows share a class; rows without an id link like others and get the smallest id
of their component (null if it has none); an empty table gives an empty result.
Long texts stay whole.  Shingles are compared by 64-bit hashes.  Memory: a task
holds the sets of one batch of documents, the table of counts (2^20 bytes) and
blocks of ``BLOCK`` list members.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrays_of, cut, fold, parity
from .near_dedup import components, mix, shingle_sets

PERCENT = 85
CELL_BITS = 20  # cells of the table of counts; any table gives the same links
LIGHT_MOST = 24  # sizes that may be light
SHORT_LIST = 16
LOCAL = 16  # members of a long list compared at first
BLOCK = 1024  # members of a list compared at once
PAIRS = 1 << 18
_U = np.uint64
_SLICE = 4096


def least_common(m, n, percent: int = PERCENT):
    """Least intersection of linked sets of m and n shingles."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Prefix of a set against sets no smaller, and against any: linked sets
    of two shingles and more share two shingles of theirs."""
    return int(n - least_common(n, n, percent) + 2), int(n - -(-percent * n // 100) + 2)


def largest_partner(n, percent: int = PERCENT):
    return 100 * n // percent


# ---------------------------------------------------------------------------
# sets of every document
# ---------------------------------------------------------------------------
def cell_counts(docs: DataFrame) -> np.ndarray:
    """A byte per cell of the hash space: eight times the binary logarithm of
    its shingles over all documents.  Its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = list(shingle_sets(batch.slice(at, 256)["text"].to_pylist()))
                cells = (np.concatenate(sets) >> _U(64 - CELL_BITS)).astype(np.int64)
                total += np.bincount(cells, minlength=len(total))
        parts = [(i // _SLICE, total[i:i + _SLICE]) for i in range(0, len(total), _SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()),
                                          pa.array([p[1].tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, None

        def done() -> pa.RecordBatch:
            byte = np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([byte.tobytes()], pa.binary())],
                                              names=["slice", "counts"])

        for batch in batches:
            for i, counts in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if i != number:
                    if number is not None:
                        yield done()
                    number, total = i, np.zeros(_SLICE, dtype=np.int64)
                total += np.frombuffer(counts, dtype=np.int64)
        if number is not None:
            yield done()

    schema = "slice int, counts binary"
    slices = (docs.select("text").mapInArrow(count, schema).repartition("slice").sortWithinPartitions("slice")
              .mapInArrow(add, schema).collect())  # a fixed number of fixed slices
    out = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    for r in slices:
        out[r["slice"] * _SLICE:(r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (size of the set), set_key (null: empty), head (the shingles
    of the prefix, rare cells first; of small sets all), bitmap, scan (about
    how many postings the prefix meets)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("head", pa.binary()),
                        ("bitmap", pa.binary()), ("scan", pa.float64())])
    size = np.exp2(counts / 8.0) - 1
    met = 1 + np.maximum(0, size - 1.2 * np.median(size) - 4)  # above what any cell holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.slice(at, 256), []
                for s in shingle_sets(part["text"].to_pylist()):
                    if not len(s):
                        rows.append((0, None, None, None, 0.0))
                        continue
                    cells = (s >> _U(64 - CELL_BITS)).astype(np.int64)
                    order = np.argsort(counts[cells], kind="stable")
                    n = len(s)
                    long = prefix_lengths(n, percent)[1]
                    rows.append((n, set_key(s), s[order[:n if n <= LIGHT_MOST else long]].tobytes(), parity(s).tobytes(),
                                 float(met[cells[order[:long]]].sum())))
                columns = [part["doc_id"], *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, head binary, bitmap binary, scan double")


# ---------------------------------------------------------------------------
# light sets
# ---------------------------------------------------------------------------
def partner_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    return [m for m in range(-(-percent * n // 100), min(most, int(largest_partner(n, percent))) + 1)
            if least_common(m, n, percent) < max(m, n)]  # else only equal sets link


def light_cost(n: int, most: int, percent: int = PERCENT) -> int:
    """Subsets that a set of n shingles lists if sizes up to ``most`` are light."""
    return sum(comb(n, int(least_common(m, n, percent))) for m in partner_sizes(n, most, percent))


def boundary(sizes: dict[int, tuple[int, float]], percent: int = PERCENT) -> int:
    """The largest light size, from {n: (sets, postings they would scan)}."""
    def cost(most: int) -> float:
        return sum(k * light_cost(n, most, percent) if n <= most else scan for n, (k, scan) in sizes.items())
    return min(range(1, LIGHT_MOST + 1), key=lambda most: (cost(most), most))


def light_links(sets: DataFrame, most: int, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among sets of at most ``most`` shingles; ``sets``: id, n, head."""
    schema = pa.schema([("key", pa.int64()), ("larger", pa.bool_()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, head in zip(batch["id"].to_pylist(), batch["head"].to_pylist(), strict=True):
                s = np.sort(np.frombuffer(head, dtype=_U))
                for m in partner_sizes(len(s), most, percent):
                    salt = mix(np.array([min(m, len(s)) << 32 | max(m, len(s))], dtype=_U))
                    chosen = np.array(list(combinations(range(len(s)), int(least_common(m, len(s), percent)))))
                    keys = mix(mix(s)[chosen].sum(axis=1, dtype=_U) + salt).astype(np.int64)
                    rows += [(k, len(s) > m, i) for k in keys.tolist()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # sizes that are equal have one side: every set there is the other side, too
    listed = sets.where(F.col("n") <= most).select("id", "head").mapInArrow(run, "key long, larger boolean, id long")
    firsts = listed.groupBy("key").agg(F.min(F.when(~F.col("larger"), F.col("id"))).alias("low"),
                                       F.min(F.when(F.col("larger"), F.col("id"))).alias("high"),
                                       F.bool_or("larger").alias("two"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = F.when(F.col("larger") | ~F.col("two"), F.col("low")).otherwise(F.col("high"))
    return (listed.join(firsts, "key").withColumn("other", other).where("other IS NOT NULL AND other != id")
            .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())


# ---------------------------------------------------------------------------
# heavy sets
# ---------------------------------------------------------------------------
_POSTING = pa.schema([("token", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("short", pa.bool_())])


def postings(sets: DataFrame, most: int, percent: int = PERCENT) -> DataFrame:
    """(token, n, id, short): the prefixes of sets above ``most``, and of the
    lighter sets that may link to one.  ``short``: in the short prefix, too."""
    lightest = -(-percent * (most + 1) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes, ids, short = [], [], [], []
            for n, i, head in zip(batch["n"].to_pylist(), batch["id"].to_pylist(), batch["head"].to_pylist(), strict=True):
                near, far = prefix_lengths(n, percent)
                s = np.frombuffer(head, dtype=np.int64)[:far if n > most else near]
                tokens.append(s)
                sizes.append(np.full(len(s), n))
                ids.append(np.full(len(s), i))
                short.append(np.arange(len(s)) < near)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type)
                                                  for x, f in zip((tokens, sizes, ids, short), _POSTING, strict=True)], schema=_POSTING)

    return sets.where(F.col("n") >= lightest).select("n", "id", "head").mapInArrow(
        run, "token long, n long, id long, short boolean")


def met_members(listed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What meets in the lists: for lists of up to ``SHORT_LIST`` members the
    pairs whose sizes fit (id, other; token null), for longer ones the postings
    (other null).  Lists are read as a stream; no more than a batch is held."""
    names = [*_POSTING.names, "other"]

    def pairs_of(rows: pa.RecordBatch | pa.Table, use: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, n, i, short = (rows[c].to_numpy() for c in _POSTING.names)
        for d in range(1, SHORT_LIST):
            at = np.flatnonzero((token[d:] == token[:-d]) & use[:-d] & short[:-d] & (n[d:] <= largest_partner(n[:-d], percent)))
            if len(at):
                none = pa.nulls(len(at), pa.int64())
                a, b = np.minimum(i[at], i[at + d]), np.maximum(i[at], i[at + d])
                yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.nulls(len(at), pa.bool_()), pa.array(b)], names=names)

    def split(rows: pa.Table, long_token: int | None) -> Iterator[pa.RecordBatch]:
        """Whole lists, the first perhaps the rest of a long one."""
        token = rows["token"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.concatenate((start, [len(token)])))
        long = size > SHORT_LIST
        long[0] |= token[0] == long_token
        long = np.repeat(long, size)
        yield from pairs_of(rows, ~long & (np.repeat(size, size) > 1))
        if long.any():
            kept = rows.filter(pa.array(long)).combine_chunks()
            for batch in kept.append_column("other", pa.nulls(len(kept), pa.int64())).to_batches():
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_token = None, None  # the last list so far; the token of a long list of which rows went out
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if not len(rows):
                continue
            token = rows["token"].to_numpy()
            cut_at = int(np.searchsorted(token, token[-1]))
            if cut_at:
                yield from split(rows.slice(0, cut_at), long_token)
            held = rows.slice(cut_at).combine_chunks()
            if len(held) > SHORT_LIST or token[-1] == long_token:
                long_token = int(token[-1])
                yield from split(held, long_token)
                held = None
        if held is not None:
            yield from split(held, long_token)

    order = ("token", "n", "id")
    return (listed.repartition("token").sortWithinPartitions(*order)
            .mapInArrow(run, "token long, n long, id long, short boolean, other long"))


def apart(x: np.ndarray, y: np.ndarray) -> int:
    words = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())


def near_bitmaps(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that may link by their bitmaps."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bits_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([apart(x, y) <= m + n - 2 * least_common(m, n, percent)
                             for m, n, x, y in zip(batch["n_a"].to_pylist(), batch["n_b"].to_pylist(), arrays_of(batch["bits_a"], _U),
                                                   arrays_of(batch["bits_b"], _U), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
            .mapInArrow(run, "a long, b long"))


def long_members(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """The postings of long lists with the bitmap of each member and the
    tokens of all its long lists (no more than its prefix)."""
    of = postings.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return postings.join(of.join(sets.select("id", "bitmap"), "id"), "id")


def near_members(members: DataFrame, across: bool, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of ``members`` (of ``long_members``, with component) of one
    list and different components that may link by their bitmaps.

    A list is cut into blocks by a hash of the id.  With ``across`` every two
    blocks of ``BLOCK`` meet in a task of their own, and a pair comes from the
    first list that both share; else only members of a block of ``LOCAL``."""
    size, key = (BLOCK, F.xxhash64("id")) if across else (LOCAL, F.xxhash64("id", "token"))
    blocks = members.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    met = members.join(blocks, "token").withColumn("block", F.pmod(key, F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1) if across else F.array("block")
    met = (met.withColumn("met", F.explode(others))
           .select("token", F.least("block", "met").alias("x"), F.greatest("block", "met").alias("y"), "block", "n", "id", "short",
                   "component", "bitmap", "tokens"))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, x, y, block, n, ids, short, part = (table[i].to_numpy() for i in range(8))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        bitmaps = [np.frombuffer(b, dtype=_U) for b in table[8].to_pylist()]
        words = np.array([len(b) for b in bitmaps])
        stacked = {w: np.stack([fold(bitmaps[k], w) for k in np.flatnonzero((words == w) | (words == 2 * w))]) for w in set(words.tolist())}
        place = {w: np.cumsum((words == w) | (words == 2 * w)) - 1 for w in stacked}
        starts = np.flatnonzero(new)
        stops = np.concatenate((starts[1:], [len(ids)]))
        last = np.empty(len(ids), dtype=np.int64)  # members are in order of n: partners end where sizes grow too large
        for s, e in zip(starts, stops, strict=True):
            last[s:e] = s + np.searchsorted(n[s:e], largest_partner(n[s:e], percent), side="right")
        count = np.where(short, last - np.arange(len(ids)) - 1, 0)
        upto = np.concatenate(([0], np.cumsum(count)))
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(at, end), count[at:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:end] - upto[at], count[at:end])
            at = end
            use = (part[i] != part[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
            i, j = i[use], j[use]
            room = n[i] + n[j] - 2 * least_common(n[i], n[j], percent)
            keep = np.zeros(len(i), dtype=bool)
            for w, rows in stacked.items():
                mine = np.flatnonzero(words[i] == w)
                keep[mine] = np.bitwise_count(rows[place[w][i[mine]]] ^ rows[place[w][j[mine]]]).sum(axis=1) <= room[mine]
            i, j = i[keep], j[keep]
            if across and len(i):
                lists = {k: set(table[9][k].as_py()) for k in np.unique(np.concatenate((i, j))).tolist()}
                first = np.array([min(lists[p] & lists[q]) == token[p] for p, q in zip(i.tolist(), j.tolist(), strict=True)])
                i, j = i[first], j[first]
            a, b = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # whole lists at a time
            tokens = batch["token"].to_numpy()
            cuts = np.flatnonzero(tokens[1:] != tokens[:-1])
            cut_at = int(cuts[-1]) + 1 if len(cuts) else 0
            if cut_at:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield from compare(pa.Table.from_batches(held))

    order = ("token", "x", "y", "n", "id")
    return met.repartition("token", "x", "y").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets link, with the sets made anew from the
    texts.  ``sets``: id, set_key, doc_id (of one document with that set)."""
    ends = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id").join(sets, "id")
               .select("id", "set_key", "doc_id"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = list(shingle_sets(batch.slice(at, 256)["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) if len(s) else None for s in found], pa.binary()),
                                                  pa.array([s.tobytes() for s in found], pa.binary())], names=["set_key", "shingles"])

    wanted = ends.select(F.col("doc_id").alias("wanted")).distinct()
    made = (docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi").select("text")
            .mapInArrow(shingled, "set_key binary, shingles binary"))
    full = cut(ends.select("id", "set_key").join(made, "set_key").select("id", "shingles").dropDuplicates(["id"]))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(arrays_of(batch["set_a"], _U), arrays_of(batch["set_b"], _U), strict=True):
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    side = lambda x: full.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(linked, "a long, b long"))


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further ``links`` (a, b): components of the
    components, so that links inside one are not walked again."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b").distinct()
    merged = cut(components(cut(ends)).withColumnRenamed("id", "was").withColumnRenamed("component", "now"))
    known = labels.join(merged, labels["component"] == merged["was"], "left").select("id", F.coalesce("now", "component").alias("component"))
    new = merged.select(F.col("was").alias("id"), F.col("now").alias("component")).join(labels, "id", "left_anti")
    return known.union(new)


# ---------------------------------------------------------------------------
# the join
# ---------------------------------------------------------------------------
def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = cut(features(docs, cell_counts(docs), percent).withColumn("row", F.monotonically_increasing_id()))
    classes = cut(found.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id")))
    sets = cut(found.select(F.col("row").alias("id"), "n", "head", "bitmap", "scan").join(classes.select("id"), "id", "left_semi"))

    small = sets.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.sum("scan").alias("s")).collect()
    most = boundary({r.n: (r.k, r.s) for r in small}, percent)
    met = cut(met_members(postings(sets, most, percent), percent))
    twice = (met.where("other IS NOT NULL").groupBy(F.col("id").alias("a"), F.col("other").alias("b"))
             .agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "b"))
    members = cut(long_members(met.where("other IS NULL").drop("other"), sets))
    nearby = near_members(members.withColumn("component", F.col("id")), False, percent).distinct()
    pairs = light_links(sets, most, percent).union(near_bitmaps(twice, sets, percent)).union(nearby).distinct()
    links = cut(confirm(cut(pairs), classes, docs, percent))
    labels = components(links)

    placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_tokens = (placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
                   .select("token"))
    pairs = cut(near_members(cut(placed.join(open_tokens, "token")), True, percent).distinct())
    more = cut(confirm(pairs, classes, docs, percent))
    if not more.isEmpty():
        labels = joined_labels(labels, more)

    placed = classes.join(labels, "id", "left").select("set_key", "doc_id", F.coalesce("component", "id").alias("component"))
    first = placed.groupBy("component").agg(F.min("doc_id").alias("first"))
    named = placed.join(first, "component").select("set_key", "first")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return found.join(named, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
