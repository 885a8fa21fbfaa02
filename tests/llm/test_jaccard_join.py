"""Operator 13 against all pairs that share a shingle."""
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import SF

from tenurelens.llm import jaccard_join
from tenurelens.llm.base import bits_apart, parity
from tenurelens.llm.queries import QUERIES


def linked_components(docs, percent):
    """[(doc_id, n_shingles, component)] of [(doc_id, text)], row by row."""
    sets = [brute.shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x])
        for x in s:
            index[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(docs)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_join(spark, table):
    assert got(QUERIES["op13_ngram_jaccard_join"](spark, SF)) == linked_components(table, 85)


def test_join_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(jaccard_join.link_documents(odd)) == linked_components(rows, 85)
    assert jaccard_join.link_documents(empty).count() == 0


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        rnd.choice((lambda: words.__setitem__(at, f"n{rnd.randrange(10**6)}"), lambda: words.insert(at, f"n{rnd.randrange(10**6)}"),
                    lambda: len(words) > 2 and words.pop(at)))()
    return words


@pytest.mark.parametrize("seed,percent,block,light", [(1, 85, 1024, None), (2, 85, 4, 18), (3, 70, 16, 9)])
def test_join_of_near_copies_of_every_size(spark, monkeypatch, seed, percent, block, light):
    """Groups around the threshold, small and large sets, sizes across the boundary, a passage that many share."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", min(block, 16) // 2)
    monkeypatch.setattr(jaccard_join, "LOCAL", min(block, 64))
    if light:
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    rnd, docs = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for size in (4, 7, 8, 9, 10, 11, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 34, 60, 200, 600):
        for _ in range(3):
            base = [f"w{rnd.randrange(60 if size < 30 else 5000)}" for _ in range(size)]
            for _ in range(7):
                docs.append(" ".join(edited(rnd, base, rnd.randrange(1 + size // 25 + (rnd.random() < 0.5)))
                                     + (passage if size > 100 and rnd.random() < 0.4 else [])))
    rnd.shuffle(docs)
    rows = [(1000 - 2 * i, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(jaccard_join.link_documents(df, percent=percent)) == linked_components(rows, percent)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(2, 7)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(jaccard_join.link_documents(df)) == linked_components(rows, 85)


def test_bounds_lose_no_link():
    rnd = np.random.default_rng(4)
    for _ in range(400):
        n, extra, cut = (int(rnd.integers(*x)) for x in ((1, 400), (0, 60), (0, 60)))
        s = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        t = np.unique(np.concatenate((s[cut:], rnd.integers(0, 2**63, extra, dtype=np.uint64))))
        if not len(t):
            continue
        common = len(np.intersect1d(s, t))
        assert bits_apart([parity(s), parity(t)], np.array([0]), np.array([1]))[0] == jaccard_join.apart(parity(s), parity(t))
        assert jaccard_join.apart(parity(s), parity(t)) <= len(s) + len(t) - 2 * common
        if 100 * common >= 85 * (len(s) + len(t) - common):
            small, large = sorted((len(s), len(t)))
            assert common >= jaccard_join.least_common(small, large) and large <= jaccard_join.largest_partner(small)


def test_boundary_follows_cost():
    cheap, dear = {n: (100, 100.0 * n) for n in range(1, 25)}, {n: (100, 1e9) for n in range(1, 25)}
    assert jaccard_join.boundary(cheap) < jaccard_join.boundary(dear) == jaccard_join.LIGHT_MOST
