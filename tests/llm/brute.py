"""Plain-Python versions of the operators, for small tables."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality_base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


ASSIGN = re.compile(r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.ASCII)


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def removed_bytes(docs, length=200):
    """[(n_bytes, n_removed, n_spans, kept_sha256)] for [(doc_id, text)]."""
    seen = Counter()
    for _, text in docs:
        b = (text or "").encode()
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for _, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(w) < 4:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)}


def near_components(docs):
    """{doc_id: (n_shingles, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    index, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in index[x])
        for x in s:
            index[x].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def jump_hash(key, shards):
    """Lamping and Veach's loop on Python integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def mix_targets(sizes):
    """{source: target} by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            target[s] = 2 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def crc(text):
    return zlib.crc32((text or "").encode())
