"""Operator 12 against plain Python."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from tenurelens.llm import alignment
from tenurelens.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def token_bytes(tokenizers):
    """Bytes of A's ids by the library's own letters, of B's by its pieces."""
    from tenurelens.llm.byte_bpe import byte_letters
    a, b = tokenizers
    letter = {c: x for x, c in byte_letters().items()}
    of_a = {i: bytes(letter[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    of_b = {}
    for i in range(b.get_piece_size()):
        p = b.id_to_piece(i)
        of_b[i] = bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return of_a, of_b


def brute(rows, tokenizers):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)], every
    pair of occurrences whose byte ranges end together."""
    (a, b), (of_a, of_b) = tokenizers, token_bytes(tokenizers)
    docs, counts = [], Counter()
    for doc_id, text in rows:
        raw = (" " + text).encode() if text else b""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if b"".join(of_a[i] for i in x) != raw or b"".join(of_b[i] for i in y) != raw:
            x, y = [], []
        end_a = dict(zip(np.cumsum([len(of_a[i]) for i in x]).tolist(), x, strict=True))
        end_b = dict(zip(np.cumsum([len(of_b[i]) for i in y]).tolist(), y, strict=True))
        cuts = sorted(end_a.keys() & end_b.keys())
        members = [([], []) for _ in cuts]
        for side, ends in enumerate((end_a, end_b)):
            g = 0
            for at, i in ends.items():  # in order of the text
                g += at > cuts[g]
                members[g][side].append(str(i))
        groups = ["|".join(",".join(side) for side in m) for m in members]
        links = [(end_a[c], end_b[c]) for c in cuts]
        counts.update(links)
        docs.append((doc_id, len(x), len(y), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, groups, links in docs]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark, table, tokenizers):
    got = [tuple(r) for r in QUERIES["op12_cross_tokenizer_alignment"](spark, SF).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(brute(table, tokenizers))


def test_alignment_odd_rows(spark, odd, empty, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 2)  # several blocks a task
    more = spark.createDataFrame([(20, "<s> </s> <unk> ▁ <0x41> A"), (21, "x▁y"), (22, " lead  and trail  "), (23, "\x00\x01 ﬁ ①"),
                                  (24, "<0x41><|endoftext|>"), (25, "日本語テキスト 한국어"), (26, "\n")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(more)
    got = [tuple(r) for r in alignment.align_documents(rows, A, B).select(*COLUMNS).collect()]
    want = brute([(r.doc_id, r.text) for r in rows.collect()], tokenizers)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[1] == 0 and w[0] == 21 for w in want)  # U+2581 itself is not spelled back
    assert alignment.align_documents(empty, A, B).count() == 0
    assert alignment.align_documents(odd, A, B).columns == list(COLUMNS)


def test_identity_map_keeps_the_bytes():
    both = alignment.Aligner(A, B)
    hit = np.flatnonzero(both.same >= 0)
    assert len(hit) > 10_000
    assert all(both.bytes_a[i] == both.bytes_b[both.same[i]] for i in hit)
