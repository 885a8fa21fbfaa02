"""Operators 3, 4, 5, 7, 8 and 10 against plain Python."""
import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tenurelens.llm import language_id, near_dedup, packing, repeated_bytes, sharding, warc
from tenurelens.llm.byte_bpe import ByteBpe
from tenurelens.llm.queries import QUERIES, SHARDS, op10
from tenurelens.session import ensure_checkpoint_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")


def pages_of(rows):
    """{page: (bytes, digest, type, refers_to)} of [(page_id, html)]."""
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, html in rows:
        data, keep = (html or "").encode(), first.get(html or "")
        response = keep is None or i == keep
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if response else "revisit", None if response else keep))
    return out


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = [tuple(r) for r in QUERIES["op3_warc"](spark, SF).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got) == sorted(pages_of([tuple(r) for r in pages]))


def test_warc_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)  # several archives a task
    rows = [(5, "x"), (3, "x"), (3, "x"), (4, None), (9, ""), (None, "x"), (None, "only here"), (7, "é" * 300_000),
            (8, "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(i, "http://h/a b\r\nX: 1" if i == 5 else None, h, "z") for i, h in rows],
                               "page_id long, url string, html string, refers_to string")
    manifest = warc.write_archives(df.coalesce(1), f"{ensure_checkpoint_dir(spark)}/odd-{tmp_path.name}")
    assert manifest.count() > 3
    got = [tuple(r) for r in warc.read_archives(manifest).drop("target_uri").collect()]
    assert sorted(got, key=str) == sorted(pages_of(rows), key=str)
    none = warc.write_archives(df.limit(0), f"{ensure_checkpoint_dir(spark)}/none-{tmp_path.name}")
    assert warc.read_archives(none).count() == 0


def test_warc_reader_is_incremental_and_verifies():
    records = [warc.record_bytes(1, "u", b"a" * 3_000_000, None), warc.record_bytes(2, None, b"", 1)]
    found = list(warc.read_records(io.BytesIO(b"".join(records))))
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in found] == [(1, 3_000_000, None), (2, 0, 1)]

    def repacked(old, new):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(zlib.decompress(warc.record_bytes(1, "u", b"payload", None), 31).replace(old, new)) + packer.flush()

    for broken in (repacked(b"payload", b"pAyload"), repacked(b"payload", b"payload+"), repacked(b"payload", b""),
                   records[0][:-20]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken)))


def test_jump_hash_equals_the_published_loop():
    keys = np.array([0, 1, -1, 2**62, -(2**63), *range(10**6, 10**6 + 500)], dtype=np.int64)
    for n in (1, 2, 40, 1000):
        assert sharding.jump(keys, n).tolist() == [brute.jump_hash(int(k) % (1 << 64), n) for k in keys]


def test_sharding(spark, table, odd, empty):
    texts = dict(table)
    rows = QUERIES["op4_sharding"](spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, brute.crc(texts[r.doc_id]))
        assert r.law == "key" and r.grown_shard in (r.shard, SHARDS) and 0 <= r.shard < SHARDS
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards = {r.doc_id: r.shard for r in rows}
    half = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    assert all(shards[r.doc_id] == r.shard for r in sharding.shard_documents(half, SHARDS).collect())
    found = sharding.shard_documents(odd, 3).collect()
    assert len(found) == odd.count() and len({(r.shard, r.slot) for r in found}) == len(found)
    assert {r.size for r in found if r.doc_id in (1, 2)} == {16}
    assert sharding.shard_documents(empty, 3).count() == 0


@pytest.mark.parametrize("length", [8, 9, 20, 33])
def test_refinement_equals_counting(length):
    rnd = random.Random(length)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60))) for _ in range(6)]
        groups = np.array([rnd.randrange(3) for _ in texts])
        seen = Counter((g, t[k:k + length]) for g, t in zip(groups, texts, strict=True) for k in range(len(t) - length + 1))
        for g, t, flags in zip(groups, texts, repeated_bytes.refine(groups, texts, length), strict=True):
            assert flags.tolist() == [seen[g, t[k:k + length]] > 1 for k in range(len(t) - length + 1)]


def planted():
    rnd = random.Random(11)
    rs = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage = rs(260)
    docs = [(i, rs(rnd.randrange(400)) + passage[rnd.randrange(30):] + rs(rnd.randrange(300))) for i in range(40)]
    more = ["a" * 300, "ab" * 150, None, "", "x" * 199, "abc" * 70, rs(169) * 4, "q" * 200, "q" * 200, "z" * 200,
            rs(170) * 3 + rs(169) * 3]
    return docs + [(100 + i, t) for i, t in enumerate(more)]


@pytest.mark.parametrize("bucket, segment", [(4096, 1 << 23), (4, 64)])
def test_repeated_bytes(spark, table, monkeypatch, bucket, segment):
    monkeypatch.setattr(repeated_bytes, "BUCKET", bucket)
    monkeypatch.setattr(repeated_bytes, "SEGMENT", segment)
    docs = planted() + [(1000 + i, t) for i, t in table[:40]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.remove_repeats(df).collect()}
    assert got == dict(zip([i for i, _ in docs], brute.removed_bytes(docs), strict=True))


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(repeated_bytes, "SEGMENT", 50)
    rnd = random.Random(2)
    text = bytes(rnd.choice(b"abcd") for _ in range(900))
    seen = []
    for number, start, windows, *_ in repeated_bytes.runs_of([b"short", text, text[:250]]):
        seen += [(int(i), int(s) + k) for i, s, n in zip(number, start, windows, strict=True) for k in range(int(n))]
    assert sorted(seen) == [(1, k) for k in range(701)] + [(2, k) for k in range(51)]


def test_repeated_bytes_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.remove_repeats(odd).collect())
    assert got == sorted(brute.removed_bytes(docs))
    assert repeated_bytes.remove_repeats(empty).count() == 0


def test_repeated_bytes_of_repeated_ids(spark):
    """Texts under one id keep their own spans; a row without an id meets them."""
    rnd = random.Random(8)
    a, b, c, p, q, x = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (300, 250, 200, 300, 450, 120))
    docs = [(1, a + p), (1, b + q + c), (2, x + p + x), (4, c[:50] + q), (None, a[:220]), (None, x), (1, a + p)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.remove_repeats(df).collect()), key=str)
    assert got == sorted(((i, *row) for (i, _), row in zip(docs, brute.removed_bytes(docs), strict=True)), key=str)


def test_letters_decide_whether_a_language_is_sought():
    assert not any(map(language_id.has_letter, ("", "²½ 12 ٣", "__ ¼!"))) and all(map(language_id.has_letter, ("a", "²é", "日")))


def test_chunk_keys_keep_the_pigeonhole_promise():
    rng = np.random.default_rng(3)
    for radius in (0, 1, 2):
        a = rng.integers(0, 1 << 16, (50, near_dedup.SYMBOLS), dtype=np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(near_dedup.SYMBOLS, 9 + 10 * (radius > 0), replace=False)] += 1
        x, y = (near_dedup.chunk_keys(s, 9 + 10 * (radius > 0), radius) for s in (a, b))
        assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))
        assert not set(x[0].tolist()) & set(x[1].tolist())


def test_near_duplicates(spark, table):
    want = brute.near_components(table)
    for r in QUERIES["op7_minhash_near_dedup"](spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_in_chains_and_buckets(spark):
    """A hot group whose members are linked only through each other."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 90):
        base[rnd.randrange(len(base))] = f"n{i}"
        docs.append((i, " ".join(base)))
    docs += [(200 + i, " ".join(f"{k}x{i}" for k in range(50)) + " the same last line of all") for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_components(docs)


def test_near_duplicates_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = brute.near_components(docs)
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def check_packing(rows, docs, tokenizer):
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids[i]) and (len(pieces) == 1) == (len(ids[i]) <= packing.CAPACITY)
        assert all(r.length == packing.CAPACITY for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[i][r.start:r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert set(by_doc) == set(ids)
    return len(by_sequence), sum(map(len, ids.values()))


def whole_tokenizer():
    """The file as it is: added tokens in a text are those tokens."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


def test_packing(spark, table):
    used, total = check_packing(QUERIES["op8_best_fit_packing"](spark, SF).collect(), table, whole_tokenizer())
    assert used <= 1.02 * total / packing.CAPACITY + 1


def test_packing_odd_rows(spark, odd, empty):
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(packing.pack(rows, BPE).collect(), [(r.doc_id, r.text) for r in rows.collect()], whole_tokenizer())
    twice = packing.pack(odd, BPE)
    assert twice.where("doc_id = 9").count() == 2 and twice.where("doc_id IS NULL").count() == 2
    assert packing.pack(empty, BPE).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_byte_bpe_equals_the_tokenizer(special):
    rnd, bpe, whole = random.Random(9), ByteBpe(BPE, special), whole_tokenizer()
    whole.encode_special_tokens = not special
    texts = ["".join(rnd.choice("ab \n\t.,'s1é\U0001D4B3 \x1c\x85|<!?’") for _ in range(rnd.randrange(25))) for _ in range(3000)]
    texts += ["".join(chr(rnd.randrange(0x20, 0x250)) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["don't  we'll\n\n x", "<|endoftext|>", "a <|endoftext|> b", " a", "a ", "\na", "a\n", "été, über: Straße!", ""]
    assert [bpe.encode(t) for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.encode("a <|endoftext|> b") == ([64, 220, 50256, 275] if special else whole.encode("a <|endoftext|> b").ids)


def test_fullest_equals_subset_sums():
    rnd = random.Random(6)
    for _ in range(300):
        left = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))}
        room = rnd.randrange(40)
        sums = {0}
        for x, n in left.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        use = packing.fullest(left, room)
        assert all(n <= left[x] for x, n in use.items())
        assert sum(x * n for x, n in use.items()) == max(s for s in sums if s <= room)


def test_combinations_place_every_piece_in_bounded_steps():
    rnd = random.Random(8)
    numbers = {n: rnd.randrange(10**9) for n in range(1, 2049)}
    found = packing.combinations(numbers)
    used = Counter()
    for times, use in found:
        assert sum(x * n for x, n in use.items()) <= packing.CAPACITY
        for x, n in use.items():
            used[x] += n * times
    assert used == Counter(numbers) and len(found) <= 3 * len(numbers)
    total = sum(x * n for x, n in numbers.items())
    halves = sum(n for x, n in numbers.items() if 2 * x > packing.CAPACITY)  # no two of these fit together
    assert sum(t for t, _ in found) <= 1.01 * max(total / packing.CAPACITY, halves)


def test_language_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    p = np.vstack([np.random.default_rng(1).random((len(pieces), 2)), [[1e-3, 1e-3]]])
    lattice = language_id.Lattice(pieces)

    def total(word):
        if not word:
            return np.ones(2)
        out = p[-1] * total(word[1:]) if word[0] not in pieces else 0
        return out + sum(p[i] * total(word[len(x):]) for i, x in enumerate(pieces) if word.startswith(x))

    words = ["▁ababa", "▁abca", "▁aab", "▁", "b"]
    assert np.allclose(lattice.word_scores(words, p), np.log([total(w) for w in words]))
    weights = np.array([[1.0, 2.0]] * len(words))
    step = 1e-6
    for i in range(len(pieces)):  # expected uses are the derivative by log p
        up = p.copy()
        up[i] *= 1 + step
        change = (lattice.word_scores(words, up) - lattice.word_scores(words, p)) / step
        assert np.allclose(lattice.expected(words, weights, p)[i], (change * weights).sum(axis=0), rtol=1e-3, atol=1e-4)


def test_language_words_are_whole_and_pieces_of_any_length():
    pieces = ["a", "b", "ab", "▁", "abababababab"]
    p = np.vstack([np.random.default_rng(2).random((len(pieces), 2)) * 1e-3, [[1e-7, 1e-7]]])
    lattice = language_id.Lattice(pieces)

    def log_total(word):  # backward over suffixes, in log space
        log = [np.zeros(2)]
        for k in range(len(word) - 1, -1, -1):
            terms = [np.log(p[i]) + log[len(word) - k - len(x)] for i, x in enumerate(pieces) if word.startswith(x, k)]
            log.append(np.logaddexp.reduce(terms or [np.log(p[-1]) + log[-1]], axis=0))
        return log[-1]

    words = ["▁" + "ab" * 1500 + "c", "▁" + "c" * 900, "▁" + "b" * 60, "▁" + "abababababab" * 3, "▁abababababab", "▁ab"]
    assert [language_id.marked_words(w[1:].upper()) for w in words] == [[w] for w in words]
    assert np.allclose(lattice.word_scores(words, p), [log_total(w) for w in words], rtol=1e-12)
    weights = np.array([[1.0, 2.0]] * len(words))
    uses = lattice.expected(words, weights, p)
    size = np.array([*map(len, pieces), 1])
    assert np.allclose(size @ uses, sum(map(len, words)) * weights[0])  # every character is used once
    assert "▁messages" in language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    blocks = [[len(words[i]) for i in b] for b in language_id._blocks(words)]
    assert sum(blocks, []) == sorted(map(len, words), reverse=True) and all(min(b) > 32 or max(b) <= 32 for b in blocks)


def test_language_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = op10(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = language_id.identify(odd, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und" and r.score == 0) == (r.doc_id in (1, 2, 3, 12) or
                                                           (r.doc_id is None and r.score == 0))
    assert language_id.identify(empty, path).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled, path).collect()} == {"und"}
