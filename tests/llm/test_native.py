"""Operators 1, 2, 6 and 9 against plain Python."""
import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tenurelens.llm import exact_dedup, mixing, quality, secrets
from tenurelens.llm.queries import QUERIES, op1, op6


def labels(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def base_of(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)


def test_quality_base_counts(spark, table):
    texts = dict(table)
    rows = op1(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base_of(r) == brute.quality_base(texts[r.doc_id]), r.doc_id


def test_quality_repeats_are_exact(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(40))) for _ in range(300)]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                         labels(spark, [])).collect()
    for r in rows:
        assert base_of(r) == brute.quality_base(texts[r.doc_id])
        assert r.score == 0 and r.kept == (not r.base_failed)  # no trusted label


def test_quality_separates_labels(spark):
    found = {r.doc_id: r for r in op1(spark, "/root/testdata/sf0.01").collect()}
    seen = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect():
        x = found[r.doc_id]
        if not x.base_failed:
            seen[r.quality, x.kept] += 1
    assert seen[1, False] == 0 and seen[0, False] > 10 * seen[0, True]


def test_quality_tells_shuffled_text_from_its_original(spark):
    rnd = random.Random(4)
    words = [f"w{i}{string.ascii_lowercase[i % 26] * 3}" for i in range(30)]
    after = {w: rnd.sample(words, 3) for w in words}

    def prose():
        text = [rnd.choice(words)]
        while len(text) < 100:
            text.append(rnd.choice(after[text[-1]]))
        return text

    shuffled = lambda text: " ".join(rnd.sample(text, len(text)))
    rows = [(i, " ".join(prose())) for i in range(50)] + [(i, shuffled(prose())) for i in range(50, 250)]
    for i in range(300, 320):
        text = prose()
        rows += [(i, " ".join(text)), (i + 100, shuffled(text))]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"),
                                                labels(spark, range(50))).collect()}
    for i in range(300, 320):
        assert found[i].kept and not found[i + 100].base_failed and not found[i + 100].kept


def test_quality_odd_rows(spark, odd, empty):
    rows = quality.judge(odd, labels(spark, [4, 7])).collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted(map(base_of, rows)) == sorted(brute.quality_base(r.text) for r in texts)
    assert quality.judge(empty, labels(spark, [])).count() == 0
    kept = quality.drop_rejected(odd, labels(spark, [4, 7]))
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.kept for r in rows)


def spans_of(found, kinds=3):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found if k < kinds)


def test_secret_base_spans(spark, table, odd, empty):
    tricky = [(10**6 + i, t) for i, t in enumerate([
        "é\U0001D4B3 Passwd:  'abc' API_KEY = \"abcdefgh12\" token=secret:abcdefghij AKIAxx AKIA0123456789AB",
        "secret\" : 'aaaaaaaa.=-' passwordpassword=12345678", "ſecret=abcdefghij toKen=abcdefghij",
        "a" * 31, "a" * 32, "f" * 40 + "g" + "0" * 32, "AKIA" + "A" * 11, "AKIAAKIA" + "Z" * 30, "token=\"x\" token=12345678"])]
    docs = spark.createDataFrame(table + tricky, "doc_id long, text string")
    texts = dict(table + tricky)
    for r in secrets.scan_secrets(docs).collect():
        want = brute.secret_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(spans_of(want).encode()).hexdigest(), texts[r.doc_id]
        assert [x for x in r.spans.split(",") if not x.startswith("random")] == spans_of(want).split(",")
    assert secrets.scan_secrets(odd).count() == odd.count()
    assert secrets.scan_secrets(empty).count() == 0


def test_secret_battery_finds_random_keys(spark):
    rnd = random.Random(5)
    keys = string.ascii_letters + string.digits
    plain = ["chapter-12-of-the-long-name-with-words", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "9807915762804490",
             "the-house-of-the-rising-sun-in-new-orleans-1964-and-after", "010101010101010101010101010a"]
    rows = [(i, f"see {''.join(rnd.choice(keys) for _ in range(40))}7x and {plain[i % len(plain)]} here")
            for i in range(200)]
    texts, hits, wrong = dict(rows), 0, 0
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for kind, a, b in (x.split(":") for x in r.spans.split(",") if x):
            assert kind == "random"
            hits += int(a) == 4
            wrong += texts[r.doc_id][int(a):int(b)] in plain
    assert hits >= 190 and wrong == 0


def test_secret_battery_on_a_very_long_run(spark):
    """One run of a million symbols costs time in proportion to its length."""
    rnd = random.Random(6)
    keys = string.ascii_letters + string.digits + "+/"
    long = "".join(rnd.choices(keys, k=1_000_000))
    rows = [(1, "data: " + long), (2, "aB1" * 300_000)]
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: f"random:6:{6 + len(long)}", 2: ""}


def test_exact_dedup_groups(spark, table):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in table}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for r in op6(spark, SF).collect():
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_dedup_odd_rows(spark, odd, empty):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].keep_id == by_id[2].keep_id == 1 and by_id[1].group_size == 3  # null, empty and a null id
    assert by_id[5].keep_id == 4 and by_id[8].keep_id == 7 and by_id[9].group_size == 2
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert 2 not in [r.doc_id for r in kept.collect()]
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_survives_hash_collisions(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, None: 5, "d": 0},
                                   {"x": 0}, {"a": 1, "b": 1, "c": 100, "d": 7, "e": 300}])
def test_mix_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute.mix_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_takes_targets(spark, table):
    rows = QUERIES["op9_mixing"](spark, SF).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    texts, taken, target = dict(table), Counter(), {}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == len(brute.words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(empty).count() == 0
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = brute.mix_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in rows)
    taken = mixing.take_mix(odd)
    assert taken.columns == odd.columns and mixing.take_mix(empty).count() == 0
    assert max(Counter(r.doc_id for r in taken.where("doc_id != 9").collect()).values()) <= 2
