import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, "
          "kept string, n long, score string, shard string, label string, component string, word string")


@pytest.fixture(scope="session")
def table(spark):
    """[(doc_id, text)] of the smallest documents table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows."""
    rnd = random.Random(7)
    prose = lambda n: " ".join(rnd.choice(("the", "of", "and", "river", "stone", "été", "über")) + str(rnd.randrange(400))
                               for _ in range(n))
    copy, long = prose(80), prose(30_000)
    near = copy.replace("river", "River", 1) + " more"
    return [(1, None, None, None), (2, "", "en", ""), (3, " \t\n\x0b ", "en", "a"), (4, copy, "en", "a"),
            (5, copy.replace(" ", "\n ", 1), "en", "b"), (6, near, None, None), (7, long, "fr", "a"), (8, long, "fr", "b"),
            (9, "ok", "fr", "c"), (9, "ok", "fr", "c"), (10, "\U0001D4B3é " * 40, "de", "a"), (11, "a" * 900, "de", "a"),
            (12, "12 34 !!", "en", "a"), (None, prose(60), "en", "a"), (None, None, None, None),
            (13, "x  y \n z\x1c'll <|endoftext|> " * 9, "en", "d"), (14, "one two three", "en", "a"),
            (15, "ONE two\tthree", "en", "a")]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash with inner ones."""
    rows = [(i, t, x, s, 0, 1, "k", "s", "z", 1, "q", "h", "l", "c", "w") for i, t, x, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
