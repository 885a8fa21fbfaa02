"""The corpus pipeline against plain Python, stage by stage."""
import re
from collections import Counter

import brute
import corpus_pipeline
from conftest import SF

from tenurelens.llm.queries import op1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r == rows[r.doc_id] for r in docs.collect())
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in out.items()}

    kept = {r.doc_id for r in op1(spark, SF).collect() if r.kept}
    assert sorted(ids["quality_rules"]) == sorted(kept)
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text), i)
    assert sorted(ids["exact_dedup"]) == sorted(first.values())
    near = brute.near_components([(i, rows[i].text) for i in ids["exact_dedup"]])
    assert sorted(ids["near_dedup"]) == sorted({c for _, c in near.values()})

    size = {i: len(brute.words(rows[i].text)) for i in ids["near_dedup"]}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[rows[i].source] += n
    copies = Counter(ids["mixing"])
    for i, n in copies.items():
        taken[rows[i].source] += n * size[i]
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    for source, target in brute.mix_targets(sizes).items():
        largest = max(n for i, n in size.items() if rows[i].source == source)
        assert abs(taken[source] - target) <= largest / 2 + 1

    packed = Counter(r.doc_id for r in out["packing"].where("piece = 0").collect())
    assert packed == copies


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
