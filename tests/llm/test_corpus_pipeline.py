"""The pipeline's stages on a small table: what each keeps, and that its decisions take effect."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    rng = random.Random(9)
    text = lambda stems, n=80: " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    rows = [(i, text("abcdefg" if i % 2 else "mnopqrs"), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[4][1], "fr", "s1", 1), (101, rows[4][1].upper(), "fr", "s2", 1), (102, "12 34", None, "s0", 5), (103, None, None, None, None), (104, rows[7][1] + " password=hunter2hunter2 " + text("abcdefg", 60), "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        found[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    first, second, third, fourth, last = found.values()
    kept = {r.doc_id for r in first.collect()}
    assert kept == {*range(60), 100, 101, 104}
    assert {r.doc_id for r in second.collect()} == {*range(60), 104}
    clean = {r.doc_id: r for r in third.collect()}
    assert len(clean) == 61 and "hunter2" not in clean[104].text and clean[104].n_chars == len(clean[104].text)
    assert clean[3].text == rows[3][1]
    assert fourth.count() >= 61 and all(r.text for r in fourth.collect())
    assert last.count() == fourth.count() and all(r.n_tokens > 0 for r in last.collect())
