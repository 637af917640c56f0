"""Clashing names, empty tables, repeated rows and rules that once lost rows or links."""

from __future__ import annotations

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import common, langid_ecoc, quality_llr, superminhash, warc_index
from tidepanel.llm.common import ready


def prose(rng, n, stems="abcdefgh"):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(2, 6))) for _ in range(n))


def test_stages_keep_the_columns_of_their_input(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), "en" if i % 2 else "fr", f"s{i % 2}") for i in range(40)] + [(50, "password=abcdefgh123 " + prose(rng, 60), "en", "s0"), (50, "password=abcdefgh123 " + prose(rng, 60), "en", "s0"), (None, None, None, None)]
    clash = {n: F.lit(f"of {n}") for n in ("spans", "_kept", "id", "row", "ids", "key", "blob", "carried", "ambiguous", "_doc", "parts", "c0")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        found = got.collect()
        assert found and all(r[n] == f"of {n}" for r in found for n in clash), name
    assert corpus_pipeline.tokens(spark, docs, "").count() == docs.count()
    second = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted(r.doc_id for r in second if r.doc_id is not None) == [*range(40), 50, 50] and sum(r.doc_id is None for r in second) == 1
    assert all("abcdefgh123" not in (r.text or "") for r in corpus_pipeline.secrets(spark, docs, "").collect())
    counted = docs.select("doc_id", "text", "lang", "source", F.lit(7).alias("n_chars"))
    third = corpus_pipeline.secrets(spark, counted, "")
    assert third.schema["n_chars"].dataType.simpleString() == "int"
    assert {r.n_chars == (len(r.text) if "[secret]" in (r.text or "") else 7) for r in third.collect()} == {True}


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, "")
        assert got.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == none.columns


def test_no_shared_folder_is_made_up_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Cluster())


def test_the_quality_threshold_keeps_held_out_trusted_documents(spark):
    """Precision and recall on documents that neither the target nor the threshold was made of."""
    ready(spark)
    rng = random.Random(3)
    rows = [(i, prose(rng, 90) if i % 4 else prose(rng, 90, "mnopqrst").upper() + " $$") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    got = [(r.doc_id % 4 > 0, r.kept) for r in quality_llr.quality(docs, labels).collect() if r.doc_id >= 300]
    kept = [good for good, k in got if k]
    assert sum(kept) / len(kept) >= 0.99 and sum(kept) / sum(good for good, _ in got) >= 0.9


def test_a_repeated_row_is_learned_from_once(spark):
    ready(spark)
    rng = random.Random(6)
    rows = [(i, prose(rng, 30, "abcd" if i % 2 else "wxyz"), "aa" if i % 2 else "bb") for i in range(60)]
    df = spark.createDataFrame(rows + [rows[4]] * 3000 + [(8, rows[8][1] + f" x{k}", "bb") for k in range(50)], "doc_id long, text string, lang string")
    learning = {(r.doc_id, r.text) for r in df.where(langid_ecoc.crc_fold(F.col("doc_id"), 4) != 2).collect()}
    got = []
    model = langid_ecoc.Model

    class Counted(model):
        def __init__(self, languages, x, y):
            got.append(len(x))
            super().__init__(languages, x, y)

    langid_ecoc.Model = Counted
    try:
        langid_ecoc.fit(df)
    finally:
        langid_ecoc.Model = model
    assert got == [len(learning)]


def test_collisions_of_short_elements_lose_no_link():
    """Two sets that are linked with each other, of which 32-bit distances put one within reach of the hub, as collisions can."""
    first = np.arange(1000, dtype=np.uint32)
    second = np.arange(60, 1060, dtype=np.uint32)
    m = superminhash.ROWS * superminhash.BANDS
    values = superminhash.signatures([first.astype(np.uint64), second.astype(np.uint64)], m)
    keys = superminhash.band_keys(values, superminhash.ROWS).view(np.int64)
    columns = {
        "key": [1, 1], "kind": [0, 0], "i": [0, 0], "j": [0, 0], "side": [0, 0], "id": [5, 6], "comp": [5, 6], "far": [0.248, 0.249], "band": [0, 0],
        "bands": [list(map(int, k)) for k in keys], "elements": [first.tobytes(), second.tobytes()],
    }
    for far in ([0.248, 0.249], [0.0, 0.2515]):
        batch = pa.RecordBatch.from_pydict(columns | {"far": far})
        found = [r for b in superminhash._within([batch], 0.75, m) for r in b.to_pylist()]
        assert found == [{"a": 5, "b": 6}]


@pytest.mark.parametrize("elements", [300, 1 << 21])
def test_blocks_are_bounded_by_their_elements(spark, elements):
    """Chains of changed copies, whose first and last are no link: smaller blocks find the same groups."""
    ready(spark)
    rng = random.Random(8)
    rows = []
    for c in range(6):
        w = prose(rng, 120).split()
        for k in range(25):
            rows.append((c * 100 + k, " ".join(w)))
            w[(k * 5) % 120] = f"n{c}x{k}"
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), elements=elements).collect()
    assert {r.component_id for r in got} == {c * 100 for c in range(6)} and all(r.component_id == r.doc_id // 100 * 100 for r in got)


def test_archives_are_read_by_offset_and_merged_in_ranges(spark, tmp_path):
    ready(spark)
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 7}.com/{rng.randrange(40)}", f"<p>{prose(rng, rng.randrange(300))} é {i % 5}</p>") for i in range(300)] + [(None, None, None), (3, "http://h.com/x y", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    warc_index.write_archives(pages, path, archive_bytes=20_000)
    runs = common.materialize(warc_index.read_archives(spark, path))
    merged = warc_index.merge_index(runs, 50)
    assert merged.rdd.getNumPartitions() == 7
    got = merged.collect()
    key = [(r.urlkey, r.stamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert key == sorted(key) and len(got) == len(rows)
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").iterdir() if f.name.startswith("part") and f.stat().st_size}
    assert len(files) > 5 and sorted({r.file for r in got}) == sorted(files)
    for r in got:
        record = gzip.decompress(files[r.file][r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:x-tidepanel:page:{'none' if r.page_id is None else r.page_id}>".encode() in record
        if r.record_type == "response":
            assert hashlib.sha1(record[:-4].split(b"\r\n\r\n", 2)[2]).hexdigest() == r.payload_digest
    for data in files.values():  # archives are gzip files as a whole, too, closed at the record that reaches the bound
        assert gzip.decompress(data).endswith(b"\r\n\r\n")
        last = max((r for r in got if files[r.file] == data), key=lambda r: r.offset)
        assert last.offset < 20_000 and last.offset + last.length == len(data)


def test_a_very_long_record_is_several_members(monkeypatch):
    monkeypatch.setattr(warc_index, "MEMBER_BYTES", 1000)
    body = random.Random(1).randbytes(5000)
    record = lambda n, b: f"WARC/1.1\r\nWARC-Record-ID: <{n}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b
    packed = [warc_index._members(record(n, b)) for n, b in ((1, b"x"), (2, body), (3, b""))]
    found = list(warc_index.parse_archive(b"".join(packed)))
    assert [f[3] for f in found] == [b"x", body, b""] and [f[1] for f in found] == [len(p) for p in packed]
    assert all(p.endswith(b"\0") for p in packed)
    with pytest.raises(ValueError, match="no end"):
        list(warc_index.parse_archive(b"".join(packed)[:-10]))
