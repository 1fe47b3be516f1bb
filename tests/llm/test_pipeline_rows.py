"""Odd rows and clashing columns go through the stages of the pipeline; archives are read as streams."""

from __future__ import annotations

import gzip

import pytest

from textsluice.llm import tokencount, warc

SF = "/root/testdata/sf0.001"
#: Names that stages use inside.
CLASHES = ("score", "predicted", "_n", "_mask", "_p", "_word", "_near", "_key", "_spans", "_id", "_tag", "row", "fp", "component_id", "a.b")


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *[f"{r.doc_id}{c}" for c in CLASHES]) for r in base]
    rows += [rows[0], (None, rows[1][1], None, None, None, *[None] * len(CLASHES)), (9001, None, "en", "s", None, *["x"] * len(CLASHES)),
             (9002, "", "en", "s", 0, *["x"] * len(CLASHES)), (None, None, None, None, None, *[None] * len(CLASHES))]
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def test_own_columns_survive(spark, odd):
    import corpus_pipeline

    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == odd.columns, name
        rows = docs.collect()
        assert 0 < len(rows) <= before.count(), name
        for r in rows:
            assert r.doc_id is None or r.doc_id > 9000 or [r[c] for c in CLASHES] == [f"{r.doc_id}{c}" for c in CLASHES], name
            assert r.n_chars is None or r.n_chars == len(r.text), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_empty_table_goes_through(spark, odd):
    import corpus_pipeline

    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_records_over_piece_ends(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    blocks = [b"", b"x", b"WARC/1.0\r\n\r\n" * 3, bytes(range(256)) * 9]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    half = data.index(b"WARC/1.0", 60)
    for stored in (data, gzip.compress(data), gzip.compress(data[:half]) + gzip.compress(data[half:])):
        assert [b for _, b in warc.records_in(stored)] == blocks
    assert [b for _, b in warc.records_in(gzip.compress(data)[:-9])][:2] == blocks[:2] and list(warc.records_in(b"")) == []


def test_most_used_is_bounded_and_whole_steps(spark):
    counts = spark.createDataFrame([(f"p{i}", 1000 // (i + 1) + 1, 1) for i in range(200)], "piece string, uses long, n_tokens long")
    for most in (0, 1, 10, 57, 1000):
        top = {r.piece for r in tokencount._most_used(counts, most).collect()}
        least = min((1000 // (int(p[1:]) + 1) + 1 for p in top), default=10**9)
        assert len(top) <= most and (most < 1000 or len(top) == 200)
        assert top >= {f"p{i}" for i in range(200) if 1000 // (i + 1) + 1 > least * 1.1}
