"""The pipeline against plain Python over its operators' own small parts."""

import collections

import numpy as np
import pytest

pytest.importorskip("textmill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import alnum_words, components, plain_spans  # noqa: E402
from textmill.llm import language_id, packing, phrase_index, pii  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, out, SF)
        if name == "language":
            kept = [i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")]
        elif name == "near_duplicates":
            kept = {c for _, c in components([(i, rows[i]["text"]) for i in kept]).values()}
        elif name == "benchmark":
            grams = {tuple(w[k : k + min(10, len(w))]) for w in map(alnum_words, items) if w for k in range(len(w) - min(10, len(w)) + 1)}
            sizes = {len(g) for g in grams}
            words = {i: alnum_words(rows[i]["text"]) for i in kept}
            kept = {i for i in kept if not any(tuple(words[i][k : k + n]) in grams for n in sizes for k in range(len(words[i]) - n + 1))}
        elif name == "personal_data":
            crf = pii.fit(before)
            for r in out.collect():
                assert not [s for s in plain_spans(r["text"]) if s.kind == 0] and r["n_chars"] == len(r["text"])
                if not plain_spans(rows[r["doc_id"]]["text"]):
                    [(_, added)] = pii.found([rows[r["doc_id"]]["text"]], crf)
                    assert r["text"] == pii.masked(rows[r["doc_id"]]["text"], added)
        if name != "packing":
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(kept)
    pieces = collections.Counter()
    for r in out.collect():
        pieces[r["doc_id"]] += r["length"]
    assert set(pieces) == set(kept)
    assert corpus_pipeline.run(spark, SF).columns == packing.pack(docs).columns


def test_language_keeps_ties(spark):
    """A clean word that two samples hold alike stays; only texts without a letter go."""
    rows = [(1, "banana one", "de"), (2, "banana two", "en"), (3, "banana", None), (4, "12 34", None), (6, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs).predict(["banana"])[1] == 0
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 2, 3}


def test_benchmark_keeps_clean_rows_of_an_id(spark):
    """Null and repeated ids: only the rows whose own text has a window go."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = [(None, "x " + item), (None, "clean one"), (None, None), (5, item), (5, "clean two"), (5, None), (6, "clean one")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.benchmark(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_names_that_clash(spark):
    """Columns named as the operators' own come back as they were; empty tables and rows of nulls pass."""
    text = "one two three four five six seven call +1 (884) 555-0549"
    rows = [(1, text, "en"), (2, text, "en"), (None, None, None), (3, "", "en"), (4, "other words here", "en")]
    own = ("score", "_text", "spans", "_masked", "lang_pred", "bits", "n_email", "_key", "key", "kept_id", "who", "component_id", "d", "b", "j")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(own))) for r in rows], "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} int" for c in own))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (before, before.limit(0)):
            out = stage(spark, some, SF)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all([r[c] for c in own] == list(range(len(own))) for r in got)
            if some is before:
                after = [(r["doc_id"], r["text"]) for r in got]
        before = spark.createDataFrame([r for r in stage(spark, before, SF).collect()], docs.schema)
    assert sorted(after) == [(1, "one two three four five six seven call [PHONE]"), (4, "other words here")]
    assert not corpus_pipeline.pack(spark, before, SF).isEmpty() and corpus_pipeline.pack(spark, before.limit(0), SF).isEmpty()


def test_benchmark_drops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r["doc_id"] for r in phrase_index.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert bad and {r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_benchmark_judges_in_place(spark, monkeypatch):
    """No index is stored and no row is shuffled; with several blocks of items the stored index gives the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {r["doc_id"] for r in phrase_index.decontaminate(docs, items).where("not contaminated").collect()}
    hit = phrase_index.judged(docs, items, segment_bytes=1000)  # some segments hold one text
    assert {r["doc_id"] for r in docs.where(~hit).collect()} == want
    assert phrase_index.judged(docs, items, block_bytes=200) is None and docs.where(~phrase_index.judged(docs, items.limit(0))).count() == docs.count()
    with monkeypatch.context() as m:
        m.setattr(phrase_index, "stored", None)
        out = corpus_pipeline.benchmark(spark, docs, SF)
        assert {r["doc_id"] for r in out.collect()} == want
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(phrase_index, "judged", lambda *a: None)
    assert {r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, SF).collect()} == want


class _Sized:
    """Stands for the tokenizer: an id a text, and an error if too many bytes come at once."""

    def encode(self, column, end_id):
        assert sum(len(x) for x in column.to_pylist()) <= 1 << 20
        return [(np.zeros(1, np.uint32), np.zeros(0, np.int64))] * len(column)


def test_packing_encodes_small_slices(spark, monkeypatch):
    """Of large batches a worker encodes a megabyte of text at a time."""
    monkeypatch.setattr(packing, "_tokenizer", lambda file: _Sized())
    docs = spark.range(60).selectExpr("id doc_id", "repeat('words ', 20000) text").coalesce(1)
    assert corpus_pipeline.pack(spark, docs, SF).count() == 60
