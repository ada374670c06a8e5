"""The pipeline's stages on odd rows, empty tables and clashing names, and workers that meet an empty text first."""

import sys

import pytest

import corpus_pipeline
from docket.llm import common, toxicity
from docket.llm.common import Words, in_parts, over_partition, over_texts, worker_cache

from .helpers import documents, odd_rows, prose


def folder(spark, tmp_path, docs, items, marks):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, words string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def through(spark, sf_dir):
    """(names, rows) after each stage, the columns checked on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        left.append((name, docs.collect()))
    return left


def test_stages_on_odd_rows(spark, tmp_path):
    passage = prose(77, 60)
    near = prose(78, 200)
    rows = odd_rows() + [(30, f"{prose(79, 40)} {passage} {prose(80, 40)}"), (31, near), (32, near + " more")]
    items = [(1, "", "w", 1), (2, None, "w", 1), (None, passage, None, None), (2, passage, "w", 2), (3, "a", "w", 3)]
    marks = [(1, 1, 0, "x"), (None, 1, 1, "x"), (2, None, None, None), (2, 0, 0, "x")]
    left = dict(through(spark, folder(spark, tmp_path, documents(spark, rows), items, marks)))
    ids = {name: sorted((r.doc_id is not None, r.doc_id or 0) for r in got) for name, got in left.items()}
    assert len(left["toxicity"]) == len(rows)  # nothing is learnt from these labels
    texts = [r.text or "" for r in left["exact_dedup"]]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in rows})
    assert sum(r.doc_id in (31, 32) for r in left["jaccard_join"]) == 1
    assert 30 not in {r.doc_id for r in left["decontamination"]} and (True, 10) in ids["decontamination"]
    assert ids["sentencepiece"] == ids["decontamination"]
    assert all(r.agrees and len(r.ids) == r.n_tokens for r in left["sentencepiece"])


def test_stages_on_empty_tables(spark, tmp_path):
    left = through(spark, folder(spark, tmp_path, documents(spark, []), [], []))
    assert [got for _, got in left] == [[]] * len(corpus_pipeline.STAGES)


@pytest.mark.parametrize("texts", [[""], ["", "x"], ["", "y" * 600_000, ""]])
def test_a_worker_that_meets_an_empty_text_first(texts):
    kept = sys.modules.pop("docket_worker_cache", None)
    try:
        found = [Words(texts[a:b]) for a, b in in_parts(texts)]
        assert sum(len(w.start) for w in found) == sum(bool(t) for t in texts)
    finally:
        sys.modules.pop("docket_worker_cache", None)
        if kept:
            sys.modules["docket_worker_cache"] = kept


def test_a_worker_keeps_only_what_one_operator_needs():
    kept = sys.modules.pop("docket_worker_cache", None)
    try:
        common.word_hashes()
        worker_cache("powers", dict)
        assert set(sys.modules["docket_worker_cache"].kept) == {"word_hashes", "powers"}
        codec = worker_cache("codec", object)
        assert set(sys.modules["docket_worker_cache"].kept) == {"codec"} and worker_cache("codec", object) is codec
        worker_cache("toxicity", object)
        assert set(sys.modules["docket_worker_cache"].kept) == {"toxicity"}
    finally:
        sys.modules.pop("docket_worker_cache", None)
        if kept:
            sys.modules["docket_worker_cache"] = kept


def test_few_rows_are_python_objects_at_once(spark):
    rows, most = spark.range(5000).coalesce(1), common.ROWS
    seen = over_texts(rows, lambda: lambda part: {"id": part["id"], "n": [len(part["id"])] * len(part["id"])}, "id long, n int").collect()
    assert sorted(r.id for r in seen) == list(range(5000)) and max(r.n for r in seen) <= most

    def make():
        sizes = []
        return lambda part: sizes.append(len(part["id"])), lambda: {"n": sizes}

    each = [r.n for r in over_partition(rows, make, "n int").collect()]
    assert sum(each) == 5000 and max(each) <= most


def test_a_lexicon_counted_in_parts_is_the_same(spark, monkeypatch):
    rows = [(i, f"{prose(i, 30)} {'vile wretch' if i % 3 == 0 else 'kind friend'}") for i in range(240)]
    marks = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i, _ in rows], "doc_id long, toxic int")
    docs, costs = documents(spark, rows), [1.0] * toxicity.K**3
    whole = toxicity.lexicon(docs, marks, costs)
    monkeypatch.setattr(toxicity, "FEATURES", 50)
    assert toxicity.lexicon(docs, marks, costs) == whole and any("vile" in f for f in whole[1])
