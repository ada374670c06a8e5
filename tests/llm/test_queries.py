"""The queries and the pipeline over a small folder, against SQL or brute force."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docket.llm.queries import CHECKS
from oracles.compare import connect, difference

from .test_exact_and_near import brute_near

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF), entry.queries()[name], CHECKS[name], SF) == ""


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_near_query_equals_brute_force(spark, documents):
    got = entry.queries()["op2_jaccard_join"](spark, SF).collect()
    from collections import Counter

    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in got) == brute_near(documents)


def test_benchmark_query_finds_exact_copies(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    held = {(i, b.item_id) for i, t in documents for b in items if b.text in t}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op3_decontaminate"](spark, SF).collect()}
    assert held and held <= got


def test_token_queries(spark, documents):
    import sentencepiece

    from docket.llm.token_counts import model_bytes

    original = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    ids = {i: original.encode(t or "") for i, t in documents}
    counts = entry.queries()["op9_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {i: len(x) for i, x in ids.items()}
    import numpy as np

    digest = {i: hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for i, x in ids.items()}
    assert {r.doc_id: r.ids_sha256 for r in entry.queries()["op7_sentencepiece"](spark, SF).collect()} == digest


def test_pipeline_takes_effect(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    texts = dict(documents)
    assert len(kept) == len(out) < len(documents)
    assert len({texts[i] for i in kept}) == len(kept)
    items = [b.text for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in texts[i] for i in kept for b in items)
    assert all(r.restored and r.agrees and len(r.ids) == r.n_tokens for r in out)
    assert max(n for (_, _, n, _) in brute_near([(i, texts[i]) for i in kept])) == 0
