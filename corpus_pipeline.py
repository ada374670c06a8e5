"""A training corpus from raw documents: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the last
return the columns of documents, whatever they are; empty tables stay empty. ``run`` writes each result to the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docket.llm import block_dedup, decontaminate, jaccard_join, sentencepiece_codec, toxicity
from docket.llm.common import table
from docket.llm.token_counts import model_bytes
from docket.session import stored

# Learnt scores, similarity of sets and alignments are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; null and empty texts by the prior, repeated rows alike."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the one with the largest id; a null id only where there is no other."""
    return block_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by similar word shingles one; texts without words have no links and stay."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts, and null and empty items, hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, n_tokens, ids, agrees, restored); null and empty texts have none."""
    return sentencepiece_codec.encode(docs, model_bytes())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
