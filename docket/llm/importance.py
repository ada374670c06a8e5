"""Quality by importance resampling: hashed n-gram models of good and of all text, their ratio, and a Gumbel top-k draw."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import hash_words, ngram_hashes, over_partition, over_texts, plain, table, word_hashes
from docket.session import stored

BUCKETS = 10_000
# Labelled good rows that the target model is fitted on, at most; the smallest hashes of their ids are taken.
TARGET_ROWS = 20_000
SEED = 42
TOKEN = re.compile(r"\w+|[^\w\s]+")


def bucketed(texts: list[str], cache: dict, buckets: int):
    """(buckets of all words and word pairs of the texts side by side, how many each text has)."""
    import numpy as np

    parts, sizes = [], []
    for text in texts:
        words = hash_words(TOKEN.findall(text.lower()), cache)
        pairs = ngram_hashes(words, 2)
        parts += [words, pairs]
        sizes.append(len(words) + len(pairs))
    return (np.concatenate(parts) % np.uint64(buckets)).astype(np.int64), sizes


def bucket_counts(texts: DataFrame, buckets: int) -> list[int]:
    """Occurrences per bucket over all rows: one vector per task, summed; ``buckets`` rows come to the driver."""

    def make():
        import numpy as np

        cache, total = word_hashes(), np.zeros(buckets, np.int64)

        def step(batch: dict) -> None:
            for at in range(0, len(batch["text"]), 256):
                total[:] += np.bincount(bucketed(batch["text"][at : at + 256], cache, buckets)[0], minlength=buckets)

        def finish() -> dict:
            seen = np.nonzero(total)[0]
            return {"bucket": seen.tolist(), "n": total[seen].tolist()}

        return step, finish

    out = [0] * buckets
    counted = over_partition(texts.select("text"), make, "bucket int, n long")
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratio(target: list[int], raw: list[int]) -> list[float]:
    """Log ratio of the two smoothed models per bucket."""
    t, r = sum(target) + len(target), sum(raw) + len(raw)
    return [math.log((a + 1) / t) - math.log((b + 1) / r) for a, b in zip(target, raw)]


def weights(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """(doc_id, log_weight, n_features): the summed log ratio of each whole text."""
    buckets = len(ratio)
    model = docs.sparkSession.sparkContext.broadcast(ratio)  # ``buckets`` numbers

    def make():
        import numpy as np

        cache, values = word_hashes(), np.array(model.value)

        def work(batch: dict) -> dict:
            sums, counts = [], []
            for at in range(0, len(batch["text"]), 256):
                found, sizes = bucketed(batch["text"][at : at + 256], cache, buckets)
                ends = np.concatenate([[0.0], np.cumsum(values[found])])
                upto = np.cumsum(sizes)
                # Rounded, so that it does not depend on which texts share a batch.
                sums += np.round(ends[upto] - ends[upto - np.array(sizes)], 6).tolist()
                counts += sizes
            return {"doc_id": batch["doc_id"], "log_weight": sums, "n_features": counts}

        return work

    return over_texts(plain(docs), make, "doc_id long, log_weight double, n_features long")


def top_bound(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column: sixteen bits at a time, counts of at most 65,536 prefixes each come to the
    driver, so neither a sort nor a task over all rows is needed."""
    fixed, seen = 0, 0
    for shift in (48, 32, 16, 0):
        if shift == 48:
            within, part = rows, F.shiftright(column, 48)
        else:
            within = rows.filter(F.shiftright(column, shift + 16) == fixed)
            part = F.shiftright(column, shift).bitwiseAND(0xFFFF)
        counts = sorted(within.groupBy(part.alias("part")).count().collect(), reverse=True)
        for value, n in counts:
            if seen + n >= k:
                fixed = value if shift == 48 else (fixed << 16) | value
                break
            seen += n
    return fixed


def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_weight, n_features, key, kept), one row per row of ``docs``; ``target`` holds good texts.

    ``key`` is the log weight plus Gumbel noise made from the id and ``seed``; the rows with the ``share`` of largest keys,
    rounded up, are kept, which draws them without replacement with chances in proportion to their weights. Rows with equal keys at the bound
    are all kept. Null text is empty and weighs nothing (log weight 0). Null ids share one noise value, and so do repeated
    rows. Other columns are ignored; an empty table gives no rows, and without good texts all weights are those of unseen words."""
    raw = bucket_counts(plain(docs), buckets)
    good = bucket_counts(plain(target), buckets)
    scored = weights(docs, log_ratio(good, raw))
    unit = (F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("key", F.round(F.col("log_weight") - F.log(-F.log(unit)), 6))
    keyed = stored(keyed.withColumn("__order", F.round(F.col("key") * 1e6).cast("long")))
    n = keyed.count()
    if not n:
        return keyed.select("doc_id", "log_weight", "n_features", "key", F.lit(True).alias("kept"))
    bound = top_bound(keyed, "__order", max(1, math.ceil(n * share)))
    return keyed.select("doc_id", "log_weight", "n_features", "key", (F.col("__order") >= bound).alias("kept"))


def good_rows(docs: DataFrame, labels: DataFrame, limit: int = TARGET_ROWS) -> DataFrame:
    """Texts of at most ``limit`` rows labelled good; their ids are broadcast."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return plain(docs).join(F.broadcast(ids), "doc_id", "left_semi")


def good_share(labels: DataFrame) -> float:
    """Part of the labelled rows that are good; all where none is labelled."""
    return labels.filter("quality IS NOT NULL").agg(F.avg(F.col("quality").cast("double"))).first()[0] or 1.0


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the good ones, as large a share of them drawn as the labels call good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resample(docs, good_rows(docs, labels), good_share(labels))
