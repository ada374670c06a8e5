"""License notices by diagonal voting: word k-grams of texts meet template positions, equal offsets vote together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.llm.common import KEY, plain, row_key, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3  # words of a k-gram; templates of two words vote with pairs
SLACK = 3  # diagonals this close are one span: up to so many words inserted or left out in between
COVER = 0.75  # part of a template's k-grams that a span must show

# Fixed phrases: each place where the words stand side by side counts.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Notices that may be edited.
NOTICES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, in order."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_grams(templates: Mapping[str, str], base: bool) -> list[tuple]:
    rows = []
    for label, phrase in templates.items():
        w = phrase.split()
        k = min(GRAM, len(w))
        grams = len(w) - k + 1
        if k < 2 or grams > 62:
            raise ValueError(f"a template has 2 to {61 + GRAM} words: {label}")
        rows += [(label, base, k, len(w), grams, at, *w[at : at + k], *[None] * (GRAM - k)) for at in range(grams)]
    return rows


def spans(docs: DataFrame, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """One row per document row and span, and one per document row with null label that carries ``n_words`` and ``copies``
    (how often the row is repeated).

    All rolling k-grams meet the template positions in a broadcast join (the templates are constants of this call, at most 64
    words each). Only what matched is shuffled, keyed by document, so a template met in most documents has no hot key; votes
    of a diagonal are summed before the shuffle as one bit per template position."""
    spark = docs.sparkSession
    rows = template_grams(phrases, True) + template_grams(notices, False)
    shape = "label string, base boolean, k int, len int, grams int, at int, t0 string, t1 string, t2 string"
    hashed = F.when(F.col("k") == 2, F.xxhash64("t0", "t1")).otherwise(F.xxhash64("t0", "t1", "t2"))
    templates = spark.createDataFrame(rows, shape).withColumn("hash", hashed)
    pairs = [r[6:8] for r in rows if r[2] == 2]

    worded = plain(docs).select(*row_key(), words_of(F.col("text")).alias("w"))
    moved = [F.slice("w", F.lit(i + 1), F.greatest(F.size("w"), F.lit(1))) for i in range(GRAM)]
    zipped = F.arrays_zip(*[m.alias(f"w{i}") for i, m in enumerate(moved)])
    end = F.array(F.struct(*[F.lit(None).cast("string").alias(f"w{i}") for i in range(GRAM)]))
    # The row after the last word carries the number of words.
    grams = worded.select(*KEY, F.posexplode(F.concat(zipped.cast(f"array<struct<{', '.join(f'w{i}:string' for i in range(GRAM))}>>"), end)))
    grams = grams.select(*KEY, "pos", "col.*")
    long_hash = F.xxhash64("w0", "w1", "w2")
    is_pair = F.lit(False)
    for a, b in pairs:
        is_pair = is_pair | ((F.col("w0") == a) & (F.col("w1") == b))
    keys = F.when(is_pair, F.array(long_hash, F.xxhash64("w0", "w1"))).otherwise(F.array(long_hash))
    grams = grams.withColumn("hash", F.explode(keys)) if pairs else grams.withColumn("hash", long_hash)
    same = (
        (grams.hash == templates.hash)
        & (F.col("w0") == F.col("t0"))
        & (F.col("w1") == F.col("t1"))
        & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")))
    )
    hits = grams.join(F.broadcast(templates), same, "left").filter("label IS NOT NULL OR w0 IS NULL")
    votes = hits.groupBy(*KEY, "label", "base", "len", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"),
        F.max("pos").alias("n_words"),
        F.count(F.lit(1)).alias("copies"),
    )
    # Phrases count place by place; the diagonals of a notice merge while they are near each other.
    along = Window.partitionBy(*KEY, "label").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK)
    grouped = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(along))
    merged = grouped.groupBy(*KEY, "label", "base", "len", "grams", "span").agg(
        F.bit_or("seen").alias("seen"),
        F.min("diagonal").cast("long").alias("first"),
        F.max("n_words").cast("long").alias("n_words"),
        F.max("copies").alias("copies"),
    )
    return merged.withColumn("cover", F.bit_count("seen") / F.col("grams"))


def license_scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, cover: float = COVER
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the smallest and largest word number of
    a place (null without one). ``labels`` adds the notices of which a span shows at least ``cover``. ``score`` is the largest
    part of any template shown by one span. Null text is empty: no words, no labels, score 0. Repeated rows and null ids give a
    row each; other columns are ignored; an empty table gives no rows."""
    found = spans(docs, phrases, notices)
    place = F.col("base") & (F.col("cover") == 1)
    label = F.col("label")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    nothing = label.isNull()
    out = found.groupBy(*KEY).agg(
        F.max(F.when(nothing, F.col("n_words"))).alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("first"))).alias("first_word"),
        F.max(F.when(place, F.col("first"))).alias("last_word"),
        listed(F.when(place, label)).alias("base_labels"),
        listed(F.when(place | (~F.col("base") & (F.col("cover") >= cover)), label)).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.max(F.when(nothing, F.col("copies"))).cast("int").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("h1", "h2", "copies", "copy")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, whole texts."""
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = template_grams(PHRASES, True) + template_grams(NOTICES, False)
    value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    values = ", ".join(f"({', '.join(map(value, r))})" for r in rows)
    return f"""
WITH templates(label, base, k, len, grams, spot, t0, t1, t2) AS (VALUES {values}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM words),
grams AS (SELECT doc_id, pos, w[pos + 1] AS w0, w[pos + 2] AS w1, w[pos + 3] AS w2 FROM places),
votes AS (SELECT DISTINCT doc_id, label, base, grams, pos - spot AS diagonal, spot FROM grams
          JOIN templates ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR w2 = t2)),
spans AS (SELECT *, sum(CASE WHEN base OR diagonal - before > {SLACK} THEN 1 ELSE 0 END) OVER s AS span
          FROM (SELECT *, lag(diagonal) OVER s AS before FROM (SELECT DISTINCT doc_id, label, base, grams, diagonal FROM votes)
                WINDOW s AS (PARTITION BY doc_id, label ORDER BY diagonal))
          WINDOW s AS (PARTITION BY doc_id, label ORDER BY diagonal)),
merged AS (SELECT doc_id, label, base, span, min(diagonal) AS first, count(DISTINCT spot) / max(grams) AS cover
           FROM spans JOIN votes USING (doc_id, label, base, grams, diagonal) GROUP BY ALL),
found AS (SELECT doc_id,
    count(*) FILTER (base AND cover = 1) AS n_base,
    min(first) FILTER (base AND cover = 1) AS first_word, max(first) FILTER (base AND cover = 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND cover = 1) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND cover = 1) OR (NOT base AND cover >= {COVER})) AS labels,
    max(cover) AS score FROM merged GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM words LEFT JOIN found USING (doc_id)"""


CHECKS = {"op10_license_scan": _sql()}
