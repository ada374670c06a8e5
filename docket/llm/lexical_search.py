"""Ranked lexical search, term at a time with a limit on accumulators: the rarest terms first, no new accumulators once what
remains cannot lift one to the k-th partial score, exact updates of those that can still rank."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import Memo, over_texts, plain, table, worker_cache
from docket.operators.scan import top_per_group
from docket.session import forget, stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TOP = 20
FILTER_BITS = 24  # address of the map of known terms: 2 MB whatever the data
LONG_TEXT = 1_000_000  # characters from which a text's terms are counted as they are met
BROADCAST_ROWS = 200_000  # rows counted to be no more are broadcast; beyond, they are joined by a shuffle


def bags(texts: DataFrame, name: str, known=None) -> DataFrame:
    """(``name``, n, term, tf lists) of every row of (``name``, text): n counts all terms with repeats; ``known``, a broadcast
    map, leaves out of the lists most terms that nobody asks for."""

    memo = f"terms {uuid.uuid4().hex}"  # of this map alone

    def make():
        from collections import Counter
        from zlib import crc32

        bits = None if known is None else known.value

        def term_of(word: str):
            term = word.translate(LOWER)
            if bits is not None:
                spot = crc32(term.encode("utf-8", "surrogatepass")) & (2**FILTER_BITS - 1)
                if not bits[spot >> 3] >> (spot & 7) & 1:
                    return ""
            return term

        terms = worker_cache(memo, lambda: Memo(term_of))

        def work(batch: dict) -> dict:
            sizes, names, times = [], [], []
            for text in batch["text"]:
                found = TERM.findall(text) if len(text) < LONG_TEXT else (m.group() for m in TERM.finditer(text))
                count, asked = Counter(found), {}
                for word, tf in count.items():
                    term = terms[word]
                    if term:
                        asked[term] = asked.get(term, 0) + tf
                sizes.append(sum(count.values()))
                names.append(list(asked))
                times.append(list(asked.values()))
            return {name: batch[name], "n": sizes, "term": names, "tf": times}

        return work

    return over_texts(texts, make, f"{name} long, n long, term array<string>, tf array<long>")


def known_terms(terms: DataFrame):
    """A broadcast map of 2 ** FILTER_BITS bits over (term). It only spares rows a join that would drop them."""
    spot = F.crc32("term").bitwiseAND(2**FILTER_BITS - 1)
    part, at = F.floor(spot / 32768).alias("part"), (spot % 32768).alias("at")
    parts = terms.select(part, at).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = bytearray(2**FILTER_BITS // 8)
    for row in parts.toLocalIterator():  # at most 512 rows of 4 KB
        bits[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    return terms.sparkSession.sparkContext.broadcast(bytes(bits))


def spread(bag: DataFrame, *keep: str) -> DataFrame:
    """One row per term of each list: (keep, term, tf)."""
    return bag.select(*keep, F.inline(F.arrays_zip("term", "tf")))


def gain(documents: int, words: int) -> Column:
    """What one occurrence-weighted term gives a document of n terms, before the term's weight."""
    m = f"(100 - 25 + (25 * n * {documents}L) div {words}L)"
    return F.expr(f"(1000000000L * tf) div (1000 * tf + 12 * {m})")


def weight(documents: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its ``k`` rows of ``docs`` with the highest
    scores above 0, equal scores by ascending doc_id (null first; rows with the same id in a fixed order).

    Null and empty texts have no terms and are never found, and as items they find nothing. Repeated rows are documents, and
    items, of their own. Other columns are not looked at. An empty table on either side gives no rows.

    Terms fall into levels by the power of 4 in their document frequency, and a level, rarest first, is a round: its postings
    give the items that still create accumulators new ones, and update, for the others, only those that exist. After a round an
    item stops creating when the bounds of all its coming terms together stay below its k-th partial score, and accumulators
    that those bounds cannot lift to that score are dropped. Levels grow with the logarithm of the corpus."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = stored(bags(asked, "item_id").withColumn("item", F.monotonically_increasing_id()))
    wanted = spread(asked, "item").withColumnRenamed("tf", "q")
    terms = wanted.select("term").distinct()
    found = stored(bags(plain(docs), "doc_id", known_terms(terms)).withColumn("row", F.monotonically_increasing_id()))
    total, words = found.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        forget(asked, found)
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    each = spread(found, "row", "n").select("row", "term", gain(total, words).alias("gain"))
    facts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("gain").alias("most")).join(terms, "term", "left_semi")
    level = F.floor(F.log2("df") / 2).cast("int").alias("level")
    facts = stored(facts.select("term", F.monotonically_increasing_id().alias("id"), level, weight(total).alias("w"), "most"))
    known = facts.count()
    postings = stored(each.join(small(facts.select("term", "id", "level"), known), "term").select("id", "row", "gain", "level"), "level")
    demand = wanted.join(facts, "term").select("item", "id", "level", (F.col("w") * F.col("q")).alias("w"), (F.col("w") * F.col("q") * F.col("most")).alias("bound"))
    demand = stored(demand)
    asks, most = demand.groupBy("item", "level").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    levels = sorted(r.level for r in demand.select("level").distinct().collect())  # at most as many as powers of 4 in the corpus

    empty = spark.createDataFrame([], "item long, row long, score long")
    scores, states, creating, survivors = empty, None, True, 0
    past: list[DataFrame] = []
    for at in levels:
        ask, post = demand.filter(F.col("level") == at).select("item", "id", "w"), postings.filter(F.col("level") == at).select("id", "row", "gain")
        add = F.col("w") * F.col("gain")
        more = []
        if creating:
            starts = ask if states is None else ask.join(states.filter("creating"), "item", "left_semi")
            more.append(post.join(small(starts, asks), "id").select("item", "row", add.alias("score")))
        if survivors:
            held = scores.join(states.filter("NOT creating").select("item"), "item", "left_semi").select("item", "row")
            pairs = held.join(small(ask, asks), "item")
            more.append(post.join(small(pairs, survivors * most), ["id", "row"]).select("item", "row", add.alias("score")))
        every = scores
        for rows in more:
            every = every.union(rows)
        summed = stored(every.groupBy("item", "row").agg(F.sum("score").alias("score")))
        kth = top_per_group(summed, ["item"], [F.desc("score")], k).filter(F.col("rank") == k).select("item", F.col("score").alias("kth"))
        rest = demand.filter(F.col("level") > at).groupBy("item").agg(F.sum("bound").alias("rest"))
        now = asked.select("item").join(kth, "item", "left").join(rest, "item", "left").select("item", "kth", F.coalesce("rest", F.lit(0)).alias("rest"))
        cannot = F.coalesce(F.col("rest") < F.col("kth"), F.lit(False))
        if states is not None:
            now = now.join(states.select("item", F.col("creating").alias("was")), "item")
            cannot = cannot | ~F.col("was")
        now = stored(now.withColumn("creating", ~cannot & (F.col("rest") > 0)))
        reach = summed.join(now, "item").filter("kth IS NULL OR score + rest >= kth")
        counts = reach.agg(F.count_if(~F.col("creating"))).first()[0]
        past += [summed, now]
        scores, states, survivors = reach.select("item", "row", "score"), now, counts
        creating = now.filter("creating").limit(1).count() > 0

    ids = asked.select("item", "item_id")
    final = scores.filter("score > 0").join(found.select("row", "doc_id"), "row").join(ids, "item")
    best = top_per_group(final, ["item"], [F.desc("score"), "doc_id", "row"], k)
    out = stored(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    forget(asked, found, facts, postings, demand, *past)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each item of the benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
CHECKS = {
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
    sum(q * floor(1000 * ln((2.0 * docs + 2) / (2.0 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN post USING (term) JOIN df USING (term), size GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
""",
}
