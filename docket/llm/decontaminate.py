"""Benchmark passages in training texts: rare n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import KEY, Words, hash_words, in_parts, over_partition, over_texts, plain, row_key, same_row, table, word_hashes
from docket.session import stored

SEED_WORDS = (3, 8)  # shortest and longest seed
# A seed is rare when it is expected at most so often in the whole corpus, were words independent.
EXPECTED = 1.0
SCORE = 0.5  # aligned score against that of the whole item
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 22  # a filter is two bytes arrays of this many bits of address
TOGETHER = 64  # alignments worked out side by side


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words, hashes): lower-cased words of each item's whole text; items without words are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def make():
        import numpy as np

        def work(batch: dict) -> dict:
            each = [Words([t]) for t in batch["text"]]
            return {
                "item_id": batch["item_id"],
                "words": [w.texts(0, len(w.start)) for w in each],
                "hashes": [w.hashes.view(np.int64) for w in each],
            }

        return work

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    return over_texts(rows, make, "item_id long, words array<string>, hashes array<long>").filter("size(words) > 0")


def bit_filter(hashes: DataFrame, column: str):
    """Two maps of fixed size, 2 ** FILTER_BITS bytes each, over two parts of each hash, broadcast. They only spare rows a join
    that would drop them; when many hashes fill them, more rows reach that join."""
    spot = [F.shiftrightunsigned(column, 64 - FILTER_BITS * (i + 1)).bitwiseAND(2**FILTER_BITS - 1) for i in (0, 1)]
    spots = hashes.select(F.inline(F.array(*[F.struct(F.lit(i).alias("map"), c.cast("int").alias("spot")) for i, c in enumerate(spot)])))
    maps = (bytearray(2**FILTER_BITS), bytearray(2**FILTER_BITS))
    for i, at in spots.distinct().toLocalIterator():  # at most 2 ** (FILTER_BITS + 1) small numbers
        maps[i][at] = 1
    return hashes.sparkSession.sparkContext.broadcast((bytes(maps[0]), bytes(maps[1])))


def passing(maps, hashes):
    """Places of the hashes that both maps know."""
    import numpy as np

    first = np.nonzero(maps[0][hashes >> np.uint64(64 - FILTER_BITS)])[0]
    spot = (hashes[first] >> np.uint64(64 - 2 * FILTER_BITS)) & np.uint64(2**FILTER_BITS - 1)
    return first[maps[1][spot] == 1]


def grams(hashes, longest: int):
    """(n, hashes of the n-grams that begin at each word) for n from 1 on, each made from the one before. Those that run over
    the end of a text are for the caller to leave out."""
    import numpy as np

    with np.errstate(over="ignore"):
        run = np.zeros(len(hashes), np.uint64)
        for n in range(1, longest + 1):
            if n > len(hashes):
                return
            run = run[: len(hashes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]
            mixed = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield n, mixed ^ (mixed >> np.uint64(32))


def word_totals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(word, n): occurrences over all documents of the words of the items, by hash, counted per task first; and in the row of
    word null the number of all words."""
    words = items.select(F.explode("hashes").alias("word")).distinct()
    marks = bit_filter(words, "word")

    def make():
        import numpy as np

        maps = [np.frombuffer(m, np.uint8) for m in marks.value]
        counts: dict = {}

        def step(batch: dict) -> None:
            for a, b in in_parts(batch["text"]):
                found = Words(batch["text"][a:b]).hashes
                counts[None] = counts.get(None, 0) + len(found)
                for word, n in zip(*np.unique(found[passing(maps, found)], return_counts=True)):
                    word = _signed(int(word))
                    counts[word] = counts.get(word, 0) + int(n)

        return step, lambda: {"word": list(counts), "n": list(counts.values())}

    totals = over_partition(plain(docs).select("text"), make, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return totals.filter("word IS NULL").unionByName(totals.join(words, "word", "left_semi"))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def seeds(items: DataFrame, totals: DataFrame, expected: float = EXPECTED) -> DataFrame:
    """(hash, item_id, at): from each word of an item the shortest n-gram that is rare, judged by the counts of its words in the
    whole corpus and not by its own, so a passage copied into very many documents keeps its seeds. Where no length up to the
    longest is rare the longest counts, and an item too short for a seed is one seed as a whole, so every item has some."""
    all_words = totals.filter("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    n_words = all_words.first()[0] or 1
    each = items.select("item_id", F.posexplode("hashes").alias("at", "word")).join(totals.filter("word IS NOT NULL"), "word", "left")
    known = each.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    low, high = SEED_WORDS

    def make():
        import math

        import numpy as np

        def work(batch: dict) -> dict:
            out = {"hash": [], "item_id": [], "at": []}
            for item, rows in zip(batch["item_id"], batch["w"]):
                hashes = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
                logs = np.cumsum([0.0] + [math.log((r["n"] + 0.5) / n_words) for r in rows])
                size = len(rows)
                chosen = set()
                for at in range(max(1, size - low + 1)):
                    end = min(at + low, size)
                    while end < min(at + high, size) and math.log(n_words) + logs[end] - logs[at] > math.log(expected):
                        end += 1
                    # Near the end the start moves back instead, so a seed is never shorter or commoner than it has to be.
                    while at > 0 and end - at < high and end == size and math.log(n_words) + logs[end] - logs[at] > math.log(expected):
                        at -= 1
                    chosen.add((at, end))
                for at, end in sorted(chosen):
                    *_, (_, whole) = grams(hashes[at:end], end - at)
                    out["hash"].append(_signed(int(whole[0])))
                    out["item_id"].append(item)
                    out["at"].append(at)
            return out

        return work

    return over_texts(known, make, "hash long, item_id long, at int")


def passages(docs: DataFrame, seed_rows: DataFrame, reach: int) -> DataFrame:
    """(row key, part, first, words, hits): stretches of a text around the places of seeds, ``reach`` words to each side, joined
    where they touch and cut at four times that length; a place near a cut is in both stretches."""
    marks = bit_filter(seed_rows, "hash")
    high = SEED_WORDS[1]

    def make():
        import numpy as np

        maps = [np.frombuffer(m, np.uint8) for m in marks.value]

        def work(batch: dict) -> dict | None:
            out = {k: [] for k in (*KEY, "part", "first", "words", "hits")}
            for a, b in in_parts(batch["text"]):
                found = Words(batch["text"][a:b])
                left = found.left()
                spots, values = [], []
                # Shorter n-grams than the shortest seed are seeds only of items that are no longer.
                for n, hashes in grams(found.hashes, high):
                    at = passing(maps, hashes)
                    at = at[left[at] >= n]
                    spots.append(at)
                    values.append(hashes[at])
                if not spots or not sum(map(len, spots)):
                    continue
                spots, values = np.concatenate(spots), np.concatenate(values)
                order = np.argsort(spots, kind="stable")
                spots, values = spots[order], values[order]
                text_of = np.searchsorted(found.first, spots, side="right") - 1
                start, part, last = 0, 0, -1
                while start < len(spots):
                    row = text_of[start]
                    end = start + 1
                    while (
                        end < len(spots)
                        and text_of[end] == row
                        and spots[end] - spots[end - 1] <= 2 * reach
                        and spots[end] - spots[start] <= 4 * reach
                    ):
                        end += 1
                    part = part + 1 if row == last else 0
                    begin, finish = int(found.first[row]), int(found.first[row + 1])
                    low_word = max(begin, int(spots[start]) - reach)
                    for k in KEY:
                        out[k].append(batch[k][a + row])
                    out["part"].append(part)
                    out["first"].append(low_word - begin)
                    out["words"].append(found.texts(low_word, min(finish, int(spots[end - 1]) + reach)))
                    out["hits"].append(sorted({_signed(int(v)) for v in values[start:end]}))
                    start, last = end, row
            return out if out["part"] else None

        return work

    keyed = plain(docs).select(*row_key(), "text")
    return over_texts(keyed, make, "doc_id long, h1 long, h2 long, part int, first int, words array<string>, hits array<long>")


def align(texts: list, items: list):
    """Smith-Waterman with linear gaps for a batch of (words, item) hash rows: (score, first, end) per pair, the best local
    alignment's score and its words in the text. Row by row over the items' words; a cell holds the score and, below it, where
    its alignment began, so the running maximum that carries gaps along a row carries the beginning too."""
    import numpy as np

    count, width, depth = len(texts), max(map(len, texts)), max(map(len, items))
    shown = np.zeros((count, width), np.uint64)
    for i, t in enumerate(texts):
        shown[i, : len(t)] = t
    inside = np.arange(width) < np.array([len(t) for t in texts])[:, None]
    bits = 24
    low = (1 << bits) - 1
    here = np.arange(width, dtype=np.int64)
    ramp = here * (-GAP << bits)
    fresh = here + 1  # an alignment that begins after this cell
    above = np.broadcast_to(np.arange(width + 1, dtype=np.int64), (count, width + 1)).copy()
    best, best_end = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for row in range(depth):
        real = np.array([row < len(t) for t in items])
        want = np.array([t[row] if row < len(t) else 0 for t in items], np.uint64)
        gain = np.where((shown == want[:, None]) & inside, MATCH, MISMATCH).astype(np.int64) << bits
        cell = np.maximum(above[:, :-1] + gain, above[:, 1:] + (GAP << bits))
        cell = np.where(cell >> bits > 0, cell, fresh)
        along = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        cell = np.where(along >> bits > cell >> bits, along, cell)
        cell = np.where(inside, cell, fresh)
        above[:, 0] = 0
        above[real, 1:] = cell[real]
        score = np.where(real[:, None], cell >> bits, 0)
        end = score.argmax(axis=1)
        top = score[np.arange(count), end]
        better = top > best >> bits
        best = np.where(better, cell[np.arange(count), end], best)
        best_end = np.where(better, end + 1, best_end)
    return best >> bits, np.where(best >> bits > 0, best & low, 0), best_end


def contamination(docs: DataFrame, items: DataFrame, least: float = SCORE, expected: float = EXPECTED) -> DataFrame:
    """(row key, item_id, score, first_word, end_word) for every row of ``docs`` and item whose best alignment reaches ``least``
    of the score of the whole item (words that match count 2, others and gaps -1). One row per pair, the best place of it.

    Null and empty texts and items match nothing; equal items each match; a repeated item id counts as one item with its first
    text in word order; repeated rows give one result, which joins back to each. An empty table on either side gives no rows.
    Words of the items, seeds and passages meet in joins; only filters of fixed size and the length of the longest item are
    shared with all tasks. The texts themselves are not shuffled, only stretches around seeds."""
    best = F.min(F.struct("words", "hashes"))
    items = stored(item_words(items).groupBy("item_id").agg(best.alias("b")).select("item_id", "b.*"))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 1
    totals = stored(word_totals(docs, items))
    seed_rows = stored(seeds(items, totals, expected))
    found = stored(passages(docs, seed_rows, longest + longest // 4 + 1).dropDuplicates([*KEY, "part"]))
    pairs = found.select(*KEY, "part", F.explode("hits").alias("hash")).join(seed_rows, "hash").select(*KEY, "part", "item_id").distinct()
    # Copies of a passage are aligned once per item: the words are one key however many documents hold them.
    texts = found.select(*KEY, "part", "first", F.xxhash64("words").alias("passage"))
    at = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & (F.col("part") == F.col("__part"))
    places = stored(
        pairs.join(texts.withColumnsRenamed({k: f"__{k}" for k in (*KEY, "part")}), at).select(*KEY, "first", "passage", "item_id")
    )
    distinct = places.select("passage", "item_id").distinct()
    words = found.select(F.xxhash64("words").alias("passage"), F.col("words").alias("text")).dropDuplicates(["passage"])
    jobs = distinct.join(words, "passage").join(items.select("item_id", "words"), "item_id")

    def make():
        cache = word_hashes()

        def work(batch: dict) -> dict:
            n = len(batch["item_id"])
            out = {"passage": batch["passage"], "item_id": batch["item_id"], "score": [0.0] * n, "begin": [0] * n, "end": [0] * n}
            order = sorted(range(n), key=lambda i: (len(batch["text"][i]), len(batch["words"][i])))
            for at in range(0, n, TOGETHER):
                part = order[at : at + TOGETHER]
                want = [hash_words(batch["words"][i], cache) for i in part]
                done = align([hash_words(batch["text"][i], cache) for i in part], want)
                for i, item, score, begin, end in zip(part, want, *done):
                    out["score"][i] = int(score) / (MATCH * len(item))
                    out["begin"][i], out["end"][i] = int(begin), int(end)
            return out

        return work

    scored = over_texts(jobs, make, "passage long, item_id long, score double, begin int, end int").filter(F.col("score") >= least)
    span = F.struct("score", (-(F.col("first") + F.col("begin"))).alias("back"), (F.col("first") + F.col("end")).alias("end_word"))
    best = places.join(scored, ["passage", "item_id"]).groupBy(*KEY, "item_id").agg(F.max(span).alias("best"))
    return best.select(*KEY, "item_id", "best.score", (-F.col("best.back")).alias("first_word"), "best.end_word")


def clean(docs: DataFrame, items: DataFrame, least: float = SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item. Null and empty texts match none and stay; a row and its
    repetitions go together; items that are null, empty or repeated change nothing; empty tables on either side take nothing away."""
    gone = contamination(docs, items, least).select(*KEY).dropDuplicates()
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return same_row(whole.select("row", *row_key()), gone, "left_anti").select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exact or edited, with the best alignment of each pair."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "end_word")
