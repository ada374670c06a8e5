"""Toxicity of restored texts: a noisy-channel decoder undoes leetspeak, spacing and repetition, a lexicon learnt from labels
scores what it restores."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import Memo, hash_words, ngram_hashes, over_partition, over_texts, plain, table, word_hashes, worker_cache
from docket.session import stored

THRESHOLD = 0.7
# Labelled rows that the lexicon is learnt from, at most; the smallest hashes of their ids are taken.
TRAIN_ROWS = 20_000
MIN_WEIGHT = math.log(3)
SURE = 2.5  # standard errors that a weight stays below its estimate
PREFIXES = (4, 5)
MEMO = 120_000  # tokens remembered per generation of a worker's memo
FEATURES = 100_000  # features that a task counts before it hands on its counts

# What each symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
FIRST = str.maketrans({symbol: letters[0] for symbol, letters in LEET.items()})
GAPS = " .-_*'"
EDGE = ".,;:!?\"'()[]{}<>«»…*-_|%&#~^=/"
# Costs of the channel in nats.
SUBSTITUTE, BREAK, REPEAT = 0.7, 2.0, 1.5

# Letter classes of the character model: 0 all that is no letter, 1-26 a-z, 27 other letters, 28 digits and leet symbols.
K = 29
MARKS = re.escape(EDGE)


def _runs(most: int) -> re.Pattern:
    """Three or more words in a row of at most ``most`` characters each, marks around them left out; a mark may be a word."""
    word = rf"(?:[{MARKS}]*+[^\s{MARKS}]{{1,{most}}}+[{MARKS}]*+|\S)"
    return re.compile(rf"(?<!\S){word}(?:\s++{word}){{2,}}(?!\S)")


SPACED, GROUPED, WIDE = _runs(1), _runs(2), re.compile(r"\s{2,}|[^\S ]")
TRIPLE, LETTER, SYMBOL = re.compile(r"(.)\1\1"), re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+€£]")
MARKED, MARK = re.compile(r"[^\W\d_][.\-_*']++[^\W\d_]"), re.compile(r"[.\-_*']+")
DOUBLED = re.compile(r"(.)\1+")
SETTLE = 1000  # characters after which a walk lets go of what all its paths agree on


def char_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if c in LEET or c.isdigit():
        return 28
    return 27 if c.isalpha() else 0


def char_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each three classes follow one another in all texts; at most K cubed rows, summed per task first."""

    def make():
        import numpy as np

        classes = np.array([char_class(chr(i)) for i in range(0x250)] + [27], np.uint16)
        total = np.zeros(K**3, np.int64)

        def step(batch: dict) -> None:
            for at in range(0, len(batch["text"]), 256):
                joined = "\n".join(["", "", *batch["text"][at : at + 256], ""]).lower()
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                c = classes[np.minimum(points, 0x250)].astype(np.uint16)
                codes = (c[:-2] * np.uint16(K) + c[1:-1]) * np.uint16(K) + c[2:]
                total[:] += np.bincount(codes, minlength=K**3)

        def finish() -> dict:
            seen = np.nonzero(total)[0]
            return {"code": seen.tolist(), "n": total[seen].tolist()}

        return step, finish

    return over_partition(plain(docs).select("text"), make, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> list[float]:
    """Costs (negative log probabilities, add-one) of a class after two others, from the counts over all documents."""
    counts = [1.0] * K**3
    for code, n in char_counts(docs).collect():  # at most K cubed rows
        counts[code] += n
    costs = []
    for at in range(0, K**3, K):
        whole = math.log(sum(counts[at : at + K]))
        costs += [whole - math.log(n) for n in counts[at : at + K]]
    return costs


def decode(text: str, costs: list[float]) -> str:
    """The likeliest plain reading of a lower-cased stretch: a Viterbi walk over the lattice of its characters, the state being
    the last two letters read. A symbol reads as itself or as a letter it may stand for; a gap as nothing or, at a cost, as a space; a
    letter that repeats the one before it may be skipped. What all paths agree on is given out as the walk goes, so a stretch of any
    length is one walk, in memory of what is undecided."""
    paths: dict = {"  ": (0.0, None)}  # last two characters read -> (cost, (what was read before, character))
    before, out, classes = "", [], {" ": 0}
    for at, c in enumerate(text, 1):
        if c in GAPS:
            ways = [(" ", BREAK), ("", 0.0)]
        elif c in LEET:
            ways = [(c, 0.0)] + [(letter, SUBSTITUTE) for letter in LEET[c]]
        else:
            ways = [(c, 0.0)]
        if c == before and c not in GAPS:
            ways.append(("", REPEAT))
        for char, _ in ways:
            if char not in classes and char:
                classes[char] = char_class(char)
        step: dict = {}
        for tail, (cost, read) in paths.items():
            one, two = tail
            base = (classes[one] * K + classes[two]) * K
            for char, extra in ways:
                if char:
                    new, end = cost + extra + costs[base + classes[char]], two + char
                    if end not in step or new < step[end][0]:
                        step[end] = (new, (read, char))
                elif tail not in step or cost + extra < step[tail][0]:
                    step[tail] = (cost + extra, read)
        paths, before = step, c
        if at % SETTLE == 0:
            out += _settle(paths)
    ends = ((cost + costs[(classes[tail[0]] * K + classes[tail[1]]) * K], read) for tail, (cost, read) in paths.items())
    _, read = min(ends, key=lambda end: end[0])
    return "".join([*out, *(char for _, char in _steps(read))])


def _steps(read) -> list:
    """The steps of a path from its beginning."""
    out = []
    while read:
        out.append(read)
        read = read[0]
    return out[::-1]


def _settle(paths: dict) -> list[str]:
    """The characters with which all paths begin, by the same steps; the paths go on without them."""
    each = {tail: _steps(read) for tail, (_, read) in paths.items()}
    same = 0
    for steps in zip(*each.values()):
        if any(step is not steps[0] for step in steps):
            break
        same += 1
    settled = [char for _, char in next(iter(each.values()))[:same]]
    for tail, steps in each.items():
        read = None
        for _, char in steps[same:]:
            read = (read, char)
        paths[tail] = (paths[tail][0], read)
    return settled


def readings(token: str, costs: list[float], known=(), longest: int = 0) -> tuple[tuple[str, ...], ...]:
    """The ways to read a token, each a tuple of plain words. Only what could be disguised is decoded; all else has a single
    reading, itself. A token with marks between letters is read as written, decoded, with its marks left out, and as the known
    words that its parts make."""
    word = token.strip(EDGE)
    if not word:
        return ()
    read = lambda text: tuple(w for w in (p.strip(EDGE) for p in decode(text, costs).split(" ")) if w)
    hidden = lambda text: TRIPLE.search(text) or (SYMBOL.search(text) and LETTER.search(text))
    if MARKED.search(word):
        whole = MARK.sub("", word)
        parts = (joined(MARK.split(w), known, longest, 1) for w in (word, word.translate(FIRST)))
        return tuple({(word,): 0, read(word): 0, read(whole) if hidden(whole) else (whole,): 0} | dict.fromkeys(parts, 0))
    return (read(word) if hidden(word) else (word,),)


def plain_word(word: str) -> bool:
    """Letters alone and no letter three times: nothing that could be disguised."""
    return word.isalpha() and not TRIPLE.search(word)


def restored(token: str, costs: list[float]) -> tuple[str, ...]:
    """The words of all readings of a token."""
    word = token.strip(EDGE)
    if plain_word(word):
        return (word,)
    return tuple({w: 0 for words in readings(token, costs) for w in words})


def stretches(run: str) -> set[tuple[str, ...]]:
    """The ways to cut a run of short words into spelled-out stretches: the run as a whole or its single letters only; across all
    gaps, or ended by those wider than a space; with the marks at its ends or without."""
    ways = set()
    for whole in ([run], SPACED.findall(run)):
        for cut in (whole, [part for one in whole for part in WIDE.split(one)]):
            words = [[w.strip(EDGE) or w for w in part.split()] for part in cut]
            ways.add(way := tuple(" ".join(w) for w in words if len(w) > 2))
            ways.add(tuple(part.strip(EDGE + " ") for part in way))
    return ways


def joined(words: list[str], known, longest: int, least: int = 3) -> tuple[str, ...]:
    """The known words, at most ``longest`` characters, that ``least`` or more words in a row make; the first, then the longest."""
    out, at = [], 0
    while at < len(words):
        whole, end, found = "", at, None
        while end < len(words) and len(whole) + len(words[end]) <= longest:
            whole += words[end]
            end += 1
            if end - at >= least and whole in known:
                found = whole, end
        if found:
            out.append(found[0])
        at = found[1] if found else at + 1
    return tuple(out)


def spelled(low: str, costs: list[float], known=(), longest: int = 0):
    """Of each run of words that may be spelled out: its readings, as tuples of words. The decoder takes a run with the short
    words beside it, so words known already are looked for at every place as well."""
    for found in GROUPED.finditer(low):
        ways = stretches(found.group())
        read = {part: decode(part, costs).split(" ") for part in set().union(*ways)}
        readings = {tuple(w for part in way for p in read[part] if len(w := p.strip(EDGE)) > 1) for way in ways}
        plain_words = [w.strip(EDGE) or w for w in found.group().split()]
        for words in (plain_words, [w.translate(FIRST) for w in plain_words]):
            readings.add(joined(words, known, longest))
        yield sorted(readings)


def restorer(costs: list[float]):
    """text -> set of distinct restored words; each distinct token is decoded once."""
    memo = Memo(lambda token: restored(token, costs), MEMO)

    def words(text: str) -> set[str]:
        low = text.lower()
        return set().union(*map(memo.__getitem__, set(low.split())), *(way for ways in spelled(low, costs) for way in ways))

    return words


def features(word: str) -> list[str]:
    """What the lexicon may know of a word: itself, itself without doubled letters, its starts."""
    single = DOUBLED.sub(r"\1", word) if DOUBLED.search(word) else word
    return [word, "~" + single, *[f"^{word[:n]}" for n in PREFIXES if len(word) > n]]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows outside the held-out third, stored. The ids, at most ``limit``, are
    broadcast, so no text is shuffled. A document with several labels counts with the largest."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y IS NOT NULL")
    ids = y.filter(~held_out()).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return stored(plain(docs).join(F.broadcast(ids), "doc_id"))


def first_of_family(rows: DataFrame) -> DataFrame:
    """One row of each family of copies: rows whose smallest five-word shingle agrees. Else the words of a text with a thousand
    copies would all look like evidence."""

    def make():
        cache = word_hashes()

        def work(batch: dict) -> dict:
            keys = []
            for text in batch["text"]:
                words = hash_words(text.lower().split(), cache)
                grams = ngram_hashes(words, min(5, max(1, len(words))))
                keys.append(int(grams.min() >> 1) if len(grams) else 0)
            return {"doc_id": batch["doc_id"], "family": keys}

        return work

    families = over_texts(rows.select("doc_id", "text"), make, "doc_id long, family long")
    firsts = families.groupBy("family").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return rows.join(F.broadcast(firsts), "doc_id", "left_semi")  # at most as many ids as training rows


def lexicon(docs: DataFrame, labels: DataFrame, costs: list[float], label: str = "toxic", limit: int = TRAIN_ROWS) -> tuple[float, dict]:
    """(log odds of the label, feature -> weight). A weight is the lower confidence bound of the log odds ratio of a feature
    between texts with and without the label; small ones are left out. A start of which one word gives
    more than half counts without that word, so one telling word does not speak for others that begin alike."""
    rows = stored(first_of_family(training_rows(docs, labels, label, limit)))
    sizes = dict(rows.groupBy("y").count().collect())
    yes, no = sizes.get(1, 0), sizes.get(0, 0)

    def make():
        words = restorer(costs)
        seen = (Counter(), Counter())

        def step(batch: dict) -> dict | None:
            out = {"feature": [], "no": [], "yes": []}
            for text, y in zip(batch["text"], batch["y"]):
                seen[y == 1].update({f for w in words(text) for f in features(w)})
                if len(seen[0]) + len(seen[1]) >= FEATURES:
                    for name, values in finish().items():
                        out[name] += values
            return out if out["feature"] else None

        def finish() -> dict:
            names = list(seen[0].keys() | seen[1].keys())
            out = {"feature": names, "no": [seen[0][f] for f in names], "yes": [seen[1][f] for f in names]}
            for counts in seen:
                counts.clear()
            return out

        return step, finish

    counts = over_partition(rows.select("text", "y"), make, "feature string, no long, yes long").groupBy("feature").agg(
        F.sum("no").alias("no"), F.sum("yes").alias("yes")
    )
    kind = F.substring("feature", 1, 1)
    starts = F.array(*[F.when(F.length("feature") > n, F.concat(F.lit("^"), F.substring("feature", 1, n))) for n in PREFIXES])
    most = counts.filter(~kind.isin("~", "^")).select(F.explode(F.array_compact(starts)).alias("feature"), F.struct("yes", "no").alias("most"))
    most = most.groupBy("feature").agg(F.max("most").alias("most"))
    led = F.col("most.yes") * 2 > F.col("yes")
    less = lambda c: F.when(led, F.greatest(F.col(c) - F.col(f"most.{c}"), F.lit(0))).otherwise(F.col(c)).alias(c)
    counts = counts.join(most, "feature", "left").select("feature", less("no"), less("yes"))
    a, b = F.col("yes") + 0.5, F.col("no") + 0.5
    ratio = F.log(a / (yes + 1)) - F.log(b / (no + 1))
    weight = ratio - SURE * F.sqrt(1 / a + 1 / b)
    best = counts.select("feature", weight.alias("weight")).filter(F.col("weight") >= MIN_WEIGHT)
    # Features of training rows, whose number is bounded, and of those the few that tell.
    return math.log((yes + 1) / (no + 1)), {r["feature"]: r["weight"] for r in best.collect()}


def scorer(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS):
    """A column function: text -> score from 0 to 1. Learns the character model from all documents and the lexicon from at most
    ``limit`` labelled rows; both have a fixed largest size and are broadcast."""
    costs = char_model(docs)
    prior, weights = lexicon(docs, labels, costs, label, limit)
    name = f"toxicity_{abs(hash((round(prior, 9), len(weights), round(sum(weights.values()), 6), round(sum(costs), 6))))}"
    model = docs.sparkSession.sparkContext.broadcast((costs, prior, weights))

    def build():
        costs, prior, weights = model.value
        whole = {f for f in weights if f[0] not in "~^"}
        longest = max(map(len, whole), default=0)

        def evidence(word: str) -> tuple:
            """((weight, feature, word),) of a word that the lexicon knows, by its strongest feature; else nothing."""
            found = [(weights[f], f, word) for f in features(word) if f in weights]
            return (max(found),) if found else ()

        def strongest(readings) -> tuple:
            """The evidence of one of several readings of the same characters, which do not bear each other out."""
            each = (tuple(found for w in words for found in evidence(w)) for words in readings)
            return max(each, key=lambda found: sum(weight for weight, *_ in found), default=())

        def of_token(token: str) -> tuple:
            word = token.strip(EDGE)
            if plain_word(word):
                return evidence(word)
            return strongest(readings(token, costs, whole, longest))

        # Most tokens are no evidence and share one empty tuple, so a remembered token is little more than its text.
        memo = Memo(of_token, MEMO)

        def score(text: str) -> float:
            low = text.lower()
            found = set().union(*map(memo.__getitem__, set(low.split())), *map(strongest, spelled(low, costs, whole, longest)))
            # Words known by one feature bear each other out: the second adds a half of its weight, the third a third.
            known = Counter((weight, feature) for weight, feature, _ in found)
            total = prior + sum(weight * sum(1 / i for i in range(1, n + 1)) for (weight, _), n in sorted(known.items()))
            return 1 / (1 + math.exp(-min(total, 700.0)))

        return score

    def scores(texts):
        import pandas as pd

        score = worker_cache(name, build)
        return pd.Series([score(t or "") for t in texts], dtype="float64")

    return F.pandas_udf(scores, "double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    The score depends on the text alone. Null text is empty; an empty text scores what no evidence scores. Without labelled rows
    the lexicon is empty and every score is the prior. Other columns are ignored; repeated and null ids give a row each."""
    score = scorer(docs, labels)
    out = plain(docs).select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``. A null text is empty and scores what no
    evidence scores; repeated rows score alike; without labelled rows all score the prior. An empty table stays empty."""
    score = scorer(docs, labels)
    return docs.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out third."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
