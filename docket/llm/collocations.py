"""Phrase collocation mining by sorted relations: occurrences of frequent phrases are merged where they stand one word apart,
counted by groups and kept where their group is frequent, length by length."""

from __future__ import annotations

import copy
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.llm.common import table
from docket.session import scratch_dir, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[.,;:!?\n\x0b\f\r]"
LONGEST = 4
SUPPORT = 30
INSIDE = 80  # percent of a phrase's occurrences inside one longer phrase that drop it
TOP = 2000
# Groups of one length that are broadcast when they are counted to be no more; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Relation:
    """A table of occurrences (piece, pos, ...) in the shared folder, bucketed by piece and sorted by place: merging two of
    them needs no exchange. ``drop`` removes it."""

    def __init__(self, rows: DataFrame, dealt: bool):
        """``dealt``: the rows are hashed by piece to as many partitions as there are buckets already."""
        self.spark = rows.sparkSession
        self.name = f"relation_{uuid.uuid4().hex}"
        self.path = f"{scratch_dir(self.spark).rstrip('/')}/{self.name}"
        count = buckets(self.spark)
        rows = rows if dealt else rows.repartition(count, "piece")
        writer = rows.write.bucketBy(count, "piece").sortBy("piece", "pos").option("path", self.path)
        # Words and ids repeat; a larger dictionary page keeps them as indexes.
        writer.option("parquet.dictionary.page.size", 8 << 20).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def narrowed(self, rows: DataFrame) -> "Relation":
        """The same stored table seen through ``rows``."""
        out = copy.copy(self)
        out.rows = rows
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Relations are merged as they lie: a bucket, one sorted file, counts as sorted, and being dealt by piece is enough for a
    merge by piece and place."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowered(text: Column) -> Column:
    """Only A-Z lower-cased; a text of ASCII alone takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(piece, pos, id, word): every word of every whole text at its place in its piece, pieces numbered over the table. A word
    carries its lang, a space between them; no word holds a space.

    Pieces are dealt to the buckets and sorted before they are cut into words, so what travels is text, and words, of which there
    are many more, come as their relation is sorted. Only pieces with tabs or runs of spaces need a pattern to be cut."""
    text = lowered(F.coalesce(F.col("text").cast("string"), F.lit("")))
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    pieces = plain.select("lang", F.explode(F.split("text", BREAKS)).alias("text"))
    numbered = pieces.withColumn("piece", F.monotonically_increasing_id()).filter("text <> ''")
    dealt = numbered.repartition(buckets(docs.sparkSession), "piece").sortWithinPartitions("piece")
    uneven = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("  "))
    cut = F.when(uneven, F.split("text", "[ \t]+")).otherwise(F.split("text", " "))
    each = dealt.select("piece", F.posexplode(cut).alias("pos", "word"), "lang").filter("word <> ''")
    word = F.concat("lang", F.lit(" "), "word")
    return each.select("piece", "pos", F.xxhash64(F.lit(seed), word).alias("id"), word.alias("word"))


def vocabulary(docs: DataFrame) -> tuple[Relation, DataFrame]:
    """The occurrences of all words, and (lang, word, a, id), the words with their counts and ids. Ids are hashes under the first
    seed that gives no two words of the whole table the same."""
    seed = 0
    while True:
        relation = Relation(words(docs, seed), dealt=True)
        each = relation.rows.groupBy("word").agg(F.count(F.lit(1)).alias("a"), F.min("id").alias("id"))
        word = F.substring_index("word", " ", -1)
        lang = F.expr("substr(word, 1, char_length(word) - char_length(substring_index(word, ' ', -1)) - 1)")
        found = stored(each.select(lang.alias("lang"), word.alias("word"), "a", "id"))
        every, ids = found.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if every == ids:
            return relation, found
        relation.drop()
        seed += 1


def numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """Groups, stored, each with an ``id`` from 0 without gaps; and how many they are. Rows are numbered within partitions; the
    sizes of these, a row for each, are summed up before them. Two ids make one long, see ``paired``."""
    out = stored(groups.withColumn("mark", F.monotonically_increasing_id()))
    part, within = F.shiftright("mark", 33), F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = out.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    starts = sizes.select("part", before.alias("start"))
    size = out.count()
    if size >= 1 << 31:
        raise ValueError(f"{size} frequent groups of one length; two ids of 31 bits are kept in a long")
    ids = out.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("id", F.col("start") + within)
    return stored(ids.drop("mark", "part", "start")), size


def paired(g: Column, h: Column) -> Column:
    """One long for two ids below 2 ** 31: it is looked up and grouped by faster than two."""
    return F.shiftleft(g, 32).bitwiseOR(h)


def frequent(occurrences: DataFrame, support: int) -> tuple[DataFrame, int]:
    """The frequent pairs (key, g, h), stored, each with an ``id`` and its count ``a``; and how many they are."""
    groups = occurrences.groupBy("key").agg(F.count(F.lit(1)).alias("a")).filter(F.col("a") >= support)
    low = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    return numbered(groups.select("key", F.shiftright("key", 32).alias("g"), low.alias("h"), "a"))


def within(relation: Relation, groups: DataFrame, size: int) -> Relation:
    """The occurrences of frequent groups, (piece, pos, id). Groups counted to be few are broadcast, which keeps rows in their
    buckets, so nothing has to be stored; more of them are joined by a shuffle, and the rows stored in buckets again."""
    names = groups.select("key", "id")
    small = size <= BROADCAST_ROWS
    each = relation.rows.select("piece", "pos", "key").join(F.broadcast(names) if small else names, "key").select("piece", "pos", "id")
    if small:
        return relation.narrowed(each)
    kept = Relation(each, dealt=False)
    relation.drop()
    return kept


def adjacent(relation: Relation) -> DataFrame:
    """(piece, pos, key): where a phrase g stands at pos, and h one word further, which share all words but two; the key is of
    both."""
    first = relation.rows.select("piece", "pos", F.col("id").alias("g"))
    second = relation.rows.select("piece", (F.col("pos") - 1).alias("pos"), F.col("id").alias("h"))
    return first.join(second, ["piece", "pos"]).select("piece", "pos", paired(F.col("g"), F.col("h")).alias("key"))


def described(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """Groups (id, g, h, a) with their lang, words, and counts of what begins and ends them: ``heads[j]`` and ``tails[j]`` are
    the counts of the first and of the last j + 1 words."""
    first = shorter.select(F.col("id").alias("g"), "lang", "words", "heads")
    second = shorter.select(F.col("id").alias("h"), F.element_at("words", -1).alias("last"), "tails")
    both = groups.join(first, "g").join(second, "h")
    return both.select(
        "id", "g", "h", "lang", "a",
        F.concat("words", F.array("last")).alias("words"),
        F.concat("heads", F.array("a")).alias("heads"),
        F.concat("tails", F.array("a")).alias("tails"),
    )


def lowest_cut(length: int) -> Column:
    """(score, k, l, r) of the cut with the lowest score, the smallest k of several. Products are decimals of 38 digits."""
    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = f"CAST(2000000 AS DECIMAL(17)) * CAST(a AS DECIMAL(20)) div CAST(heads[{k - 1}] + tails[{length - k - 1}] AS DECIMAL(20))"
        cuts.append(F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def not_inside(groups: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """Groups without those of which one phrase, one word longer and holding them, has ``percent`` of their count. A phrase
    longer still with so many holds such a one, so it need not be looked at."""
    each = longer.select(F.col("g").alias("id"), "a").union(longer.select(F.col("h").alias("id"), "a"))
    most = each.groupBy("id").agg(F.max("a").alias("most"))
    part = F.expr(f"CAST(100 AS DECIMAL(10)) * most >= CAST({percent} AS DECIMAL(10)) * a")
    return groups.join(most, "id", "left").filter(~F.coalesce(part, F.lit(False))).drop("most")


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each lang the ``top`` phrases of 2 to ``longest`` words by score.

    A candidate has ``a >= support`` occurrences within pieces; of its cuts the one with the lowest floor(2000000 a / (l + r))
    counts; candidates mostly inside a longer one are dropped. Null lang is ``und``; null and empty texts give no words; every
    row counts, repeated ones too; other columns are not looked at; an empty table gives no rows.

    Occurrences of words are stored by piece and place. Those of length k + 1 are two frequent ones of length k one place apart, a
    merge of a stored relation with itself, stored again; they are counted by (first, second), one long, and kept, by a join with the
    frequent groups, under the group's id. Every part of a frequent phrase is frequent, so nothing is lost."""
    with sorted_buckets(docs.sparkSession):
        relation, found = vocabulary(docs)
        total = found.groupBy("lang").agg(F.sum("a").alias("n"))
        relation = relation.narrowed(relation.rows.withColumnRenamed("id", "key"))
        groups, size = numbered(found.filter(F.col("a") >= support).withColumnRenamed("id", "key"))
        own = F.array("a")
        lengths = [groups.select("id", "lang", F.array("word").alias("words"), own.alias("heads"), own.alias("tails"))]
        for _ in range(2, longest + 1):
            kept = within(relation, groups, size)
            relation = Relation(adjacent(kept), dealt=True)
            kept.drop()
            groups, size = frequent(relation.rows, support)
            lengths.append(stored(described(groups, lengths[-1])))
        relation.drop()
    candidates = []
    for length, found in enumerate(lengths[1:], 2):
        left = not_inside(found, lengths[length], inside) if length < longest else found
        best = lowest_cut(length)
        candidates.append(left.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", best.alias("best")))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.union(more)
    ranked = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    first = every.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return first.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


CHECKS = {
    "op11_collocations": f"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(string_split_regex(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spelled AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i + 3])) AS w FROM spelled),
phrases AS (
  SELECT lang, k, array_to_string(w[1:k], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE k <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= {SUPPORT}),
split AS (
  SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM c, (VALUES (1), (2), (3)) AS cut(j) WHERE j < k),
cuts AS (
  SELECT split.lang, split.phrase, a, j, x.c AS l, y.c AS r, (2000000::HUGEINT * a) // (x.c + y.c) AS score
  FROM split JOIN f AS x ON x.lang = split.lang AND x.phrase = head JOIN f AS y ON y.lang = split.lang AND y.phrase = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most
  FROM c, (VALUES (2), (3)) AS lengths(n), (VALUES (1), (2), (3)) AS starts(i) WHERE n < k AND i + n - 1 <= k
  GROUP BY ALL),
inside AS (SELECT lang, phrase FROM c JOIN parts USING (lang, phrase) WHERE 100 * most >= 80 * a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM best ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
""",
}
