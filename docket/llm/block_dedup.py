"""Exact duplicates by deterministic block naming: blocks get integer names by sorting, adjacent names are named again until
every text is one name. Names stand for texts without collisions; no hash decides that two texts are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import plain, table
from docket.session import stored

BLOCK = 512  # characters of a block
ROW = ["doc_id", "text_sha256"]


def _on_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, text_sha256), null ids matching; ``right`` has one row per key. Rows that agree in both are one row
    repeated, and each repetition gets the row's result."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in ROW})
    joined = left.join(named, (F.col("text_sha256") == F.col("__text_sha256")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), how)
    return joined if how == "left_anti" else joined.drop("__doc_id", "__text_sha256")


def _sorted_names(values: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values with integer names in the order of (hash, value): a range-partitioned sort, numbered partition by
    partition. The ranges are cut by the hash, so what is sampled to cut them is a number and no text; values with one hash
    are neighbours and still get names of their own."""
    marked = values.select(*by).distinct().withColumn("mark", F.xxhash64(*by))
    return marked.repartitionByRange("mark").sortWithinPartitions("mark", *by).select(*by, F.monotonically_increasing_id().alias("name"))


def block_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_sha256, n, name, copies) of every row that shares its length and first block with another row: equal n and
    name mean equal texts. Rows whose first block is already unique need no further naming and are left out.

    Level 0 names whole blocks. Each further level names pairs of adjacent names, so a text of b blocks is one name after
    log2(b) levels, and the rows halve with every level. Each level is written to the shared folder."""
    base = plain(docs).select(
        "doc_id", "text", F.length("text").alias("n"), F.sha2("text", 256).alias("text_sha256"), F.substring("text", 1, block).alias("head")
    )
    shared = base.groupBy("n", "head").count().filter("count > 1").drop("count")
    # A text is cut into its blocks in one pass; the empty text is one empty block.
    cut = F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    blocks = stored(base.join(shared, ["n", "head"]).select(*ROW, "n", F.posexplode(cut).alias("pos", "block")))
    named = blocks.join(_sorted_names(blocks, ["block"]), "block")
    level = stored(named.groupBy(*ROW, "n", "pos").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("copies")))
    last = level.agg(F.max("pos")).first()[0] or 0
    while last > 0:
        side = F.col("pos") % 2
        pairs = level.groupBy(*ROW, "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("copies").alias("copies"),
        )
        pairs = stored(pairs)
        level = stored(pairs.join(_sorted_names(pairs, ["left", "right"]), ["left", "right"]).drop("left", "right"))
        last //= 2
    return level.drop("pos")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when identical; null is the empty text, and empty texts equal each other. Of equal texts the row with the
    largest id stays; null ids stay only where a group has no other. A repeated row (same id and text) appears, and counts in
    ``group_size``, as often as it is repeated; all its repetitions carry the same ``kept``. Other columns are ignored; an empty table gives no rows."""
    names = block_names(docs, block)
    groups = names.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    known = names.join(groups, ["n", "name"]).select(*ROW, "keep_id", "group_size")
    rows = plain(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    out = _on_row(rows, known, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts: that with the largest id, one of its repetitions.
    Null and empty texts are one group, of which one row stays; null ids stay only where a group has no other. An empty table
    stays empty."""
    names = block_names(docs, block)
    groups = names.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"))
    known = names.join(groups, ["n", "name"])
    gone = known.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*ROW)
    repeated = known.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copies") > 1)).select(*ROW)
    whole = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text_sha256"),
    )
    left = _on_row(whole, gone.withColumn("mark", F.lit(0)).unionByName(repeated.withColumn("mark", F.lit(1))), "left")
    once = left.filter("mark = 1").groupBy(*ROW).agg(F.first("row").alias("row"))
    return left.filter("mark IS NULL").select("row.*").unionByName(once.select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents, whole texts."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


CHECKS = {
    "op1_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t))"""
}
