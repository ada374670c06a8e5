import random

import pytest
from pyspark.sql import functions as F

from docket.operators import split


def sizes_table(spark, reports):
    rows = [(r, i + 1, b) for r, sizes in reports.items() for i, b in enumerate(sizes)]
    return spark.createDataFrame(rows, "report_id bigint, global_page bigint, n_bytes bigint")


def adaptive(sizes, cap):
    n, total, at, out = len(sizes), sum(sizes), 0, []
    per = n if total <= cap else max(1, int(cap / (total / n) * 0.9))
    while at < n:
        end = min(at + per, n)
        while sum(sizes[at:end]) > cap and end - at > 1:
            end -= max(1, (end - at) // 4)
        out.append((at + 1, end))
        at = end
    return out


def greedy(sizes, cap):
    out, at = [], 0
    while at < len(sizes):
        end = at + 1
        while end < len(sizes) and sum(sizes[at : end + 1]) <= cap:
            end += 1
        out.append((at + 1, end))
        at = end
    return out


@pytest.mark.parametrize("group_rows", [None, 40])
def test_parts_match_a_plain_loop(spark, group_rows):
    rnd = random.Random(7)
    reports = {r: [rnd.choice([1, 5, 20, 90, 150]) for _ in range(rnd.randrange(1, 200))] for r in range(1, 12)}
    reports |= {12: [0] * 150, 13: [0], 14: [0, 0, 300, 0, 0], 15: [101] * 64}
    table = sizes_table(spark, reports)
    for build, plain in ((split.split_adaptive, adaptive), (split.split_greedy, greedy)):
        got = {}
        for r in build(table, cap=100, group_rows=group_rows).orderBy("report_id", "part_number").collect():
            got.setdefault(r.report_id, []).append((r.start_page, r.end_page))
        assert got == {r: plain(s, 100) for r, s in reports.items()}


def test_a_million_tiny_pages(spark):
    """One report of a million pages that are a part each two by two, and one of as many pages without bytes."""
    pages = spark.range(1, 1_000_001).select(F.lit(1).cast("long").alias("report_id"), F.col("id").alias("global_page"), F.lit(50).cast("long").alias("n_bytes"))
    empty = pages.withColumns({"report_id": F.lit(2).cast("long"), "n_bytes": F.lit(0).cast("long")})
    parts = split.split_greedy(pages.union(empty), cap=100)
    assert "InPandas" not in parts._jdf.queryExecution().executedPlan().toString()
    facts = parts.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("page_count").alias("pages"), F.max("page_count").alias("longest"), F.max("part_number").alias("last")
    )
    assert {tuple(r) for r in facts.collect()} == {(1, 500_000, 1_000_000, 2, 500_000), (2, 1, 1_000_000, 1_000_000, 1)}


def test_any_number_of_pages_comes_down_to_one(spark):
    first = [1, 2, 3, 4, 5, 96, 10**9, 2**62]
    df = spark.createDataFrame([(n,) for n in first], "n long")
    assert [r[0] for r in df.select(split._shortened(F.col("n"), F.lit(0).cast("long"))).collect()] == [1] * len(first)


def test_estimate(spark):
    t = spark.createDataFrame([(1, 10, 100), (2, 10, 40)], "report_id bigint, total_pages bigint, file_size bigint")
    got = sorted((r.report_id, r.start_page, r.end_page) for r in split.split_estimate(t, cap=50).collect())
    assert got == [(1, 1, 4), (1, 5, 8), (1, 9, 10), (2, 1, 10)]


def test_compression_never_grows(spark):
    df = spark.createDataFrame([(1, 1000, 1200), (2, 1000, 250), (3, 0, 0)], "report_id int, original_size bigint, compressed_size bigint")
    got = {r.report_id: (r.chosen_size, r.reduction_pct) for r in split.compression_report(df).collect()}
    assert got == {1: (1000, 0.0), 2: (250, 75.0), 3: (0, 0.0)}
