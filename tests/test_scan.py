"""Both ways of a scan give the same rows; the sliced one is forced by a low limit."""

import random

import pytest
from pyspark.sql import functions as F

from docket.operators.scan import biggest_group, group_figures, group_join, ordered_scan, top_per_group


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [(0 if rnd.random() < 0.5 else rnd.randrange(1, 9), i, rnd.choice([None, *range(-5, 6)])) for i in range(3000)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g int, k bigint, v bigint")


def _scan(df, limit):
    v = F.col("v")
    return ordered_scan(
        df, ["g"], ["k"], position="pos", sums={"s": v}, mins={"lo": v}, maxs={"hi": v}, lags={"before": v}, leads={"after": v},
        group_rows=limit,
    )


def test_sliced_equals_plain(rows):
    plain, sliced = _scan(rows, None), _scan(rows, 100)
    assert plain.columns == sliced.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_sliced_scan_has_no_whole_group_window(rows):
    plan = _scan(rows, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "__slice" in plan


def test_size_may_come_from_a_larger_table(rows):
    part = rows.filter("v > 0")
    got = ordered_scan(part, ["g"], ["k"], position="p", size=rows, group_rows=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, ordered_scan(part, ["g"], ["k"], position="p").collect()))


def test_group_figures(rows):
    got = group_figures(rows, ["g"], {"n": F.count(F.lit(1)), "top": F.max("v")})
    want = rows.join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")), "g").select("g", "k", "v", "n", "top")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_group_join(spark, rows, how):
    table = spark.createDataFrame([(0, "hot"), (3, "cold"), (99, "nobody")], "g int, name string")
    plain = rows.join(table, "g", how)
    joined = group_join(rows, table, ["g"], how)
    assert plain.columns == joined.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, joined.collect()))


def test_top_per_group_is_cut_before_the_shuffle(rows):
    top = top_per_group(rows, ["g"], ["k"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.count() == 3 * rows.select("g").distinct().count()


def test_empty(spark, rows):
    assert biggest_group(rows.limit(0), ["g"]) == (0, 0)
    assert _scan(rows.limit(0), 100).count() == 0
