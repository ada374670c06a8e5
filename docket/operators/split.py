"""Cutting an assembled report into parts of bounded size, and size accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import metrics
from docket.operators.scan import biggest_group, group_join, ordered_scan
from docket.session import forget, stored

CAP = 20 * 1024 * 1024
TARGETS_MB = {"email": 10, "standard": 25}


def pages_per_part(size: Column, pages: Column, cap: int) -> Column:
    """Average-size estimate with a tenth of slack, one page at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(cap) / (size / pages) * 0.9)).cast("long")


def split_estimate(totals: DataFrame, cap: int = CAP) -> DataFrame:
    """Parts by average page size from (report_id, total_pages, file_size)."""
    t, size = F.col("total_pages"), F.col("file_size")
    per = F.when(size <= cap, t).otherwise(pages_per_part(size, t, cap))
    cut = totals.filter("total_pages > 0").withColumn("per", per)
    part = cut.withColumn("part_number", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(t / F.col("per")))))
    start = (F.col("part_number") - 1) * F.col("per") + 1
    end = F.least(F.col("part_number") * F.col("per"), t)
    return part.select("report_id", "part_number", start.alias("start_page"), end.alias("end_page"), (end - start + 1).alias("page_count"))


def _reach(pages: DataFrame, cap: int, group_rows: int | None, size: tuple[int, int]) -> DataFrame:
    """For every page (0-based ``p``) the first page that no longer fits into a part of ``cap`` bytes starting there.

    With prefix sums E(p) of bytes up to and including p, that is the number of pages q with E(q) <= E(p-1) + cap. It
    is found by merging page ends and limits in byte order and counting ends: a scan, not a pairing of pages."""
    ends = ordered_scan(pages, ["report_id"], ["p"], sums={"through": F.col("n_bytes")}, group_rows=group_rows, size=size)
    two = F.array(
        F.struct(F.col("through").alias("at"), F.lit(0).alias("kind")),
        F.struct((F.col("through") - F.col("n_bytes") + cap).alias("at"), F.lit(1).alias("kind")),
    )
    marks = ends.select("report_id", "p", F.inline(two))
    counted = ordered_scan(
        marks, ["report_id"], ["at", "kind", "p"], sums={"fits": (1 - F.col("kind")).cast("long")}, group_rows=group_rows,
        size=(2 * size[0], 2 * size[1]),
    )
    return counted.filter("kind = 1").select("report_id", "p", F.col("fits").alias("reach"))


def _follow(steps: DataFrame) -> DataFrame:
    """(report_id, start, stop) of the parts, the first from page 0 on, given for each page ``p`` the start ``nxt`` of the part
    after one that starts at ``p``.

    Following the starts one by one is sequential; pointer doubling follows them all at once. A table of jumps leads each page
    over 1, 2, 4, ... parts: it is joined with itself on (report, page), and whatever it leads to from the starts found so far is
    a start too, so the starts double per round. Jumps past the last page drop out, and the rounds end with the last jump: as
    many as the logarithm of the longest row of parts. Every join is on single pages, so no task holds a report."""
    steps = stored(steps)
    pages = steps.select("report_id", F.col("p").alias("nxt"))
    jumps = stored(steps.join(pages, ["report_id", "nxt"], "left_semi").select("report_id", "p", "nxt"))
    starts = steps.filter("p = 0").select("report_id", "p")
    old = []
    while jumps.limit(1).count():
        reached = starts.join(jumps, ["report_id", "p"]).select("report_id", F.col("nxt").alias("p"))
        starts = stored(starts.union(reached))
        further = jumps.select("report_id", F.col("p").alias("nxt"), F.col("nxt").alias("far"))
        old += [starts, jumps]
        jumps = stored(jumps.join(further, ["report_id", "nxt"]).select("report_id", "p", F.col("far").alias("nxt")))
    out = stored(steps.join(starts, ["report_id", "p"], "left_semi").select("report_id", F.col("p").alias("start"), F.col("nxt").alias("stop")))
    forget(steps, jumps, *old)
    return out


def _numbered(parts: DataFrame, group_rows: int | None, size: tuple[int, int]) -> DataFrame:
    numbered = ordered_scan(parts, ["report_id"], ["start"], position="part_number", group_rows=group_rows, size=size)
    return numbered.select(
        "report_id", "part_number", (F.col("start") + 1).alias("start_page"), F.col("stop").alias("end_page"),
        (F.col("stop") - F.col("start")).alias("page_count"),
    )


def _slim(page_sizes: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The page sizes as a stored slim table, and its largest report. They are read several times, and the page stream
    they come from is not worth working out again."""
    sizes = stored(page_sizes.select("report_id", (F.col("global_page") - 1).alias("p"), "n_bytes"))
    return sizes, biggest_group(sizes, ["report_id"])


def split_greedy(page_sizes: DataFrame, cap: int = CAP, group_rows: int | None = None) -> DataFrame:
    """Fill every part as far as ``cap`` allows; a page above the cap is a part of its own. ``page_sizes``: (report_id,
    global_page from 1, n_bytes)."""
    sizes, size = _slim(page_sizes)
    steps = _reach(sizes, cap, group_rows, size).select(
        "report_id", "p", F.greatest("reach", F.col("p") + 1).alias("nxt")
    )
    return _numbered(_follow(steps), group_rows, size)


def _shortened(first: Column, fits: Column) -> Column:
    """Pages of a part of ``first`` pages that has a quarter taken off, one page at least, while it is longer than ``fits`` and
    than one page. A quarter off brings any number down to one in the steps counted here."""
    steps = F.ceil(F.log(F.greatest(first, F.lit(1))) / F.log(F.lit(4 / 3))).cast("int") + 3
    return F.aggregate(
        F.sequence(F.lit(1), steps),
        first,
        lambda pages, _: F.when(
            (pages > fits) & (pages > 1), pages - F.greatest(F.lit(1).cast("long"), F.floor(pages / 4))
        ).otherwise(pages),
    )


def split_adaptive(page_sizes: DataFrame, cap: int = CAP, group_rows: int | None = None) -> DataFrame:
    """Start from the average-size estimate and take a quarter of the pages off while a part is too big."""
    sizes, size = _slim(page_sizes)
    totals = sizes.groupBy("report_id").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # A report without bytes fits whole, so its average is never asked for.
    per = F.when(F.col("bytes") <= cap, F.col("n")).otherwise(pages_per_part(F.col("bytes"), F.col("n"), cap))
    totals = totals.select("report_id", "n", per.alias("per"))
    reach = group_join(_reach(sizes, cap, group_rows, size), totals, ["report_id"])
    first = F.least("per", F.col("n") - F.col("p"))
    length = _shortened(first, F.col("reach") - F.col("p"))
    return _numbered(_follow(reach.select("report_id", "p", (F.col("p") + length).alias("nxt"))), group_rows, size)


def delivery_plan(reports: DataFrame, parts: DataFrame, cap: int = CAP) -> DataFrame:
    """How an assembled report is handed over: as one file, or as a bundle of parts."""
    counted = parts.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_parts"))
    n = F.coalesce("n_parts", F.lit(1).cast("long"))
    single = (F.col("assembled_size") <= cap) | (n <= 1)
    return (
        reports.filter("assembled_filename IS NOT NULL")
        .join(counted, "report_id", "left")
        .select(
            "report_id",
            F.when(single, "single").otherwise("bundle").alias("delivery"),
            F.when(single, 1).otherwise(n).cast("long").alias("files"),
            F.when(single, F.col("assembled_filename"))
            .otherwise(F.concat(F.regexp_replace("assembled_filename", r"\.[^.]+$", ""), F.lit("_split.zip")))
            .alias("file_name"),
        )
    )


def compression_report(sizes: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Account of compression runs (original_size, compressed_size): a result that is not smaller is not used."""
    o = F.col("original_size")
    chosen = F.least("compressed_size", "original_size")
    out = sizes.withColumns(
        {
            "chosen_size": chosen,
            "reduction_pct": metrics.reduction_pct(o, chosen),
            "size_text": metrics.size_display(chosen),
        }
    )
    for name, mb in (targets or TARGETS_MB).items():
        out = out.withColumn(f"meets_{name}", F.col("chosen_size") <= mb * metrics.MB)
    return out

