"""Text windows over pages: which pages are read, and how their text is put together.

Pages are the one big table. Every operator here first narrows it by ``page_no`` (which reaches the scan) and cuts each
page to the excerpt's budget, so that a shuffle carries a bounded number of short rows per document, however many pages
the document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import metrics
from docket.operators.scan import top_per_group

SAMPLE_BREAK = "\n[SAMPLE PAGE]\n"
PAGE_BLOCK = 4096
RANK_BLOCK = 256  # pages that share a count of the deleted ones before them
SAMPLE_FROM, SAMPLE_TO, SAMPLE_MAX = 50, 500, 5


def paginate(df: DataFrame, text: str = "text", key: str = "doc_id", lines: int = 47, width: int = 100) -> DataFrame:
    """Plain text to pages of ``lines`` lines; longer lines are cut and marked. Works inside the row: no shuffle."""
    cut = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1),
        lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("..."))).otherwise(x),
    )
    with_lines = df.select(key, cut.alias("__lines"))
    pages = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("__lines") / lines).cast("int") - 1),
        lambda i: F.array_join(F.slice("__lines", i * lines + 1, lines), "\n"),
    )
    return with_lines.select(key, F.posexplode(pages).alias("page_no", "txt"))


def paragraphs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blank-line separated paragraphs, trimmed, empties dropped."""
    parts = F.transform(F.split(F.col(text), "\n\n", -1), metrics.blank_trim)
    return df.select(key, F.posexplode(F.filter(parts, lambda x: x != "")).alias("para_no", "para"))


def _joined(max_chars: int, piece: str = "piece", sep: str = "\n") -> Column:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", piece))), lambda p: p[piece])
    return F.substring(F.array_join(ordered, sep), 1, max_chars)


def excerpt_first(doc_pages: DataFrame, n: int = 5, max_chars: int = 5000) -> DataFrame:
    """Text of the first ``n`` pages within a character budget. Stopping at the page that passes the budget and cutting
    the joined text give the same characters, so only the cut is done."""
    piece = F.substring(F.coalesce("txt", F.lit("")), 1, max_chars).alias("piece")
    return (
        doc_pages.filter(F.col("page_no") < n)
        .select("doc_id", "page_no", piece)
        .groupBy("doc_id")
        .agg(_joined(max_chars).alias("excerpt"))
    )


def excerpt_last(doc_pages: DataFrame, n: int = 3, max_chars: int = 3000) -> DataFrame:
    """The same over the last ``n`` pages; map tasks keep at most ``n`` pages per document."""
    piece = F.substring(F.coalesce("txt", F.lit("")), 1, max_chars).alias("piece")
    tail = top_per_group(doc_pages.select("doc_id", "page_no", piece), ["doc_id"], [F.desc("page_no")], n)
    return tail.groupBy("doc_id").agg(_joined(max_chars).alias("excerpt"))


def page_ends(text: Column, max_chars: int = 500) -> Column:
    """First and last three lines of a page; a page of under four lines as it is."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    ends = F.concat(
        F.array_join(F.slice(lines, 1, 3), "\n"), F.lit("\n---\n"), F.array_join(F.slice(lines, -3, 3), "\n")
    )
    return F.substring(F.when(F.size(lines) < 4, F.coalesce(text, F.lit(""))).otherwise(ends), 1, max_chars)


def header_footer(doc_pages: DataFrame, max_chars: int = 500) -> DataFrame:
    """The ends of a document's first page."""
    return doc_pages.filter("page_no = 0").select("doc_id", page_ends(F.col("txt"), max_chars).alias("header_footer"))


def document_sizes(doc_pages: DataFrame) -> DataFrame:
    """Pages per document, without reading any text."""
    return doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


def _sampled(page: Column, n: Column) -> Column:
    """Every n//100-th page from 50 on, below page 500 and 50 pages before the end, five at most."""
    step = F.greatest(F.lit(1), F.floor(n / 100))
    return (
        (page >= SAMPLE_FROM)
        & (page < F.least(n - 50, F.lit(SAMPLE_TO)))
        & ((page - SAMPLE_FROM) % step == 0)
        & ((page - SAMPLE_FROM) / step < SAMPLE_MAX)
    )


def with_sizes(doc_pages: DataFrame) -> DataFrame:
    """Pages that know how many their document has. Pages written by ``paginate`` carry it; for others it is counted without
    reading text and joined, which costs a shuffle of the pages."""
    return doc_pages if "n_pages" in doc_pages.columns else doc_pages.join(document_sizes(doc_pages), "doc_id")


# Characters that a page can give to each part of an excerpt.
PART_CHARS = {"whole": 10_000, "head": 3000, "tail": 2000, "sample": 500}


def wanted_pages(doc_pages: DataFrame, small: int = 50, head: int = 5, tail: int = 3) -> DataFrame:
    """The pages worth reading, each with its part: small documents whole; of larger ones the first, the last and a few
    in between. A filter on the page itself: nothing is shuffled."""
    page, n = F.col("page_no"), F.col("n_pages")
    part = (
        F.when(n < small, "whole")
        .when(page < head, "head")
        .when(page >= n - tail, "tail")
        .when(_sampled(page, n), "sample")
    )
    return with_sizes(doc_pages).withColumn("part", part).filter("part IS NOT NULL")


def page_sample(doc_pages: DataFrame, **kw) -> DataFrame:
    """The page set of ``smart_excerpt`` as an operator of its own."""
    return wanted_pages(doc_pages, **kw).select("doc_id", "page_no", "part", "txt")


def smart_excerpt(doc_pages: DataFrame, small: int = 50) -> DataFrame:
    """What a classifier reads of a document: at most 10,000 characters of a small one, else 8,000 characters of head,
    tail and sampled pages. Each page is cut to what its part can give before the one shuffle, by document."""
    budget = F.lit(0)
    for part, chars in PART_CHARS.items():
        budget = F.when(F.col("part") == part, chars).otherwise(budget)
    piece = F.substring(F.coalesce("txt", F.lit("")), F.lit(1), budget).alias("piece")
    pieces = wanted_pages(doc_pages, small).select("doc_id", "page_no", "n_pages", "part", piece)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "part", "piece")))
    whole = pieces.groupBy("doc_id").agg(F.first("n_pages").alias("n_pages"), ordered.alias("p"))

    def text(part: str):
        return F.transform(F.filter("p", lambda x: x.part == part), lambda x: x.piece)

    large = F.concat(
        F.array(
            F.substring(F.array_join(text("head"), "\n"), 1, 3000), F.substring(F.array_join(text("tail"), "\n"), 1, 2000)
        ),
        text("sample"),
    )
    excerpt = F.when(
        F.col("n_pages") < small, F.substring(F.array_join(text("whole"), "\n"), 1, 10_000)
    ).otherwise(F.substring(F.array_join(large, SAMPLE_BREAK), 1, 8000))
    return whole.select("doc_id", "n_pages", excerpt.alias("excerpt"))


def choose_text(doc_pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """OCR text where the digital text is short and OCR found more."""
    digital, ocr = (F.length(metrics.blank_trim(F.col(c))) for c in ("txt", "ocr_txt"))
    use = (digital < min_chars) & (ocr > digital)
    return doc_pages.withColumns(
        {
            "text_source": F.when(use, "ocr").otherwise("digital"),
            "best_txt": F.when(use, F.col("ocr_txt")).otherwise(F.coalesce("txt", F.lit(""))),
        }
    )


def kept_pages(doc_pages: DataFrame, filings: DataFrame, min_chars: int = 10) -> DataFrame:
    """Pages of each document that go into a report: all of them, but for Word files without the blank run at the end.
    One aggregate over narrow columns where pages carry ``n_trimmed``, the length of their trimmed text; else text is read,
    but does not leave the map side."""
    word = filings.select("doc_id", F.col("ext").isin(*fv.WORD_EXTENSIONS).alias("is_word"))
    known = "n_trimmed" in doc_pages.columns
    filled = (F.col("n_trimmed") if known else F.length(metrics.blank_trim(F.col("txt")))) >= min_chars
    counted = doc_pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.coalesce(F.max(F.when(filled, F.col("page_no") + 1)), F.lit(0)).cast("long").alias("n_filled"),
    )
    return word.join(counted, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.when(F.col("is_word"), F.col("n_filled")).otherwise(F.col("n_pages")), F.lit(0)).alias("kept"),
    )


def join_pages(doc_pages: DataFrame, per_doc: DataFrame, pages: str, block: int = PAGE_BLOCK) -> DataFrame:
    """Inner join of pages with one row per document. The document's row is repeated per block of its ``pages`` pages
    and matched on (document, block): a document with a great share of all pages is spread over many tasks."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.col(pages) - 1, F.lit(0)) / block).cast("int"))
    spread = per_doc.filter(F.col(pages) > 0).withColumn("__block", F.explode(blocks))
    return (
        doc_pages.withColumn("__block", F.floor(F.col("page_no") / block).cast("int"))
        .join(spread, ["doc_id", "__block"])
        .drop("__block")
    )


def strip_blank_tail(doc_pages: DataFrame, filings: DataFrame, min_chars: int = 10) -> DataFrame:
    kept = kept_pages(doc_pages, filings, min_chars)
    return join_pages(doc_pages, kept, "kept").filter(F.col("page_no") < F.col("kept")).drop("kept")


def prompt_rows(filings: DataFrame, excerpts: DataFrame, cut: int = 500) -> DataFrame:
    """The message a model gets for a filing."""
    text = F.substring(metrics.blank_trim(F.col("excerpt")), 1, cut)
    head = F.concat(F.lit("Filename: "), F.col("original_filename"))
    path = F.when(F.coalesce("original_path", F.lit("")) != "", F.concat(F.lit("Path: "), F.col("original_path")))
    size = F.concat(
        F.lit("Pages: "), F.coalesce("n_pages", F.lit(0)).cast("string"), F.lit(", Size: "),
        F.floor(F.col("file_size") / 1024).cast("string"), F.lit("KB"),
    )
    body = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("\nText:\n"), text)).otherwise(
        "\n(No text extracted — scanned document or image)"
    )
    return filings.join(excerpts, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, path, size, body).alias("prompt"))


def _ranks(doc_pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, block, gone, before) for every block of RANK_BLOCK pages of the documents that lose some: the deleted pages
    within the block, and how many there are in the blocks before. Blocks are counted within runs of RANK_BLOCK blocks and the
    runs among each other, so no window holds more than one row per RANK_BLOCK squared pages of a document."""
    block = F.floor(F.col("page_no") / RANK_BLOCK).alias("block")
    gone = listed.groupBy("doc_id", block).agg(F.collect_list("page_no").alias("gone"))
    some = listed.select("doc_id").distinct()
    there = doc_pages.select("doc_id", block).distinct().join(some, "doc_id", "left_semi")
    run = F.floor(F.col("block") / RANK_BLOCK)
    blocks = there.join(gone, ["doc_id", "block"], "left").withColumns({"lost": F.greatest(F.size("gone"), F.lit(0)), "run": run})
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = earlier.partitionBy("doc_id", "run").orderBy("block")
    runs = blocks.groupBy("doc_id", "run").agg(F.sum("lost").alias("lost"))
    sums = runs.select("doc_id", "run", F.coalesce(F.sum("lost").over(earlier.partitionBy("doc_id").orderBy("run")), F.lit(0)).alias("runs_before"))
    placed = blocks.withColumn("before", F.coalesce(F.sum("lost").over(within), F.lit(0))).join(sums, ["doc_id", "run"])
    return placed.select("doc_id", "block", "gone", (F.col("before") + F.col("runs_before")).alias("before"))


def delete_pages(doc_pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop the listed pages and number the rest again from 0; pages are numbered without gaps. Indexes that do not exist
    change nothing: negative ones are left out, and those beyond the last page come before no page.

    A page's new number is its own less the deleted ones before it: those of earlier blocks, counted once per block, and those
    before it in its own. So a page meets one short row of its block, however many pages its document loses."""
    listed = requests.select("doc_id", F.explode("pages").alias("page_no")).filter("page_no >= 0").distinct()
    ranks = _ranks(doc_pages, listed).select("doc_id", F.col("block").alias("__block"), F.col("gone").alias("__gone"), F.col("before").alias("__before"))
    met = doc_pages.withColumn("__block", F.floor(F.col("page_no") / RANK_BLOCK)).join(ranks, ["doc_id", "__block"], "left")
    page = F.col("page_no")
    left = met.filter(F.col("__gone").isNull() | ~F.array_contains("__gone", page))
    before = F.coalesce("__before", F.lit(0)) + F.greatest(F.size(F.filter("__gone", lambda x: x < page)), F.lit(0))
    return left.select(*doc_pages.columns, (page - before).cast("int").alias("new_page_no"))


def html_blocks(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Headings, paragraphs and table rows of a page in order, with ids that count all blocks (p0, t1, ...)."""
    mark, end = "\u0001", "\u0002"
    clean = F.regexp_replace(F.col(html), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    marked = F.regexp_replace(clean, r"(?i)<(h[1-6]|p|tr)(\s[^>]*)?>", f"{mark}$1{end}")
    pieces = F.slice(F.split(marked, mark, -1), 2, 2_000_000_000)
    blocks = pages.select(key, F.posexplode(pieces).alias("block_no", "__piece"))
    tag = F.lower(F.substring_index("__piece", end, 1))
    body = F.substring_index("__piece", end, -1)
    own = F.regexp_replace(body, r"(?is)</(h[1-6]|p|tr|table|div|article|section|nav|body)>.*", "")
    text = metrics.blank_trim(F.regexp_replace(own, r"(?s)<[^>]*>", ""))
    kind = F.when(tag == "tr", "table").when(tag == "p", "paragraph").otherwise("heading")
    return blocks.select(
        key,
        "block_no",
        F.concat(F.when(tag == "tr", "t").otherwise("p"), F.col("block_no").cast("string")).alias("block_id"),
        kind.alias("kind"),
        tag.alias("tag"),
        text.alias("text"),
    )
