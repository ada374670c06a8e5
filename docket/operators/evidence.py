"""What page text says about a document: section evidence, sub-group hints, identity, compiled reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import metrics
from docket.functions.names import py
from docket.operators.excerpt import excerpt_first, page_ends
from docket.operators.scan import group_join
from docket.schema import SECTION_NAMES


def _hits(text: Column, patterns: Sequence[str]) -> Column:
    total = F.lit(0)
    for pattern in patterns:
        total = total + text.rlike(py(pattern)).cast("int")
    return total


def score_sections(
    excerpts: DataFrame, evidence: Sequence[tuple[str, list[str]]] = tuple(fv.SECTION_EVIDENCE),
    ranges: Sequence[tuple] = tuple(fv.SECTION_RANGES),
) -> DataFrame:
    """Section with the most evidence in an excerpt: one point per listed word found, one for a page count in the
    section's usual range once a word was found. Ties go to the earlier section; nothing found is unclassified."""
    low = F.lower("excerpt")
    usual = {s: (lo, hi) for s, lo, hi, *_ in ranges}
    scored = []
    for section, words in evidence:
        found = F.lit(0)
        for word in words:
            found = found + low.contains(word).cast("int")
        lo, hi = usual.get(section, (None, None))
        bonus = F.col("n_pages").between(lo, hi).cast("int") if lo is not None else F.lit(0)
        possible = len(words) + (0 if lo is None else 1)
        score = F.when(found > 0, found + bonus).otherwise(0)
        scored.append(
            F.struct(
                score.alias("score"), F.lit(-SECTION_NAMES.index(section)).alias("place"), F.lit(section).alias("section"),
                F.lit(possible).alias("possible"),
            )
        )
    best = excerpts.withColumn("best", F.array_max(F.array(*scored)))
    some = F.col("best.score") > 0
    return best.select(
        "doc_id",
        F.when(some, F.col("best.section")).otherwise(fv.UNCLASSIFIED[0]).alias("category"),
        F.col("best.score").alias("score"),
        F.when(some, F.col("best.score") / F.col("best.possible")).otherwise(0.0).alias("confidence"),
    )


def _hint(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """(score, name) of the sub-group with most patterns in a text, ties to the last name."""
    low = F.lower(text)
    return F.greatest(*[F.struct(_hits(low, p).alias("score"), F.lit(g).alias("name")) for g, p in groups.items()])


def _front(doc_pages: DataFrame, filings: DataFrame, section: str, n: int, max_chars: int) -> DataFrame:
    """Text of the first pages of a section's documents. Pages are cut to the budget before they are joined."""
    piece = F.substring(F.coalesce("txt", F.lit("")), 1, max_chars).alias("txt")
    cut = doc_pages.filter(F.col("page_no") < n).select("doc_id", "page_no", piece)
    wanted = filings.filter(F.col("category") == section).select("doc_id")
    return excerpt_first(cut.join(wanted, "doc_id", "left_semi"), n, max_chars)


def ordering_hint(
    doc_pages: DataFrame, filings: DataFrame, groups: Mapping[str, Sequence[str]] = fv.HINT_PATTERNS, max_chars: int = 2000
) -> DataFrame:
    """Sub-group of Appendix D documents from their first five pages: most patterns found, ties to the last name."""
    text = _front(doc_pages, filings, "APPENDIX_D", 5, max_chars)
    return text.withColumn("best", _hint(F.col("excerpt"), groups)).select(
        "doc_id", F.when(F.col("best.score") > 0, F.col("best.name")).alias("hint"), F.col("best.score").alias("score")
    )


def property_profile(
    doc_pages: DataFrame, filings: DataFrame, patterns: Sequence[str] = tuple(fv.PROFILE_PATTERNS), max_chars: int = 2000
) -> DataFrame:
    """Whether an Appendix E document is a property profile, from its first three pages."""
    text = _front(doc_pages, filings, "APPENDIX_E", 3, max_chars)
    return text.select("doc_id", (_hits(F.lower("excerpt"), patterns) > 0).alias("is_profile"))


def first_page_facts(doc_pages: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Per document what its first five pages say: sub-group hint, property profile, project number, address, company. All from
    one shuffle of pages cut to the budget."""
    piece = F.substring(F.coalesce("txt", F.lit("")), 1, max_chars).alias("piece")
    first = F.when(F.col("page_no") == 0, page_ends(F.col("txt"), 1000))
    cut = doc_pages.filter("page_no < 5").select("doc_id", "page_no", piece, first.alias("ends"))
    whole = cut.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "piece"))).alias("p"), F.max("ends").alias("ends")
    )

    def text(n: int) -> Column:
        pages = F.transform(F.filter("p", lambda x: x.page_no < n), lambda x: x.piece)
        return F.substring(F.array_join(pages, "\n"), 1, max_chars)

    read = whole.select("doc_id", "ends", text(5).alias("five"), F.lower(text(3)).alias("three"))
    best = read.withColumn("best", _hint(F.col("five"), fv.HINT_PATTERNS))
    return best.select(
        "doc_id",
        F.when(F.col("best.score") > 0, F.col("best.name")).alias("hint"),
        (_hits(F.col("three"), fv.PROFILE_PATTERNS) > 0).alias("is_profile"),
        *[c.alias(n) for n, c in identity_columns(F.col("ends")).items()],
    )


def _first_found(text: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, py(p, fold=True), g), F.lit("")) for p, g in patterns])


def identity_columns(text: Column) -> dict[str, Column]:
    return {
        "found_project_id": _first_found(text, [(p, 1) for p in fv.PROJECT_ID_PATTERNS]),
        "found_address": _first_found(text, [(fv.ADDRESS_PATTERN, 1)]),
        "found_company": _first_found(text, fv.COMPANY_PATTERNS),
    }


def extract_identity(headers: DataFrame) -> DataFrame:
    """Project number, address and company named on a document's first page; the first pattern that matches counts."""
    return headers.select("doc_id", *[c.alias(n) for n, c in identity_columns(F.col("header_footer")).items()])


def contamination(identity: DataFrame, filings: DataFrame, reports: DataFrame) -> DataFrame:
    """Documents that name another project than their report's own: its stated number, else the number most of its
    documents name (ties to the smaller)."""
    named = filings.select("doc_id", "report_id").join(identity, "doc_id").filter("found_project_id IS NOT NULL")
    ids = named.groupBy("report_id", F.lower("found_project_id").alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    usual = ids.groupBy("report_id").agg(F.min_by("pid", F.struct(-F.col("n"), F.col("pid"))).alias("usual_id"))
    expected = usual.join(reports.select("report_id", "project_number"), "report_id", "left").select(
        "report_id", F.coalesce(F.lower(F.nullif("project_number", F.lit(""))), F.col("usual_id")).alias("expected_id")
    )
    return group_join(named, expected, ["report_id"]).select(
        "report_id",
        "doc_id",
        "found_project_id",
        "expected_id",
        (F.lower("found_project_id") != F.col("expected_id")).alias("is_foreign"),
    )


def compiled_report(
    doc_pages: DataFrame, filings: DataFrame, min_size: int | None = None, pages: int = fv.COMPILED_PAGES
) -> DataFrame:
    """PDFs that are an earlier assembled report: a table of contents, a phase mention and three kinds of appendix
    label within the first pages. Each label is tested page by page; no label spans a page break. ``min_size`` leaves
    smaller files out, as the upload of single files does; uploads of folders have no such gate.

    Pages are reduced to one row of flags per document before anything is joined, so no text is shuffled."""
    large = F.col("ext") == ".pdf" if min_size is None else (F.col("file_size") >= min_size) & (F.col("ext") == ".pdf")
    big = filings.filter(large).select("doc_id")
    low = F.lower("txt")

    def says(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        return F.coalesce(found, F.lit(False))

    near = doc_pages.filter(F.col("page_no") < pages)
    flags = near.select(
        "doc_id",
        *[says(words).alias(f"m{i}") for i, words in enumerate(fv.COMPILED_MARKERS)],
        says([fv.COMPILED_TOC]).alias("toc"),
        says(fv.COMPILED_PHASE).alias("phase"),
    )
    marks = [F.bool_or(f"m{i}").cast("int") for i in range(len(fv.COMPILED_MARKERS))]
    return (
        flags.groupBy("doc_id")
        .agg(sum(marks[1:], marks[0]).alias("markers"), F.bool_or("toc").alias("toc"), F.bool_or("phase").alias("phase"))
        .join(big, "doc_id", "left_semi")
        .withColumn("is_compiled", (F.col("markers") >= 3) & F.col("toc") & F.col("phase"))
    )


def exclude_compiled(filings: DataFrame, found: DataFrame) -> DataFrame:
    """Take compiled reports out, with the reason."""
    hits = found.filter("is_compiled").select("doc_id", F.lit(True).alias("__compiled"))
    hit = F.col("__compiled").isNotNull()
    return (
        filings.join(hits, "doc_id", "left")
        .withColumns(
            {
                "is_included": F.when(hit, False).otherwise(F.col("is_included")),
                "reasoning": F.when(hit, fv.COMPILED_REASON).otherwise(F.col("reasoning")),
            }
        )
        .drop("__compiled")
    )


def auto_name(reports: DataFrame, filings: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Fill a report's empty number and address, and a name that is still the default, from its first included cover
    document."""
    cover = (
        filings.filter("category = 'COVER_WRITEUP' AND is_included")
        .groupBy("report_id")
        .agg(F.min_by(F.struct("doc_id", "ext", "original_filename"), "doc_id").alias("d"))
        .select("report_id", "d.*")
        .filter(F.col("ext").isin(".pdf", *fv.WORD_EXTENSIONS))
    )
    piece = F.substring(F.coalesce("txt", F.lit("")), 1, 5000).alias("txt")
    cut = doc_pages.filter("page_no < 5").select("doc_id", "page_no", piece)
    near = cut.join(cover.select("doc_id"), "doc_id", "left_semi")
    text = excerpt_first(near, 5, 5000).filter(F.length(metrics.blank_trim(F.col("excerpt"))) >= 20)
    read = F.concat_ws("\n", F.substring("excerpt", 1, 4000))
    found = cover.join(text, "doc_id").withColumns(identity_columns(read)).select(
        "report_id", "found_project_id", "found_address", F.concat(F.lit("Phase I ESA - "), F.col("found_address")).alias("found_name")
    )
    out = reports.join(found, "report_id", "left")
    named = F.when(F.col("name").startswith("New Report"), F.col("found_name"))
    return out.select(
        "report_id",
        F.coalesce(named, F.col("name")).alias("name"),
        F.coalesce(F.nullif("address", F.lit("")), F.col("found_address"), F.col("address")).alias("address"),
        F.coalesce(F.nullif("project_number", F.lit("")), F.col("found_project_id"), F.col("project_number")).alias("project_number"),
    )

