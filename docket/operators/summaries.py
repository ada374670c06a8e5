"""Figures per report and section. Each is one partial-then-final hash aggregate; nothing is gathered per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import metrics
from docket.schema import SECTION_NAMES, section_dim, section_range

PAGES = metrics.pages_or_zero
MB = metrics.MB


def _pages() -> Column:
    return PAGES(F.col("page_count"))


def _each_report(reports: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures of every report; a report they do not know has zeros."""
    return reports.select("report_id").join(figures, "report_id", "left").na.fill(0)


def section_summary(filings: DataFrame) -> DataFrame:
    """Included documents and pages per section, with label and place."""
    sums = filings.filter("is_included").groupBy("report_id", "category").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(_pages()).alias("pages")
    )
    dim = section_dim(filings.sparkSession).withColumnRenamed("section", "category")
    return sums.join(F.broadcast(dim), "category").select("report_id", "section_pos", "category", "display", "docs", "pages")


def section_rollup(filings: DataFrame) -> DataFrame:
    """Section, report and overall totals of included documents in one pass."""
    return (
        filings.filter("is_included")
        .rollup("report_id", "category")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum(_pages()).alias("pages"))
    )


def report_info(filings: DataFrame, reports: DataFrame) -> DataFrame:
    inc = F.col("is_included")
    sums = filings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(inc).alias("included_docs"),
        F.count_if(~inc).alias("excluded_docs"),
        F.count_if(F.col("category") != fv.UNCLASSIFIED[0]).alias("classified_docs"),
        F.count_if(F.col("status") == "error").alias("error_docs"),
        F.sum(F.when(inc, _pages()).otherwise(0)).alias("total_pages"),
    )
    return _each_report(reports, sums)


def processing_status(filings: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows under way in conversion or classification count as neither pending nor ready."""
    s = F.col("status")
    sums = filings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "uploaded").alias("pending"),
        F.count_if(s.isin("ready", "classified")).alias("ready"),
        F.count_if(s == "error").alias("errors"),
    )
    return _each_report(reports, sums).withColumn("complete", F.col("pending") == 0)


def preflight(filings: DataFrame, reports: DataFrame, warn_pages: int = 500, error_pages: int = 2000) -> DataFrame:
    """Check before assembly, for every report; one without documents has no main body and cannot be assembled."""
    ok = metrics.is_candidate(F.col("is_included"), F.col("status"))
    has = {s: F.count_if(ok & (F.col("category") == s)) for s in SECTION_NAMES}
    sums = filings.groupBy("report_id").agg(
        F.count_if(ok).alias("total_docs"),
        F.sum(F.when(ok, _pages()).otherwise(0)).alias("total_pages"),
        F.count_if(ok & (F.col("category") == fv.UNCLASSIFIED[0])).alias("n_unclassified"),
        *[n.alias(f"n_{s}") for s, n in has.items()],
    )
    sums = _each_report(reports, sums)
    filled = sum((F.col(f"n_{s}") > 0).cast("int") for s in SECTION_NAMES[1:])
    filled = filled + (F.col(f"n_{SECTION_NAMES[0]}") > 0).cast("int")
    un, pages = F.col("n_unclassified"), F.col("total_pages")

    def messages(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    empty = messages(*[F.when(F.col(f"n_{s}") == 0, F.lit(label)) for s, label in fv.EXPECTED_SECTIONS])
    plural = F.when(un == 1, "").otherwise("s")
    errors = messages(
        F.when(F.col("n_COVER_WRITEUP") == 0, "Missing Cover / Write-Up — report has no main body document"),
        F.when(
            pages > error_pages,
            F.concat(F.lit("Report has "), pages.cast("string"), F.lit(" pages — likely contains duplicates. Check documents before assembling.")),
        ),
    )
    warnings = messages(
        F.when(un > 0, F.concat(un.cast("string"), F.lit(" document"), plural, F.lit(" still unclassified"))),
        F.when(F.size(empty) > 0, F.concat(F.lit("Empty sections: "), F.array_join(empty, ", "))),
        F.when(
            (pages > warn_pages) & (pages <= error_pages),
            F.concat(F.lit("Report has "), pages.cast("string"), F.lit(" pages — verify this is expected")),
        ),
    )
    return sums.withColumns({"errors": errors, "warnings": warnings}).select(
        "report_id",
        ((F.size("errors") == 0) & (F.col("total_docs") > 0)).alias("can_assemble"),
        "errors",
        "warnings",
        "total_pages",
        "total_docs",
        filled.alias("sections_filled"),
        (F.lit(len(SECTION_NAMES)) - filled).alias("sections_empty"),
    )


def _every_section(filings: DataFrame, reports: DataFrame, dim: list[str]) -> DataFrame:
    """(report, section) rows for every report and every section of a small dimension, with included docs and pages.
    The dimension sits in an array that each report explodes."""
    sums = filings.groupBy("report_id", "category").agg(
        F.count_if("is_included").alias("docs"),
        F.sum(F.when(F.col("is_included"), _pages()).otherwise(0)).alias("pages"),
        F.count(F.lit(1)).alias("all_docs"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    names = F.array(*[F.lit(r) for r in dim])
    grid = reports.select("report_id", F.explode(names).alias("category"))
    zero = F.lit(0).cast("long")
    figures = ["docs", "pages", "all_docs", "errors"]
    return grid.join(sums, ["report_id", "category"], "left").withColumns({c: F.coalesce(c, zero) for c in figures})


def section_flags(filings: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections out of their usual range: empty ones that should not be, and ones above twice the usual maximum."""
    grid = _every_section(filings, reports, [r[0] for r in fv.SECTION_RANGES])
    dim = section_range(filings.sparkSession).withColumnRenamed("section", "category")
    df = grid.join(F.broadcast(dim), "category")
    empty = (F.col("pages") == 0) & (F.col("min_docs") > 0)
    large = F.col("pages") > F.col("max_pages") * 2
    text = F.when(
        empty,
        F.concat(
            F.col("category"), F.lit(" is empty — expected "), F.col("min_pages").cast("string"), F.lit("-"),
            F.col("max_pages").cast("string"), F.lit(" pages"),
        ),
    ).when(
        large,
        F.concat(
            F.col("category"), F.lit(" has "), F.col("pages").cast("string"), F.lit(" pages (typical max: "),
            F.col("max_pages").cast("string"), F.lit(")"),
        ),
    )
    severity = F.when(empty & (F.col("category") == "COVER_WRITEUP"), "error").otherwise("warning")
    return df.select("report_id", "category", text.alias("issue"), severity.alias("severity")).filter("issue IS NOT NULL")


def report_health(filings: DataFrame, reports: DataFrame, lo: int = 1000, hi: int = 4000) -> DataFrame:
    inc = F.col("is_included")
    sums = filings.groupBy("report_id").agg(
        F.sum(F.when(inc, _pages()).otherwise(0)).alias("pages"),
        F.sum(F.when(inc & (F.col("category") == "COVER_WRITEUP"), _pages()).otherwise(0)).alias("cover_pages"),
    )
    health = (
        F.when(F.col("cover_pages") == 0, "critical").when(F.col("pages").between(lo, hi), "good").otherwise("needs_attention")
    )
    return _each_report(reports, sums).withColumn("health", health)


def suggestions(reports: DataFrame, filings: DataFrame, at_most: int = 5) -> DataFrame:
    """What a user may want to do next, in order of use."""
    inc = F.col("is_included")
    sums = filings.groupBy("report_id").agg(
        F.count_if(inc).alias("n_in"),
        F.count_if(~inc).alias("n_out"),
        F.sum(F.when(inc & (F.col("category") == "REPORTS_AFTER_E"), _pages()).otherwise(0)).alias("after_pages"),
        F.count_if(inc & (F.col("category") == fv.UNCLASSIFIED[0])).alias("n_un"),
    )
    df = reports.join(sums, "report_id", "left").na.fill(0, ["n_in", "n_out", "after_pages", "n_un"])
    done = F.coalesce("assembled_filename", F.lit("")) != ""
    options = F.array(
        F.lit("How many pages?"),
        F.when((F.col("n_in") > 0) & ~done, "Assemble report"),
        F.when(done & (F.col("assembled_size") > 20 * MB), "Split for email"),
        F.when(done, "Compress for email"),
        F.when(F.col("n_out") > 0, F.concat(F.lit("Show "), F.col("n_out").cast("string"), F.lit(" excluded docs"))),
        F.when(F.col("after_pages") > 500, "Trim supporting reports"),
        F.when(F.col("n_un") > 0, F.concat(F.lit("Classify "), F.col("n_un").cast("string"), F.lit(" unclassified docs"))),
    )
    return df.select("report_id", F.slice(F.filter(options, lambda x: x.isNotNull()), 1, at_most).alias("suggestions"))


def exclusion_groups(filings: DataFrame) -> DataFrame:
    """Excluded documents by reason."""
    out = filings.filter("NOT is_included AND status <> 'error'")
    return out.groupBy("report_id", metrics.exclusion_group(F.col("reasoning")).alias("reason_group")).agg(
        F.count(F.lit(1)).alias("docs")
    )


def confidence_bands(filings: DataFrame) -> DataFrame:
    band = metrics.confidence_band(F.col("confidence"), F.col("reasoning")).alias("band")
    return filings.groupBy("report_id", band).agg(F.count(F.lit(1)).alias("docs"))


def curation_effect(filings: DataFrame, reports: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Counts of recommendations, and what would remain with the exclusions applied."""
    recs = recommendations.select("report_id", "doc_id", "kind").distinct()
    per_doc = recs.groupBy("report_id", "doc_id").agg(
        F.bool_or(F.col("kind") == "exclude").alias("out"), F.bool_or(F.col("kind") == "reclassify").alias("move")
    )
    live = filings.filter("is_included").join(per_doc, ["report_id", "doc_id"], "left")
    out, move = (F.coalesce(F.col(c), F.lit(False)) for c in ("out", "move"))
    sums = live.groupBy("report_id").agg(
        F.count_if(out).alias("exclude_count"),
        F.count_if(move).alias("reclassify_count"),
        F.count_if(~out).alias("remaining_docs"),
        F.sum(F.when(~out, _pages()).otherwise(0)).alias("remaining_pages"),
    )
    return _each_report(reports, sums)


def report_list(reports: DataFrame, filings: DataFrame) -> DataFrame:
    """Reports, newest first, with their number of documents."""
    counts = filings.groupBy("report_id").agg(F.count(F.lit(1)).alias("document_count"))
    return (
        reports.join(counts, "report_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0).cast("long")))
        .orderBy(F.desc("created_at"), "report_id")
    )


def run_duration(reports: DataFrame) -> DataFrame:
    return reports.select(
        "report_id", metrics.duration_seconds(F.col("pipeline_start"), F.col("pipeline_end")).alias("duration_seconds")
    )


def ready_to_assemble(reports: DataFrame, filings: DataFrame) -> DataFrame:
    some = metrics.is_candidate(F.col("is_included"), F.col("status")) & (F.col("category") != fv.UNCLASSIFIED[0])
    flags = filings.groupBy("report_id").agg(F.bool_or(some).alias("has_documents"))
    ready = F.coalesce("has_documents", F.lit(False)) & (F.coalesce("assembled_filename", F.lit("")) == "")
    return reports.join(flags, "report_id", "left").select("report_id", ready.alias("ready"))


def run_summary(filings: DataFrame, reports: DataFrame, corrected: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Account of a whole run; ``corrected`` is what ``apply_corrections`` returned."""
    base = filings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != "error").alias("uploaded"),
        F.count_if((F.col("status") != "error") & F.col("is_included")).alias("classified"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    fixed = corrected.groupBy("report_id").agg(F.sum("n_applied").alias("corrections_applied"))
    recs = recommendations.filter("kind = 'exclude'").groupBy("report_id").agg(F.count(F.lit(1)).alias("exclude_recommended"))
    return _each_report(reports, base).join(fixed, "report_id", "left").join(recs, "report_id", "left").na.fill(0)


def section_status(filings: DataFrame, reports: DataFrame) -> DataFrame:
    """State of every section a user sees: error, filled or empty. The reliance section shows only where wanted, the
    unclassified one only where it has documents."""
    live = filings.filter("is_included")
    grid = _every_section(live, reports, [*SECTION_NAMES, fv.UNCLASSIFIED[0]])
    wanted = reports.select("report_id", "has_reliance_letter")
    state = F.when(F.col("errors") > 0, "error").when(F.col("all_docs") > 0, "filled").otherwise("empty")
    return (
        grid.join(wanted, "report_id")
        .filter((F.col("category") != "RELIANCE_LETTER") | F.col("has_reliance_letter"))
        .filter((F.col("category") != fv.UNCLASSIFIED[0]) | (F.col("all_docs") > 0))
        .select("report_id", "category", state.alias("state"), F.col("all_docs").alias("docs"))
    )
