"""Whole jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.operators import assemble, classify, curate, evidence, summaries
from docket.session import stored


def place_by_name(filings: DataFrame) -> DataFrame:
    """Filings with the section their name and extension give."""
    placed = classify.prefilter(classify.classify_by_name(filings.drop("category", "subcategory", "confidence", "sort_order")))
    return placed.withColumns(
        {
            "category": F.coalesce("pre_category", "rule_category", F.lit("UNCLASSIFIED")),
            "subcategory": F.when(F.col("pre_category").isNull(), F.col("rule_subcategory")),
            "confidence": F.coalesce("pre_confidence", "rule_confidence", F.lit(0.0)),
            "sort_order": F.when(F.col("pre_category").isNull(), F.coalesce("rule_sort_order", F.lit(0))).otherwise(0),
        }
    ).select(*filings.columns)


def manifest_by_name(filings: DataFrame, reports: DataFrame) -> DataFrame:
    """For every report, the ordered page manifest of its files, placed by name."""
    return assemble.manifest(place_by_name(filings), reports, size=filings)


def curate_corpus(
    filings: DataFrame, doc_pages: DataFrame, verdicts: DataFrame, corrections: DataFrame, policy: str = "content-first"
) -> DataFrame:
    """From uploaded filings to a curated corpus: compiled reports out, sections from verdicts and name rules, what pages say
    after a verdict, preferences and revised files, newest versions, corrections. Filings in error or excluded keep what they
    have. Adds ``is_profile`` and ``metadata``.

    What pages and verdicts say is stored before the rules that compare files of a report, and again once revised files are out:
    every such rule joins figures of the filings back to them, and would else work the whole way from the pages out again."""
    fields = ("category", "subcategory", "confidence", "reasoning")
    start = evidence.exclude_compiled(filings, evidence.compiled_report(doc_pages, filings))
    start = start.withColumnsRenamed({c: f"old_{c}" for c in fields})
    placed = classify.route(start, verdicts, policy, keep=start.columns)
    read = classify.after_verdict(placed, evidence.first_page_facts(doc_pages))
    live = F.col("is_included") & (F.col("status") != "error")
    fresh = read.withColumn("live", live).withColumns(
        {
            **{c: F.when(F.col("live"), F.col(c)).otherwise(F.col(f"old_{c}")) for c in fields},
            "sort_order": F.when(F.col("live"), F.coalesce("rule_sort_order", "sort_order")).otherwise(F.col("sort_order")),
            "status": F.when(F.col("live"), "classified").otherwise(F.col("status")),
            "by_pages": F.col("live") & F.col("is_profile"),
            "metadata": F.when(F.col("live"), F.col("metadata")),
        }
    )
    fresh = stored(fresh)
    # Preferences belong to fresh classifications only; the rest keep their figures.
    preferred = curate.preference_columns(fresh, F.col("live")).withColumn("is_profile", F.col("is_profile") | F.col("by_pages"))
    superseded = stored(curate.supersede_revised(preferred.select(*filings.columns, "is_profile", "metadata")).drop("superseded"))
    return curate.apply_corrections(curate.dedupe_versions(superseded), corrections)


def curate_flags(curated: DataFrame, reports: DataFrame) -> DataFrame:
    """What to look at in a curated corpus: sections out of their usual range, with the health of each report."""
    flags = summaries.section_flags(curated, reports)
    return summaries.report_health(curated, reports).join(flags, "report_id", "left")
