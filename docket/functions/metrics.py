"""Column-level helpers for display values, bands and row states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket import fixed_values as fv

MANUAL_REASON = "Manually classified by user"
MB = 1024 * 1024


def pages_or_zero(page_count: Column) -> Column:
    return F.coalesce(page_count, F.lit(0)).cast("long")


def confidence_band(confidence: Column, reasoning: Column) -> Column:
    return (
        F.when((confidence == 1.0) & (reasoning == MANUAL_REASON), "manual")
        .when(confidence.isNull(), "none")
        .when(confidence >= 0.85, "high")
        .when(confidence >= 0.6, "medium")
        .otherwise("low")
    )


def confidence_label(confidence: Column, reasoning: Column) -> Column:
    percent = F.floor(confidence * 100 + 0.5).cast("string")
    return (
        F.when((confidence == 1.0) & (reasoning == MANUAL_REASON), "Manual")
        .when(confidence.isNull(), "?")
        .otherwise(F.concat(percent, F.lit("%")))
    )


def exclusion_group(reasoning: Column) -> Column:
    low = F.lower(F.coalesce(reasoning, F.lit("")))
    return (
        F.when(low.contains("compiled") | low.contains("appendix marker"), "compiled")
        .when(low.contains("superseded") | low.contains("newer version"), "superseded")
        .when(low.contains("manually"), "manual")
        .otherwise("other")
    )


def size_display(size: Column) -> Column:
    """B, KB or MB with one decimal; ties go to the even digit."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MB, F.format_string("%.1f KB", F.bround(size / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(size / float(MB), 1)))
    )


def reduction_pct(original: Column, compressed: Column) -> Column:
    return F.when(original > 0, F.bround((1 - compressed / original) * 100, 1)).otherwise(0.0)


def reason_short(reasoning: Column, width: int = 55) -> Column:
    return (
        F.when(F.coalesce(reasoning, F.lit("")) == "", "Not classified")
        .when(F.length(reasoning) > width, F.concat(F.substring(reasoning, 1, width - 3), F.lit("...")))
        .otherwise(reasoning)
    )


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds; null unless both ends are known."""
    return F.floor(end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")).cast("long")


def source_group(filename: Column, path: Column) -> Column:
    """Source of a supporting report, by name or folder."""
    name, folder = F.lower(filename), F.lower(F.coalesce(path, F.lit("")))
    out = F.lit(fv.OTHER_POSITION)
    for text, place in reversed(fv.SOURCE_GROUPS):
        out = F.when(name.contains(text) | folder.contains(text), place).otherwise(out)
    return out


def is_candidate(included: Column, status: Column) -> Column:
    """Included and far enough along to be assembled."""
    return F.coalesce(included, F.lit(False)) & status.isin("ready", "classified")


def blank_trim(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\u000b"))
