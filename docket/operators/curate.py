"""What stays in a report: versions, revisions, duplicates, corrections, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import metrics, names
from docket.operators.scan import group_figures, ordered_scan, top_per_group
from docket.schema import known_section

REVISED_NOTE = " [Superseded by revised version]"


def dedupe_versions(filings: DataFrame) -> DataFrame:
    """Keep the newest included version of every (report, base name); the others are excluded with a reason that names
    it. Newest is latest modified, unknown dates last, then lowest id."""
    keyed = filings.withColumn("__base", names.norm_basename(F.col("original_filename")))
    newest = F.max_by(
        F.when(F.col("is_included"), F.struct("doc_id", "original_filename")),
        F.when(F.col("is_included"), F.struct("modified_at", -F.col("doc_id"))),
    )
    old = F.coalesce(F.col("is_included") & (F.col("__newest.doc_id") != F.col("doc_id")), F.lit(False))
    reason = F.concat(F.lit("Superseded by newer version: "), F.col("__newest.original_filename"))
    return (
        group_figures(keyed, ["report_id", "__base"], {"__newest": newest})
        .withColumn("__old", old)
        .withColumns(
            {
                "is_included": F.col("is_included") & ~F.col("__old"),
                "reasoning": F.when(F.col("__old"), reason).otherwise(F.col("reasoning")),
            }
        )
        .select(*filings.columns)
    )


def supersede_revised(filings: DataFrame) -> DataFrame:
    """Exclude older files next to a revised one: same report, same name without revision marks, another stem. Whether
    such a revised file exists follows from the smallest and largest revised stem of the group, so no pairs are made."""
    low = F.lower(names.stem(F.col("original_filename")))
    df = filings.withColumns(
        {
            "__base": names.revision_base(F.col("original_filename")),
            "__stem": low,
            "__rev": names.is_revised(F.col("original_filename")),
            "__older": ~names.is_revised(low),
        }
    )
    live = F.col("is_included") & (F.col("status") != "error") & F.col("__rev") & (F.col("__base") != "")
    stems = F.when(live, F.col("__stem"))
    other = (F.col("__lo") != F.col("__stem")) | (F.col("__hi") != F.col("__stem"))
    hit = F.coalesce(F.col("is_included") & F.col("__older") & other, F.lit(False))
    return (
        group_figures(
            df, ["report_id", "__base"], {"__lo": F.min(stems), "__hi": F.max(stems)}
        )
        .withColumn("superseded", hit)
        .withColumns(
            {
                "is_included": F.col("is_included") & ~F.col("superseded"),
                "reasoning": F.when(
                    F.col("superseded"), F.concat(F.coalesce("reasoning", F.lit("")), F.lit(REVISED_NOTE))
                ).otherwise(F.col("reasoning")),
            }
        )
        .select(*filings.columns, "superseded")
    )


def preference_columns(df: DataFrame, fresh: Column | None = None) -> DataFrame:
    """Preferences of a fresh classification: revised files gain confidence and say so, marked ones lead Appendix D,
    property profiles are flagged. Rows where ``fresh`` is false keep their figures."""
    name, low = F.col("original_filename"), F.lower("original_filename")
    fresh = F.lit(True) if fresh is None else fresh
    revised = names.is_revised(name) & fresh
    start = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.8).otherwise(F.col("confidence"))
    profile = (F.col("category") == "APPENDIX_E") & low.rlike(fv.PROFILE_NAME) & fresh
    return df.withColumns(
        {
            "confidence": F.when(revised, F.least(F.lit(1.0), start + 0.05)).otherwise(F.col("confidence")),
            "reasoning": F.when(
                revised, F.concat(F.lit("[PREFERRED: revised version] "), F.coalesce("reasoning", F.lit("")))
            ).otherwise(F.col("reasoning")),
            "sort_order": F.when(names.is_marked(name) & (F.col("category") == "APPENDIX_D") & fresh, 0)
            .when(profile, 1)
            .otherwise(F.col("sort_order")),
            "is_profile": profile,
        }
    )


def preference_rules(filings: DataFrame) -> DataFrame:
    return supersede_revised(preference_columns(filings))


def remove_duplicates(filings: DataFrame) -> DataFrame:
    """Keep the earliest filing of each name in a report. The kept ids are unique, so the semi join has no hot key."""
    first = filings.groupBy("report_id", "original_filename").agg(F.min("doc_id").alias("doc_id"))
    return filings.join(first.select("doc_id"), "doc_id", "left_semi")


def duplicate_counts(filings: DataFrame) -> DataFrame:
    sizes = filings.groupBy("report_id", "original_filename").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("report_id").agg(F.sum(F.col("n") - 1).alias("removed"), F.count(F.lit(1)).alias("remaining"))


def _correction_steps(filings: DataFrame, corrections: DataFrame, guard: float, group_rows: int | None) -> DataFrame:
    """Corrections that may act, each with the section its document has just before."""
    open_ = filings.filter(F.col("is_included") & (F.coalesce("confidence", F.lit(0.0)) < guard)).select(
        "report_id", "doc_id", "category"
    )
    usable = corrections.filter(
        known_section(F.col("suggested_section")) & (F.col("suggested_section") != "COVER_WRITEUP")
    ).join(open_, ["report_id", "doc_id"])
    steps = ordered_scan(
        usable, ["report_id", "doc_id"], ["seq"], lags={"prev": F.col("suggested_section")}, group_rows=group_rows,
        size=corrections,
    )
    return steps.withColumn("applied", F.col("suggested_section") != F.coalesce("prev", "category"))


def apply_corrections(
    filings: DataFrame, corrections: DataFrame, guard: float = 0.90, group_rows: int | None = None
) -> DataFrame:
    """Apply section corrections in order. Guards: known document of the report, known section, not the cover, not the
    section it already has, and no document that was placed with confidence. A correction sees what the ones before it
    did: since an applied one leaves the target as the section, that is simply the correction before it."""
    steps = _correction_steps(filings, corrections, guard, group_rows)
    last = (
        steps.filter("applied")
        .groupBy("report_id", "doc_id")
        .agg(
            F.max_by(F.struct("suggested_section", "reason"), "seq").alias("c"), F.count(F.lit(1)).alias("n_applied")
        )
    )
    hit = F.col("c").isNotNull()
    return (
        filings.join(last, ["report_id", "doc_id"], "left")
        .withColumns(
            {
                "category": F.when(hit, F.col("c.suggested_section")).otherwise(F.col("category")),
                "reasoning": F.when(hit, F.concat(F.lit("AI validator: "), F.coalesce("c.reason", F.lit("")))).otherwise(
                    F.col("reasoning")
                ),
                "confidence": F.when(hit, F.lit(0.85)).otherwise(F.col("confidence")),
                "n_applied": F.coalesce("n_applied", F.lit(0).cast("long")),
            }
        )
        .select(*filings.columns, "n_applied")
    )


def _noted(kind: str, text: Column, recs: DataFrame) -> DataFrame:
    """The notes of one kind, joined per document in order of their text."""
    return (
        recs.filter(F.col("kind") == kind)
        .groupBy("report_id", "doc_id")
        .agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias(f"{kind}_note"))
    )


def record_recommendations(filings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Write recommendations into the reasoning of included documents, without acting on them."""
    why = F.coalesce("reason", F.lit(""))
    out = F.concat(F.lit(" [DIRECTOR: recommend exclude — "), why, F.lit("]"))
    move = F.concat(F.lit(" [DIRECTOR: suggest "), F.coalesce("suggested", F.lit("?")), F.lit(" — "), why, F.lit("]"))
    df = filings
    for kind, text in (("exclude", out), ("reclassify", move)):
        df = df.join(_noted(kind, text, recommendations), ["report_id", "doc_id"], "left")
    notes = F.concat(F.coalesce("exclude_note", F.lit("")), F.coalesce("reclassify_note", F.lit("")))
    return df.withColumn(
        "reasoning",
        F.when(F.col("is_included") & (notes != ""), F.concat(F.coalesce("reasoning", F.lit("")), notes)).otherwise(
            F.col("reasoning")
        ),
    ).drop("exclude_note", "reclassify_note")


def apply_recommendations(filings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Exclude every included document with an exclude recommendation."""
    flagged = (
        recommendations.filter("kind = 'exclude'").select("report_id", "doc_id").distinct().withColumn("__out", F.lit(True))
    )
    return (
        filings.join(flagged, ["report_id", "doc_id"], "left")
        .withColumn("is_included", F.col("is_included") & F.col("__out").isNull())
        .drop("__out")
    )


def report_class(name: Column) -> Column:
    out = F.lit("other")
    for label, pattern in reversed(fv.KEY_REPORT_CLASSES):
        out = F.when(F.lower(name).rlike(names.py(pattern)), label).otherwise(out)
    return out


def curate_after_e(filings: DataFrame, max_pages: int = 500, keep: int = 10) -> DataFrame:
    """Recommend supporting reports for exclusion where a report holds more than ``max_pages`` pages of them. Kept are
    the most recent monitoring report, then closure letters, tank removals and initial studies, ``keep`` at most. Only
    ``keep`` rows per report leave a map task."""
    after = filings.filter("is_included AND category = 'REPORTS_AFTER_E'")
    over = (
        after.groupBy("report_id")
        .agg(F.sum(metrics.pages_or_zero(F.col("page_count"))).alias("section_pages"))
        .filter(F.col("section_pages") > max_pages)
    )
    classed = after.select(
        "report_id", "doc_id", "original_filename", "page_count", "modified_at",
        report_class(F.col("original_filename")).alias("report_class"),
    ).withColumn("page_count", metrics.pages_or_zero(F.col("page_count")))
    scope = classed.join(over.select("report_id"), "report_id", "left_semi")
    # Newest monitoring report of each report, by name-independent date.
    rank = {label: i for i, (label, _) in enumerate(fv.KEY_REPORT_CLASSES)}
    newest = scope.filter("report_class = 'monitoring'").groupBy("report_id").agg(
        F.max_by("doc_id", F.struct("modified_at", -F.col("doc_id"))).alias("doc_id")
    )
    key = scope.filter("report_class IN ('closure', 'tank_removal', 'initial')").unionByName(
        scope.join(newest.select("doc_id"), "doc_id", "left_semi").select(*scope.columns)
    )
    place = F.array_position(F.array(*[F.lit(x) for x in rank]), F.col("report_class"))
    # The newest monitoring report comes first so that a crowd of key reports cannot push it out.
    order = [F.when(F.col("report_class") == "monitoring", 0).otherwise(place), F.col("doc_id")]
    kept = top_per_group(key, ["report_id"], order, keep).select("doc_id")
    return scope.join(kept, "doc_id", "left_anti").select(
        "report_id", "doc_id", "report_class", "page_count",
        F.lit("exclude").alias("kind"), F.lit(None).cast("string").alias("suggested"),
        F.concat(F.lit("Over "), F.lit(max_pages), F.lit(" pages of supporting reports: not among the key reports")).alias("reason"),
    )


def section_head(filings: DataFrame, full: int = 10, head: int = 5, after_e: int | None = None) -> DataFrame:
    """A short listing per section: all rows of a small one, else the first ``head`` and one row for the rest. With
    ``after_e`` the sections show their first ``full`` rows instead, supporting reports that many. The rest is total
    minus head, so no window runs over a whole section."""
    key = ["report_id", "category"]
    live = filings.filter("is_included").withColumn("page_count", metrics.pages_or_zero(F.col("page_count")))
    slim = live.select(*key, "doc_id", "original_filename", "page_count", "sort_order")
    totals = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("page_count").alias("pages"))
    shown = top_per_group(slim, key, ["sort_order", "doc_id"], max(full, after_e or 0)).join(totals, key)
    if after_e is None:
        shown = shown.filter((F.col("n") <= full) | (F.col("rank") <= head))
    else:
        shown = shown.filter(F.col("rank") <= F.when(F.col("category") == "REPORTS_AFTER_E", after_e).otherwise(full))
    counted = shown.groupBy(*key).agg(F.count(F.lit(1)).alias("n_shown"), F.sum("page_count").alias("pages_shown"))
    rest = totals.join(counted, key).filter("n > n_shown").select(
        *key,
        (F.col("n_shown") + 1).cast("int").alias("rank"),
        F.lit(None).cast("long").alias("doc_id"),
        F.concat(F.lit("("), (F.col("n") - F.col("n_shown")).cast("string"), F.lit(" more similar files)")).alias("original_filename"),
        (F.col("pages") - F.col("pages_shown")).alias("page_count"),
    )
    return shown.select(*key, "rank", "doc_id", "original_filename", "page_count").unionByName(rest)
