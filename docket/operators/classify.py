"""Which section a filing belongs to: name rules, extension prefilter, model verdicts and how they are reconciled."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import metrics, names
from docket.functions.once import once
from docket.functions.rules import RULE_FIELDS, Rule, rule_columns, standard_rules
from docket.operators.search import match_rules
from docket.schema import known_section, section_alias

SURE = 0.85


def classify_by_name(
    df: DataFrame, rules: Sequence[Rule] | None = None, name: str = "original_filename", path: str = "original_path",
    size: str | None = None, prefix: str = "rule_",
) -> DataFrame:
    """Add the first matching rule's section, sub-group, confidence, sort order and reason; nulls when none matches.
    ``size`` lets real file sizes decide whether an appendix file is only a divider page."""
    return rule_columns(df, rules or standard_rules(), name, path, size, prefix)


def classify_by_table(
    df: DataFrame, rule_table: DataFrame, name: str = "original_filename", path: str = "original_path", size: str | None = None,
    prefix: str = "rule_",
) -> DataFrame:
    """The same with the rules of a table of any length, which stays a table: rules and names meet by the grams they share."""
    return match_rules(df, rule_table, name, path, size, prefix)


def prefilter(df: DataFrame, name: str = "original_filename") -> DataFrame:
    """Sections that follow from the extension alone."""
    ext = names.suffix(F.col(name))
    category = confidence = reason = F.lit(None)
    for exts, section, sure, why in fv.PREFILTER:
        hit = ext.isin(*exts)
        category = F.when(hit, section).otherwise(category)
        confidence = F.when(hit, F.lit(sure)).otherwise(confidence)
        reason = F.when(hit, why).otherwise(reason)
    return df.withColumns({"pre_category": category, "pre_confidence": confidence, "pre_reason": reason})


def classify_targets(filings: DataFrame, threshold: float = SURE) -> DataFrame:
    """Filings to classify again: unclassified, or placed with little confidence. A real section without a figure
    stays as it is."""
    return filings.filter((F.col("category") == fv.UNCLASSIFIED[0]) | (F.col("confidence") < threshold))


def parse_verdicts(verdicts: DataFrame) -> DataFrame:
    """Model answers to columns. Code fences are stripped. A failure gives no row: text that is not one JSON value as a whole,
    no known section, a confidence that is there but no number, a reasoning or sub-category of another kind than text. Only
    an absent confidence or reasoning takes its default; an absent or null sub-category is none."""
    raw = metrics.blank_trim(F.col("response_text"))
    bare = metrics.blank_trim(F.rtrim(F.regexp_replace(raw, r"```(?:json)?\s*", ""), F.lit("`")))
    text = F.when(raw.startswith("```"), bare).otherwise(raw)
    # In brackets, anything that follows the value makes the whole no JSON, and a second value a second place.
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    said = lambda key: F.try_variant_get("a", f"$[0].{key}", "string").alias(key)
    kind = lambda key: F.coalesce(F.schema_of_variant(F.variant_get("a", f"$[0].{key}", "variant")), F.lit("absent"))
    read = once(once(verdicts.select("doc_id", "response_text"), {"a": listed}), {
        **{key: said(key) for key in ("category", "subcategory", "confidence", "reasoning")},
        **{f"{key}_kind": kind(key) for key in ("category", "subcategory", "confidence", "reasoning")},
        "number": F.try_variant_get("a", "$[0].confidence", "double"),
        "more": F.variant_get("a", "$[1]", "variant").isNotNull(),
    })
    written = metrics.blank_trim(F.col("confidence")).try_cast("double")
    is_text = lambda key: F.col(f"{key}_kind") == "STRING"
    absent = lambda key: F.col(f"{key}_kind") == "absent"
    sure = F.when(absent("confidence"), F.lit(0.8)).when(is_text("confidence"), written).otherwise(F.col("number"))
    why = F.when(absent("reasoning"), "AI classification").when(is_text("reasoning"), F.col("reasoning"))
    fits = is_text("category") & known_section(F.col("category")) & F.col("subcategory_kind").isin("absent", "VOID", "STRING")
    out = read.filter(fits & ~F.col("more")).select(
        "doc_id",
        F.col("category").alias("ai_category"),
        F.col("subcategory").alias("ai_subcategory"),
        sure.alias("ai_confidence"),
        why.alias("ai_reasoning"),
    )
    return out.filter("ai_confidence IS NOT NULL AND ai_reasoning IS NOT NULL")


def _placed(df: DataFrame, keep: Sequence[str], **values) -> DataFrame:
    fields = ("category", "subcategory", "confidence", "reasoning", "from_model")
    return df.select(*keep, *[values[c].alias(c) for c in fields], "rule_sort_order")


def after_verdict(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """What follows a model's verdict, from ``evidence.first_page_facts``: an Appendix D verdict without sub-group takes the
    hint of the pages and says so; an Appendix E document that is a property profile is flagged, goes first and says so; a
    project number found on the first page goes into ``metadata`` with address and company. Other placements stay as they are."""
    df = placed.join(facts.withColumnRenamed("is_profile", "__profile"), "doc_id", "left")
    model = F.col("from_model")
    hinted = model & (F.col("category") == "APPENDIX_D") & (F.coalesce("subcategory", F.lit("")) == "") & F.col("hint").isNotNull()
    profile = model & (F.col("category") == "APPENDIX_E") & F.coalesce("__profile", F.lit(False))
    note = F.when(hinted, F.concat(F.lit(fv.HINT_NOTE[0]), F.col("hint"), F.lit(fv.HINT_NOTE[1]))).when(profile, fv.PROFILE_NOTE)
    found = [f"found_{c}" for c in ("project_id", "address", "company")]
    return df.withColumns(
        {
            "subcategory": F.when(hinted, F.col("hint")).otherwise(F.col("subcategory")),
            "reasoning": F.concat("reasoning", F.coalesce(note, F.lit(""))),
            "rule_sort_order": F.when(profile, 1).otherwise(F.col("rule_sort_order")),
            "is_profile": profile,
            "metadata": F.when(model & F.col(found[0]).isNotNull(), F.struct(*found)),
        }
    ).drop("hint", "__profile", *found)


def reconcile(filings: DataFrame, verdicts: DataFrame, note_at: float = SURE, keep: Sequence[str] = ("doc_id", "report_id")) -> DataFrame:
    """Model verdict checked against the name rule: without a verdict the rule stands in, marked as fallback; a sure
    rule that disagrees leaves a note."""
    df = prefilter(classify_by_name(filings)).join(parse_verdicts(verdicts), "doc_id", "left")
    pre, ai, rule = (F.col(f"{k}_category").isNotNull() for k in ("pre", "ai", "rule"))
    note = F.concat(
        F.col("ai_reasoning"), F.lit(" [NOTE: filename suggests "), F.col("rule_category"), F.lit(" — "), F.col("rule_reason"), F.lit("]")
    )
    disagrees = rule & (F.col("rule_confidence") >= note_at) & (F.col("rule_category") != F.col("ai_category"))
    fallback = F.concat(F.lit("[FALLBACK] "), F.col("rule_reason"), F.lit(" (AI classification unavailable)"))
    failed = "Classification failed: AI unavailable and no filename match"
    df = df.withColumn("rule_sort_order", F.when(~pre & ~ai, F.col("rule_sort_order")))
    return _placed(
        df,
        keep,
        category=F.when(pre, F.col("pre_category")).when(ai, F.col("ai_category"))
        .otherwise(F.coalesce("rule_category", F.lit(fv.UNCLASSIFIED[0]))),
        subcategory=F.when(pre, F.lit(None)).when(ai, F.col("ai_subcategory")).otherwise(F.col("rule_subcategory")),
        confidence=F.when(pre, F.col("pre_confidence")).when(ai, F.col("ai_confidence"))
        .otherwise(F.coalesce("rule_confidence", F.lit(0.0))),
        reasoning=F.when(pre, F.col("pre_reason")).when(ai, F.when(disagrees, note).otherwise(F.col("ai_reasoning")))
        .when(rule, fallback).otherwise(failed),
        from_model=~pre & ai,
    )


def by_rules_only(filings: DataFrame, keep: Sequence[str] = ("doc_id", "report_id")) -> DataFrame:
    return _placed(
        classify_by_name(filings),
        keep,
        category=F.coalesce("rule_category", F.lit(fv.UNCLASSIFIED[0])),
        subcategory=F.col("rule_subcategory"),
        confidence=F.coalesce("rule_confidence", F.lit(0.0)),
        reasoning=F.coalesce("rule_reason", F.lit("AI disabled and filename did not match any pattern")),
        from_model=F.lit(False),
    )


def needs_verdict(filings: DataFrame, policy: str, threshold: float = SURE) -> DataFrame:
    """The filings a policy sends to the model. Split off before any Python stage, since filters do not move across
    one."""
    if policy == "none":
        return filings.limit(0)
    if policy == "name-first":
        ruled = classify_by_name(filings)
        return ruled.filter(F.coalesce(F.col("rule_confidence") < threshold, F.lit(True))).select(*filings.columns)
    return prefilter(filings).filter("pre_category IS NULL").select(*filings.columns)


def route(
    filings: DataFrame, verdicts: DataFrame, policy: str = "content-first", threshold: float = SURE,
    keep: Sequence[str] = ("doc_id", "report_id"),
) -> DataFrame:
    """Place every filing under a policy: ``none`` (rules only), ``name-first`` (a sure rule spares the model) or
    ``content-first`` (the verdict leads)."""
    if policy == "none":
        return by_rules_only(filings, keep)
    if policy == "content-first":
        return reconcile(filings, verdicts, threshold, keep)
    if policy != "name-first":
        raise ValueError(f"unknown policy {policy!r}")
    df = classify_by_name(filings).join(parse_verdicts(verdicts), "doc_id", "left")
    use_ai = F.coalesce(F.col("rule_confidence") < threshold, F.lit(True)) & F.col("ai_category").isNotNull()
    df = df.withColumn("rule_sort_order", F.when(~use_ai, F.col("rule_sort_order")))
    return _placed(
        df,
        keep,
        category=F.when(use_ai, F.col("ai_category")).otherwise(F.coalesce("rule_category", F.lit(fv.UNCLASSIFIED[0]))),
        subcategory=F.when(use_ai, F.col("ai_subcategory")).otherwise(F.col("rule_subcategory")),
        confidence=F.when(use_ai, F.col("ai_confidence")).otherwise(F.coalesce("rule_confidence", F.lit(0.0))),
        reasoning=F.when(use_ai, F.col("ai_reasoning")).otherwise(F.coalesce("rule_reason", F.lit("Classification failed"))),
        from_model=use_ai,
    )


def model_verdicts(prompts: DataFrame, model: Callable[[pd.Series], pd.Series], tasks: int | None = None) -> DataFrame:
    """Run a user's model over prompt rows. As many calls are in flight as the session has task slots; a lost task repeats
    its own prompts only, so ``tasks`` (default: the session's shuffle partitions) may be large."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "response_text": model(batch["prompt"])})

    short = prompts.select("doc_id", "prompt")
    dealt = short.repartition(tasks, "doc_id") if tasks else short.repartition("doc_id")
    return dealt.mapInPandas(answer, "doc_id bigint, response_text string")


def resolve_alias(df: DataFrame, column: str) -> DataFrame:
    """Section meant by a friendly name; null for an unknown one."""
    dim = section_alias(df.sparkSession).withColumnRenamed("section", "alias_section")
    key = F.lower(metrics.blank_trim(F.col(column)))
    return df.withColumn("alias", key).join(F.broadcast(dim), "alias", "left").drop("alias")
