"""Every operator as a query over the given tables: name -> function of (session, data folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.functions import metrics, names
from docket.functions.rules import RULE_SCHEMA, standard_rules
from docket.operators import actions as act
from docket.operators import assemble, classify, curate, edits, evidence, excerpt, ingest, search, split, summaries
from docket.plans import curate as plans
from docket.schema import MANIFEST_JSON
from docket.session import scratch_dir
from docket.sources.corpus import Corpus
from docket.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATE = ["doc_id", "category", "confidence", "reasoning", "sort_order", "is_included"]


def query(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Corpus(spark, sf_dir))
    return build


def heavy(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """A query that runs many patterns per filing."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Corpus(spark, sf_dir, spread=True))
    return build


def _text(column: str, sep: str = " | "):
    return F.array_join(column, sep).alias(column)


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query
def ingest_eligible(c: Corpus) -> DataFrame:
    return ingest.eligible(c.filings.drop("ext")).select("doc_id", "original_filename", "ext")


@heavy
def ingest_upsert(c: Corpus) -> DataFrame:
    name = F.when(F.col("is_included"), F.col("original_filename")).otherwise(F.concat(F.lit("new "), F.col("original_filename")))
    batch = c.filings.select(
        (F.col("doc_id") + 1_000_000_000).alias("doc_id"), "report_id", F.col("doc_id").alias("seq"),
        name.alias("original_filename"), "original_path", (F.col("file_size") * 2).alias("file_size"), "modified_at",
    )
    return ingest.upsert_filings(c.filings, batch)


@query
def conversion_plan(c: Corpus) -> DataFrame:
    return ingest.conversion_plan(c.filings).select("doc_id", "ext", "converter", "next_step")


@query
def paginate(c: Corpus) -> DataFrame:
    return excerpt.paginate(c.documents).select("doc_id", "page_no", "txt")


@query
def page_count(c: Corpus) -> DataFrame:
    return ingest.page_counts(c.doc_pages, c.filings)


@query
def paragraphs(c: Corpus) -> DataFrame:
    spaced = c.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return excerpt.paragraphs(spaced)


@query
def output_name(c: Corpus) -> DataFrame:
    return ingest.output_name(c.reports).select("report_id", "output_name")


@query
def manifest_json(c: Corpus) -> DataFrame:
    """Manifest entries written to JSON text and read back."""
    fields = ["doc_id", "filename", "category", "subcategory", "start_page", "end_page", "page_count"]
    rows = assemble.manifest(c.filings, c.reports)
    listed = ingest.to_json_col(rows, "entry", fields).withColumn("manifest_json", F.concat(F.lit("["), "entry", F.lit("]")))
    back = ingest.from_json_col(listed.select("report_id", "pos", "manifest_json"), "manifest_json", MANIFEST_JSON)
    return back.select("report_id", "pos", F.inline("manifest_json"))


@query
def retry_errors(c: Corpus) -> DataFrame:
    queue = ingest.retry_queue(c.filings, c.given("labels"))
    done = ingest.conversion_plan(queue).filter("next_step = 'convert'").select("doc_id", F.lit(3).alias("pages"))
    return ingest.retry_summary(c.filings, done)


# --- classification --------------------------------------------------------------------------------------------------

RULED = ["doc_id", "rule_category", "rule_subcategory", "rule_confidence", "rule_sort_order", "rule_reason"]


@heavy
def classify_filename(c: Corpus) -> DataFrame:
    return classify.classify_by_name(c.filings).select(*RULED)


@heavy
def classify_filename_join(c: Corpus) -> DataFrame:
    table = c.spark.createDataFrame(standard_rules(), RULE_SCHEMA)
    return classify.classify_by_table(c.filings, table, size="file_size").select(*RULED)


@query
def classify_prefilter(c: Corpus) -> DataFrame:
    return classify.prefilter(c.filings).select("doc_id", "pre_category", "pre_confidence", "pre_reason")


@query
def classify_targets(c: Corpus) -> DataFrame:
    return classify.classify_targets(c.filings).select("doc_id", "category", "confidence")


@query
def parse_verdicts(c: Corpus) -> DataFrame:
    return classify.parse_verdicts(c.verdicts)


@heavy
def reconcile(c: Corpus) -> DataFrame:
    return classify.reconcile(c.filings, c.verdicts).drop("report_id", "from_model")


@heavy
def route_policy(c: Corpus) -> DataFrame:
    """All three policies side by side."""
    out = None
    for policy in ("none", "name-first", "content-first"):
        placed = classify.route(c.filings, c.verdicts, policy, keep=("doc_id",)).select(
            F.lit(policy).alias("policy"), "doc_id", "category", "confidence"
        )
        out = placed if out is None else out.unionByName(placed)
    return out


@query
def score_sections(c: Corpus) -> DataFrame:
    return evidence.score_sections(excerpt.smart_excerpt(c.doc_pages))


@query
def ordering_hint(c: Corpus) -> DataFrame:
    return evidence.ordering_hint(c.doc_pages, c.filings)


@query
def property_profile(c: Corpus) -> DataFrame:
    return evidence.property_profile(c.doc_pages, c.filings)


@query
def extract_identity(c: Corpus) -> DataFrame:
    return evidence.extract_identity(excerpt.header_footer(c.doc_pages, 1000))


@query
def contamination(c: Corpus) -> DataFrame:
    found = evidence.extract_identity(excerpt.header_footer(c.doc_pages, 1000))
    return evidence.contamination(found, c.filings, c.reports)


@query
def compiled_report(c: Corpus) -> DataFrame:
    return evidence.compiled_report(c.doc_pages, c.filings)


@query
def auto_name(c: Corpus) -> DataFrame:
    return evidence.auto_name(c.reports, c.filings, c.doc_pages)


@query
def section_alias(c: Corpus) -> DataFrame:
    words = c.filings.select("doc_id", F.regexp_extract("original_filename", "^([A-Za-z]+)", 1).alias("word"))
    return classify.resolve_alias(words, "word").select("doc_id", "word", "alias_section")


# --- page text -------------------------------------------------------------------------------------------------------


@query
def excerpt_first(c: Corpus) -> DataFrame:
    return excerpt.excerpt_first(c.doc_pages, 5, 700)


@query
def excerpt_last(c: Corpus) -> DataFrame:
    return excerpt.excerpt_last(c.doc_pages, 3, 500)


@query
def header_footer(c: Corpus) -> DataFrame:
    return excerpt.header_footer(c.doc_pages)


@query
def smart_excerpt(c: Corpus) -> DataFrame:
    return excerpt.smart_excerpt(c.doc_pages)


@query
def page_sample(c: Corpus) -> DataFrame:
    return excerpt.page_sample(c.doc_pages).select("doc_id", "page_no", "part")


@query
def text_source(c: Corpus) -> DataFrame:
    return excerpt.choose_text(c.doc_pages).select("doc_id", "page_no", "text_source", F.length("best_txt").alias("n_chars"))


@query
def strip_blank_tail(c: Corpus) -> DataFrame:
    return excerpt.strip_blank_tail(c.doc_pages, c.filings).select("doc_id", "page_no")


@query
def prompt_rows(c: Corpus) -> DataFrame:
    return excerpt.prompt_rows(c.filings, excerpt.smart_excerpt(c.doc_pages))


@query
def html_blocks(c: Corpus) -> DataFrame:
    return excerpt.html_blocks(c.given("pages"))


@query
def delete_pages(c: Corpus) -> DataFrame:
    """Every document loses its page 1, and a page it does not have."""
    asked = c.given("documents").select("doc_id", F.array(F.lit(1), F.lit(100_000_000)).alias("pages"))
    return excerpt.delete_pages(c.doc_pages, asked).select("doc_id", "page_no", "new_page_no")


@query
def delete_many_pages(c: Corpus) -> DataFrame:
    """Every third document loses two of three pages, another third its even ones."""
    page, doc = F.col("page_no"), F.col("doc_id") % 3
    lost = c.doc_pages.filter(((doc == 0) & (page % 3 != 1)) | ((doc == 1) & (page % 2 == 0)))
    asked = lost.groupBy("doc_id").agg(F.collect_list("page_no").alias("pages"))
    return excerpt.delete_pages(c.doc_pages, asked).select("doc_id", "page_no", "new_page_no")


def _paragraph_table(c: Corpus) -> DataFrame:
    """Lines of the documents as styled paragraphs of two runs: first word and the rest."""
    lines = F.split("text", "\n", -1)
    style = lambda i: F.when(i % 3 == 0, "Heading 2").when(i % 3 == 1, "Normal").otherwise("Heading")
    run = lambda t, b: F.struct(t.alias("text"), F.lit(b).alias("bold"), F.lit(None).cast("boolean").alias("italic"))

    def para(line, i):
        first = F.regexp_extract(line, r"^(\S*)", 1)
        runs = F.array(run(first, True), run(F.substr(line, F.length(first) + 1), False))
        return F.struct(line.alias("text"), style(i).alias("style"), runs.alias("runs"))

    return c.documents.select("doc_id", "lang", "source", F.transform(lines, para).alias("paras"))


def _flat_runs(df: DataFrame) -> DataFrame:
    per = F.transform("paras", lambda p: F.array_join(F.transform(p.runs, lambda r: F.concat(r.text, F.when(r.bold, "*").otherwise(""))), "/"))
    return df.withColumn("runs_text", F.array_join(per, "\n"))


@query
def blocks_to_html(c: Corpus) -> DataFrame:
    paras = _paragraph_table(c).withColumn("tables", F.array(F.array(F.array("lang", "source"), F.array(F.col("doc_id").cast("string")))))
    return edits.blocks_to_html(paras).select("doc_id", "html")


@query
def text_replace(c: Corpus) -> DataFrame:
    return _flat_runs(edits.text_replace(_paragraph_table(c), "en", "EN")).select("doc_id", "replacements", "runs_text")


@query
def rewrite_runs(c: Corpus) -> DataFrame:
    """Even paragraphs get two new runs, odd ones a single run with another text."""
    two = lambda p: F.transform(p.runs, lambda r: F.struct(F.concat(F.lit("<"), r.text, F.lit(">")).alias("text"), F.lit(None).cast("boolean").alias("bold"), r.italic.alias("italic")))
    one = lambda p: F.slice(p.runs, 1, 1)
    edit = lambda p, i: F.struct(F.concat(F.lit("new "), p.text).alias("text"), F.when(i % 2 == 0, two(p)).otherwise(one(p)).alias("runs"))
    df = _paragraph_table(c).withColumn("edits", F.transform("paras", edit))
    return _flat_runs(edits.rewrite_runs(df)).select("doc_id", "runs_text")


# --- scalars ---------------------------------------------------------------------------------------------------------


@query
def path_parts(c: Corpus) -> DataFrame:
    name = F.col("original_filename")
    return c.filings.select(
        "doc_id", names.suffix(name).alias("ext"), names.stem(name).alias("stem"), (names.suffix(name) == ".docx").alias("has_docx_source")
    )


@heavy
def norm_basename(c: Corpus) -> DataFrame:
    return c.filings.select("doc_id", names.norm_basename(F.col("original_filename")).alias("base_name"))


@query
def revision_flags(c: Corpus) -> DataFrame:
    name = F.col("original_filename")
    return c.filings.select(
        "doc_id", names.is_revised(name).alias("is_revised"), names.is_marked(name).alias("is_marked"),
        names.revision_base(name).alias("revision_base"),
    )


@query
def confidence_band(c: Corpus) -> DataFrame:
    conf, why = F.col("confidence"), F.col("reasoning")
    return c.filings.select(
        "doc_id", metrics.confidence_band(conf, why).alias("band"), metrics.confidence_label(conf, why).alias("label")
    )


@query
def size_display(c: Corpus) -> DataFrame:
    return c.given("documents").select(
        "doc_id", metrics.size_display(F.col("n_chars")).alias("small"), metrics.size_display(F.col("n_chars") * 4096).alias("large")
    )


@query
def reason_short(c: Corpus) -> DataFrame:
    return c.filings.select("doc_id", metrics.reason_short(F.col("reasoning")).alias("reason"))


@query
def search_filename(c: Corpus) -> DataFrame:
    asked = act.latest_action(c.actions).join(
        c.actions.select("report_id", "seq", F.col("params.query").alias("query")), ["report_id", "seq"]
    ).select("report_id", "query")
    return act.search_filename(c.filings, asked)


@query
def search_names(c: Corpus) -> DataFrame:
    """Every command's search within its report, and their beginnings of one to four characters over all reports."""
    own = c.actions.select(F.struct("report_id", "seq").cast("string").alias("query_id"), "report_id", F.col("params.query").alias("query"))
    short = own.select(F.explode(F.array(*[F.substring("query", 1, n) for n in (1, 2, 3, 4)])).alias("query")).distinct()
    everywhere = short.filter("query <> ''").select(F.concat(F.lit("all "), "query").alias("query_id"), F.lit(None).cast("long").alias("report_id"), "query")
    found = search.search_names(c.filings, own.union(everywhere))
    return found.withColumn("everywhere", F.col("query_id").startswith("all ")).select("everywhere", "query", "report_id", "doc_id", "original_filename")


@query
def run_duration(c: Corpus) -> DataFrame:
    return summaries.run_duration(c.reports)


@query
def assembly_candidates(c: Corpus) -> DataFrame:
    return assemble.assembly_candidates(c.filings).select("report_id", "doc_id")


@query
def section_status(c: Corpus) -> DataFrame:
    return summaries.section_status(c.filings, c.reports)


# --- joins -----------------------------------------------------------------------------------------------------------


@heavy
def supersede_revised(c: Corpus) -> DataFrame:
    return curate.supersede_revised(c.filings).select("doc_id", "superseded", "is_included", "reasoning")


@query
def page_lookup(c: Corpus) -> DataFrame:
    """Every document asks for the page its id points at, spread over the report."""
    rows = assemble.manifest(c.filings, c.reports)
    refs = c.filings.select("report_id", F.col("doc_id").alias("ref_id"), (F.col("doc_id") * 17 % 5003 + 1).alias("page"))
    return assemble.page_lookup(rows, refs).select("report_id", "ref_id", "page", "doc_id", "start_page")


@query
def cascade_delete(c: Corpus) -> DataFrame:
    return ingest.cascade_delete(c.filings, c.reports.filter("status = 'done'")).select("report_id", "doc_id")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query
def section_summary(c: Corpus) -> DataFrame:
    return summaries.section_summary(c.filings)


@query
def section_rollup(c: Corpus) -> DataFrame:
    return summaries.section_rollup(c.filings)


@query
def report_info(c: Corpus) -> DataFrame:
    return summaries.report_info(c.filings, c.reports)


@query
def processing_status(c: Corpus) -> DataFrame:
    return summaries.processing_status(c.filings, c.reports)


@query
def preflight(c: Corpus) -> DataFrame:
    return summaries.preflight(c.filings, c.reports).withColumns({k: F.array_join(k, " | ") for k in ("errors", "warnings")})


@query
def section_flags(c: Corpus) -> DataFrame:
    return summaries.section_flags(c.filings, c.reports)


@query
def report_health(c: Corpus) -> DataFrame:
    return summaries.report_health(c.filings, c.reports)


@query
def remove_duplicates(c: Corpus) -> DataFrame:
    return curate.remove_duplicates(c.filings).select("report_id", "doc_id", "original_filename")


@query
def duplicate_counts(c: Corpus) -> DataFrame:
    return curate.duplicate_counts(c.filings)


@query
def page_reconcile(c: Corpus) -> DataFrame:
    return assemble.page_reconcile(c.filings, assemble.manifest(c.filings, c.reports, c.doc_pages))


@query
def action_footprint(c: Corpus) -> DataFrame:
    return act.action_footprint(c.actions)


@query
def suggestions(c: Corpus) -> DataFrame:
    return summaries.suggestions(c.reports, c.filings).select("report_id", _text("suggestions"))


@query
def exclusion_groups(c: Corpus) -> DataFrame:
    return summaries.exclusion_groups(c.filings)


@query
def confidence_bands(c: Corpus) -> DataFrame:
    return summaries.confidence_bands(c.filings)


@query
def curation_effect(c: Corpus) -> DataFrame:
    return summaries.curation_effect(c.filings, c.reports, c.recommendations)


@query
def report_list(c: Corpus) -> DataFrame:
    return summaries.report_list(c.reports, c.filings).select("report_id", "name", "status", "document_count")


@query
def ready_to_assemble(c: Corpus) -> DataFrame:
    return summaries.ready_to_assemble(c.reports, c.filings)


@query
def section_pages(c: Corpus) -> DataFrame:
    return assemble.section_pages(assemble.manifest(c.filings, c.reports))


@query
def run_summary(c: Corpus) -> DataFrame:
    return summaries.run_summary(c.filings, c.reports, curate.apply_corrections(c.filings, c.corrections), c.recommendations)


# --- order, manifest, windows ----------------------------------------------------------------------------------------


@query
def assembly_order(c: Corpus) -> DataFrame:
    return assemble.assembly_order(c.filings, c.reports).select("report_id", "pos", "doc_id", "category")


@query
def assembly_order_strict(c: Corpus) -> DataFrame:
    return assemble.assembly_order(c.filings, c.reports, strict=True).select("report_id", "pos", "doc_id", "category")


@query
def assembly_order_natural(c: Corpus) -> DataFrame:
    placed = assemble.assembly_order(c.filings, c.reports, natural=True)
    return placed.select("report_id", "pos", "doc_id", F.col("sort_name.name").alias("sort_name"))


@query
def natural_names(c: Corpus) -> DataFrame:
    """The order of names that hold two numbers, one of them behind zeros."""
    second = F.concat(F.lit(" ("), (F.col("doc_id") * 7 % 23).cast("string"), F.lit(")"))
    named = c.filings.withColumn("original_filename", F.concat(F.regexp_replace("original_filename", "[0-9]{4}", "00"), second))
    placed = assemble.assembly_order(named, c.reports, natural=True)
    return placed.select("report_id", "pos", "doc_id", F.col("sort_name.name").alias("sort_name"))


@query
def omitted(c: Corpus) -> DataFrame:
    return assemble.omitted(c.filings, c.reports).select("report_id", "doc_id", "omitted_because")


@heavy
def manifest(c: Corpus) -> DataFrame:
    """The flagship: files placed by name, ordered, and laid out in pages, for every report at once."""
    return plans.manifest_by_name(c.filings, c.reports)


@query
def assembled_pages(c: Corpus) -> DataFrame:
    return assemble.assembled_pages(assemble.manifest(c.filings, c.reports, c.doc_pages), c.doc_pages)


@heavy
def dedupe_versions(c: Corpus) -> DataFrame:
    return curate.dedupe_versions(c.filings).select("doc_id", "is_included", "reasoning")


@query
def section_head(c: Corpus) -> DataFrame:
    return curate.section_head(c.filings)


@query
def section_listing(c: Corpus) -> DataFrame:
    return curate.section_head(c.filings, after_e=15)


@query
def progress_running(c: Corpus) -> DataFrame:
    return progress.progress_running(c.progress_events).select("report_id", "event_id", "current", "total")


@query
def latest_action(c: Corpus) -> DataFrame:
    return act.latest_action(c.actions)


@query
def select_range(c: Corpus) -> DataFrame:
    """Every document starts a selection that ends at the document six ids earlier; the last of a report counts."""
    anchors = c.filings.filter("is_included").select(
        "report_id", F.col("doc_id").alias("seq"), F.col("doc_id").alias("from_id"), (F.col("doc_id") - 6).alias("to_id")
    )
    return assemble.select_range(c.filings, anchors)


@query
def reorder_section(c: Corpus) -> DataFrame:
    asked = c.actions.select("report_id", "seq", F.col("params.target_section").alias("category"), "params.doc_ids").filter(
        F.col("category") != "NOWHERE"
    )
    return act.reorder_section(c.filings, asked).select("doc_id", "category", "sort_order")


@query
def move_in_section(c: Corpus) -> DataFrame:
    """In every section, the document with the highest id goes up or down one place, or is dropped onto the lowest id of its
    section or of its report."""
    ends = c.filings.filter("is_included").groupBy("report_id", "category").agg(
        F.max("doc_id").alias("doc_id"), F.min("doc_id").alias("over_id")
    )
    lowest = F.min("over_id").over(Window.partitionBy("report_id"))
    ends = ends.withColumn("over_id", F.when(F.col("doc_id") % 6 == 5, lowest).otherwise(F.col("over_id")))
    kind = F.when(F.col("doc_id") % 3 == 0, "up").when(F.col("doc_id") % 3 == 1, "down").otherwise("to")
    return assemble.move_in_section(c.filings, ends.select("report_id", "doc_id", kind.alias("kind"), "over_id"))


@query
def move_log(c: Corpus) -> DataFrame:
    """In every section: every document with an odd id goes up one place, in the order of their ids, then those that 3 divides go
    down, and at last the lowest id is dropped onto the highest."""
    shown = c.filings.filter("is_included").select("report_id", "category", "doc_id")
    none = F.lit(None).cast("long")
    up = shown.filter("doc_id % 2 = 1").select("report_id", F.col("doc_id").alias("seq"), "doc_id", F.lit("up").alias("kind"), none.alias("over_id"))
    later = F.col("doc_id") + 10_000_000_000
    down = shown.filter("doc_id % 3 = 0").select("report_id", later.alias("seq"), "doc_id", F.lit("down").alias("kind"), none.alias("over_id"))
    ends = shown.groupBy("report_id", "category").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("over_id"))
    last = ends.select("report_id", (F.col("doc_id") + 20_000_000_000).alias("seq"), "doc_id", F.lit("to").alias("kind"), "over_id")
    return assemble.move_log(c.filings, up.union(down).union(last))


@heavy
def curate_after_e(c: Corpus) -> DataFrame:
    return curate.curate_after_e(c.filings, max_pages=50).select("report_id", "doc_id", "report_class", "reason")


@query
def manifest_neighbours(c: Corpus) -> DataFrame:
    return assemble.manifest_neighbours(assemble.manifest(c.filings, c.reports)).select(
        "report_id", "pos", "doc_id", "prev_start", "next_start"
    )


@query
def document_list(c: Corpus) -> DataFrame:
    return assemble.document_list(c.filings).select("report_id", "category", "sort_order", "doc_id")


@query
def display_order(c: Corpus) -> DataFrame:
    return assemble.display_order(c.filings).select("report_id", "category", "doc_id", "place")


@query
def chat_history(c: Corpus) -> DataFrame:
    return assemble.chat_history(c.given("conversations")).select("conv_id", "turn", "role", "text")


@query
def selection_ops(c: Corpus) -> DataFrame:
    """Selected: included documents. Named: documents with a label."""
    labelled = c.filings.join(c.given("labels").select("doc_id"), "doc_id", "left_semi")
    return act.selection_ops(c.filings.filter("is_included"), labelled)


# --- corrections, commands, undo -------------------------------------------------------------------------------------


@query
def apply_corrections(c: Corpus) -> DataFrame:
    return curate.apply_corrections(c.filings, c.corrections).select("doc_id", "category", "confidence", "reasoning", "n_applied")


@heavy
def preference_rules(c: Corpus) -> DataFrame:
    return curate.preference_rules(c.filings).select(*STATE, "is_profile")


@query
def record_recommendations(c: Corpus) -> DataFrame:
    return curate.record_recommendations(c.filings, c.recommendations).select("doc_id", "reasoning")


@query
def apply_recommendations(c: Corpus) -> DataFrame:
    return curate.apply_recommendations(c.filings, c.recommendations).select("doc_id", "is_included")


@query
def apply_actions(c: Corpus) -> DataFrame:
    return act.apply_actions(c.filings, c.actions).select(*STATE)


@query
def actions_from_json(c: Corpus) -> DataFrame:
    """Command lists of messages, as rows."""
    read = act.read_actions(c.messages)
    return read.select(
        "report_id", "seq", "action_no", "action", F.array_join(F.col("params.doc_ids").cast("array<string>"), ",").alias("doc_ids"),
        "params.target_section", "params.reason",
    )


@heavy
def gated_actions(c: Corpus) -> DataFrame:
    """State after all messages that need no confirmation."""
    return act.apply_messages(c.filings, c.messages).select(*STATE)


@query
def message_footprint(c: Corpus) -> DataFrame:
    return act.message_footprint(act.read_actions(c.messages))


@query
def action_results(c: Corpus) -> DataFrame:
    return act.action_results(c.filings, c.actions)


@query
def action_snapshots(c: Corpus) -> DataFrame:
    return act.action_snapshots(c.filings, c.actions).drop("subcategory", "sort_order")


@query
def undo_pairs(c: Corpus) -> DataFrame:
    return act.undo_pairs(c.actions)


@query
def undo_fold(c: Corpus) -> DataFrame:
    return act.undo_fold(c.filings, c.actions).select(*STATE)


@query
def batch_update(c: Corpus) -> DataFrame:
    target = F.col("params.target_section")
    asked = c.actions.select(
        "report_id", "seq", "params.doc_ids", F.when(target != "NOWHERE", target).alias("category"),
        F.when(F.col("action") == "exclude", False).when(F.col("action") == "include", True).alias("is_included"),
    )
    return act.batch_update(c.filings, asked).select(*STATE)


@query
def manual_update(c: Corpus) -> DataFrame:
    asked = c.requests.select(
        "report_id", "doc_id", F.col("target").alias("new_category"),
        F.when(F.col("target") == "APPENDIX_D", "topos").alias("new_subcategory"),
        F.col("new_sort").alias("new_sort_order"), "new_included",
    )
    return act.manual_update(c.filings, asked).select(*STATE, "subcategory")


@heavy
def curate_corpus(c: Corpus) -> DataFrame:
    done = plans.curate_corpus(c.filings, c.doc_pages, c.verdicts, c.corrections)
    return done.select(*STATE, "status", "subcategory", "is_profile", *[f"metadata.found_{k}" for k in ("project_id", "address", "company")])


@heavy
def curate_flags(c: Corpus) -> DataFrame:
    return plans.curate_flags(plans.curate_corpus(c.filings, c.doc_pages, c.verdicts, c.corrections), c.reports)


# --- split and size --------------------------------------------------------------------------------------------------


def _totals(c: Corpus) -> DataFrame:
    return c.filings.groupBy("report_id").agg(
        F.sum(metrics.pages_or_zero(F.col("page_count"))).alias("total_pages"), F.sum("file_size").alias("file_size")
    )


def _page_sizes(c: Corpus) -> DataFrame:
    return assemble.assembled_pages(assemble.manifest(c.filings, c.reports, c.doc_pages), c.doc_pages).select(
        "report_id", "global_page", "n_bytes"
    )


@query
def split_estimate(c: Corpus) -> DataFrame:
    return split.split_estimate(_totals(c))


@query
def split_greedy(c: Corpus) -> DataFrame:
    return split.split_greedy(_page_sizes(c), cap=1_000_000)


@query
def split_adaptive(c: Corpus) -> DataFrame:
    return split.split_adaptive(_page_sizes(c), cap=1_000_000)


@query
def delivery_plan(c: Corpus) -> DataFrame:
    return split.delivery_plan(c.reports, split.split_estimate(_totals(c)))


@query
def compression_report(c: Corpus) -> DataFrame:
    done = c.reports.filter("assembled_size IS NOT NULL").select(
        "report_id", F.col("assembled_size").alias("original_size"), "compressed_size"
    )
    return split.compression_report(done).drop("original_size", "compressed_size")


# --- progress --------------------------------------------------------------------------------------------------------


def _arrivals(c: Corpus) -> tuple[str, str]:
    """Filings as files arrive, in a folder of the shared place, and a place for what is made of them."""
    folder = f"{scratch_dir(c.spark).rstrip('/')}/{uuid.uuid4().hex}"
    columns = ["report_id", "original_filename", "original_path", "file_size", F.col("created_at").alias("arrived_at")]
    c.filings.select(*columns).write.parquet(f"{folder}/in")
    return f"{folder}/in", folder


@query
def stream_ingest(c: Corpus) -> DataFrame:
    """All arrivals, taken in by a stream that stops when it has seen them."""
    source, folder = _arrivals(c)
    progress.start(progress.stream_ingest(c.spark, source), f"{folder}/out", f"{folder}/log").awaitTermination()
    return c.spark.read.parquet(f"{folder}/out").select("report_id", "original_filename", "original_path", "file_size", "category", "status")


@query
def stream_folder(c: Corpus) -> DataFrame:
    """The texts of every report as files in a folder of its own, taken in by a stream over the folder that holds them all."""
    folder = f"{scratch_dir(c.spark).rstrip('/')}/{uuid.uuid4().hex}"
    texts = c.given("documents").join(c.filings.select("doc_id", "report_id"), "doc_id").select("report_id", F.coalesce("text", F.lit("")).alias("text"))
    texts.hint("rebalance", "report_id").write.partitionBy("report_id").text(f"{folder}/in")  # a big report is several files
    progress.start(progress.stream_folder(c.spark, f"{folder}/in", 100), f"{folder}/out", f"{folder}/log").awaitTermination()
    found = c.spark.read.parquet(f"{folder}/out").withColumn("report_id", F.regexp_extract("original_path", r"^report_id=(\d+)/", 1).cast("long"))
    extension = F.regexp_extract("original_filename", r"(\.[a-z]+)$", 1).alias("ext")
    return found.groupBy("report_id", extension).agg(F.sum("file_size").alias("bytes"))


@query
def stream_dedupe(c: Corpus) -> DataFrame:
    """Names that have arrived, each once, over a horizon longer than the data."""
    source, folder = _arrivals(c)
    stream = c.spark.readStream.schema(progress.ARRIVAL).parquet(source)
    once = progress.stream_dedupe(stream, "20000 days").select("report_id", "original_filename")
    progress.start(once, f"{folder}/out", f"{folder}/log").awaitTermination()
    return c.spark.read.parquet(f"{folder}/out")


@query
def stream_state(c: Corpus) -> DataFrame:
    """The latest event of every report, kept up by a stream in batches of one file."""
    folder = f"{scratch_dir(c.spark).rstrip('/')}/{uuid.uuid4().hex}"
    slim = c.progress_events.select("report_id", "event_id", "phase", "filename")
    slim.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = c.spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep = progress.state_writer(f"{folder}/state", ["report_id"], "event_id", buckets=8)
    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return progress.read_state(c.spark, f"{folder}/state", slim.schema)


@query
def progress_windows(c: Corpus) -> DataFrame:
    out = progress.progress_windows(c.progress_events)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).drop("last_ts")


@query
def progress_log(c: Corpus) -> DataFrame:
    return progress.progress_log(c.progress_events)


