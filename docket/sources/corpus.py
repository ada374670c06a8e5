"""Corpus tables derived from the given ``documents`` and ``events`` tables.

The given tables hold prose without file names, reports or commands. Each derived table is a projection of them, written
once as SQL expressions that both Spark and an ANSI engine read, so that a check can derive the same inputs. Every row
of the source gives rows here: the tables grow with the data. Report 0 takes a third of all documents on purpose; the
remaining reports hold about 65 each.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions import metrics
from docket.functions.names import suffix
from docket.functions.once import once
from docket.schema import ALL_SECTIONS

PAGE_CHARS = 200

# stem, numbered, extension, first line of the text
TEMPLATES = [
    ("Site Plot Plan", False, ".vsd", "Site Plot Plan"),
    ("Site Location Map", False, ".pdf", "Property Location Map"),
    ("aerial", True, ".jpg", "Aerial photograph"),
    ("IMG", True, ".HEIC", "Photo of the parking lot"),
    ("Appendix C divider", False, ".pdf", "Appendix C"),
    ("Appendix F - Qualifications", False, ".pdf", "Qualifications of Environmental Professional, resume"),
    ("7001234-ESAI-Aerials", True, ".pdf", "1950 Aerial photograph, USGS photo"),
    ("7001234-ESAI-Report", False, ".pdf",
     "Phase I ESA. Table of Contents: Property Location Map, Site Photographs, Database Report, Historical Records"),
    ("7001234 ESAI - 12 Harbor Road", False, ".docx", "Phase I Environmental Site Assessment, Executive Summary"),
    ("E&O 2025-26", False, ".pdf", "Certificate of Liability Insurance ACORD"),
    ("reliance letter", False, ".pdf", "Reliance letter to a third party"),
    ("reliance_letter", False, ".pdf", "Reliance letter"),
    ("case #12345", False, ".pdf", "Agency records, inspection report"),
    ("q3", True, ".pdf", "Quarterly monitoring report"),
    ("IMG", True, ".pdf", "Site photographs"),
    ("misc", True, ".pdf", "Correspondence"),
    ("sanborn map", False, ".pdf", "1950 Sanborn Fire Insurance Map"),
    ("topo quad", False, ".tif", "USGS topographic quadrangle"),
    ("city directory", False, ".pdf", "Polk City Directory"),
    ("ESAI_radius", False, ".pdf", "EDR Radius database report RCRA LUST"),
    ("Photo Appendix", False, ".pdf", "Photo Appendix with adjacent properties"),
    ("Property Profile", False, ".pdf", "Property Profile, title company report"),
    ("records request", False, ".doc", "Records request to the public agency"),
    ("building permit", False, ".txt", "Building permit"),
    ("Final", False, ".pdf", "Closure letter"),
    ("site walk", True, ".mov", "Video"),
    ("index", False, ".db", "Thumbnails"),
    ("drawing", True, ".gif", "Scan"),
    ("UST removal report", False, ".pdf", "Tank removal, remediation"),
    ("Initial Site Investigation", False, ".pdf", "Site investigation 1998"),
    ("marked sanborn", False, ".pdf", "Insurance map, marked"),
    ("monitoring 2003", False, ".pdf", "Monitoring report, environmental consulting group"),
    ("._cover", False, ".pdf", "Resource fork"),
    ("cover", False, ".docx", "© Example Environmental"),
    ("DSCN", True, ".JPG", "Photo"),
    ("closure letter", False, ".pdf", "No further action, closure"),
    ("IMG20240101", True, ".jpg", "Photo with a long number"),
]
VERSIONS = ["", "_v2", "-rev-mam", " (Revised)", " rev", "", "_FINAL"]
FOLDERS = [None, "Photos/", "GeoTracker/2003/", "BLA-0001/records/", "site documents/", "EC_Attachments/", "SMEH_x/"]

SLOT = "CAST(floor(doc_id / 3) AS BIGINT)"


def _lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick(expr: str, values: list) -> str:
    """The value at a 0-based place. A lookup in a literal list stays a small expression however often it is read."""
    return f"element_at(array({', '.join(map(_lit, values))}), CAST({expr} AS INT) + 1)"


def _template(part: int) -> str:
    return pick(f"{SLOT} % {len(TEMPLATES)}", [t[part] for t in TEMPLATES])


REPORT = "CASE WHEN doc_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE 1 + CAST(floor(doc_id / 97) AS BIGINT) END"
_NUMBERED = " OR ".join(f"{SLOT} % {len(TEMPLATES)} = {i}" for i, t in enumerate(TEMPLATES) if t[1])
FILENAME = (
    f"({_template(0)}) || CASE WHEN {_NUMBERED} THEN CASE WHEN {SLOT} % {len(TEMPLATES)} = {len(TEMPLATES) - 1} THEN '' ELSE '_' END"
    " || lpad(CAST(doc_id AS STRING), 6, '0') ELSE '' END"
    f" || ({pick('doc_id % 7', VERSIONS)}) || ({_template(2)})"
)
TITLE = (
    f"({_template(3)}) || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Project Number: ' || CAST(6380000 + ({REPORT}) AS STRING)"
    f" WHEN 1 THEN 'Project Number: ' || CAST(6380000 + doc_id % 3 AS STRING)"
    f" WHEN 2 THEN 'BLA-0000014401' ELSE 'No number' END"
    f" || chr(10) || CAST(100 + doc_id % 900 AS STRING) || ' Main Street'"
)
MINUTES = "INTERVAL '1' MINUTE"

# name -> (source table, {column: expression})
PROJECTIONS: dict[str, tuple[str, dict[str, str]]] = {
    "filing_base": (
        "documents",
        {
            "doc_id": "doc_id",
            "report_id": REPORT,
            "original_filename": FILENAME,
            "folder": pick("doc_id % 7", FOLDERS),
            "file_size": "n_chars * 4096",
            "page_count": "CASE WHEN doc_id % 13 = 5 THEN NULL ELSE CAST(1 + n_chars % 30 AS INT) END",
            "category": pick(f"(doc_id + {SLOT}) % {len(ALL_SECTIONS)}", ALL_SECTIONS),
            "d_group": pick("doc_id % 5", ["sanborn", "aerials", "topos", "city_directory", None]),
            "confidence": "CASE doc_id % 8 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 WHEN 3 THEN 0.7 WHEN 4 THEN 0.8 "
            "WHEN 5 THEN 0.85 WHEN 6 THEN 0.9 WHEN 7 THEN 1.0 END",
            "reasoning": pick(
                "doc_id % 10",
                [
                    None, "Manually classified by user", "Superseded by newer version: plan_v2.pdf",
                    "Auto-excluded: detected as a previously compiled report (contains TOC + multiple appendix markers)",
                    "Filename pattern match: Sanborn map", "", "Folder pattern match: GeoTracker records",
                    "Image file — supporting evidence", "Moved via chat command",
                    "0123456789012345678901234567890123456789012345678901234",
                ],
            ),
            "sort_order": "CASE doc_id % 6 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 2 ELSE 0 END",
            "status": pick(
                "doc_id % 11",
                ["error", "uploaded", "classifying", "converting"] + ["classified"] * 3 + ["ready"] * 4,
            ),
            "is_included": f"doc_id % 9 <> 4 AND ({REPORT}) % 7 <> 3",
            "modified_at": f"CASE WHEN doc_id % 12 = 7 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + {MINUTES} * ((doc_id * 7919) % 10007) END",
            "created_at": f"TIMESTAMP '2024-02-01 00:00:00' + {MINUTES} * doc_id",
        },
    ),
    "filings": (
        "filing_base",
        {
            "doc_id": "doc_id",
            "report_id": "report_id",
            "original_filename": "original_filename",
            "original_path": "folder || original_filename",
            "file_size": "file_size",
            "page_count": "page_count",
            "category": "category",
            "subcategory": "CASE WHEN category = 'APPENDIX_D' THEN d_group END",
            "confidence": "CAST(confidence AS DOUBLE)",
            "reasoning": "reasoning",
            "sort_order": "sort_order",
            "status": "status",
            "is_included": "is_included",
            "modified_at": "modified_at",
            "created_at": "created_at",
        },
    ),
    "doc_texts": (
        "documents",
        {"doc_id": "doc_id", "full_text": f"{TITLE} || chr(10) || text"},
    ),
    "verdicts": (
        "documents",
        {
            "doc_id": "doc_id",
            "response_text": "CASE doc_id % 8"
            " WHEN 0 THEN '```json' || chr(10) || '{\"category\": \"' || (SECTION) || '\", \"confidence\": 0.7, \"reasoning\": \"content\"}' || chr(10) || '```'"
            " WHEN 1 THEN '{\"category\": \"' || (SECTION) || '\", \"confidence\": 0.95, \"reasoning\": \"clear\"}'"
            " WHEN 2 THEN '{\"category\": \"APPENDIX_Z\", \"confidence\": 0.9}'"
            " WHEN 3 THEN 'no json here'"
            " WHEN 4 THEN '{\"category\": \"' || (SECTION) || '\", \"reasoning\": \"no figure\"}'"
            " WHEN 5 THEN '{\"category\": \"' || (SECTION) || '\", \"confidence\": 0.6}'"
            " WHEN 6 THEN CASE doc_id % 56"
            " WHEN 6 THEN '{\"category\": \"APPENDIX_B\", \"confidence\": \"high\"}'"
            " WHEN 14 THEN '{\"category\": \"APPENDIX_B\", \"confidence\": null, \"reasoning\": \"x\"}'"
            " WHEN 22 THEN '{\"category\": \"APPENDIX_B\", \"confidence\": 0.9, \"reasoning\": null}'"
            " WHEN 30 THEN '{\"category\": \"APPENDIX_B\", \"confidence\": 0.9} and more'"
            " WHEN 38 THEN '{\"category\": \"APPENDIX_B\", \"confidence\": \"0.75\", \"subcategory\": null}'"
            " WHEN 46 THEN '{\"category\": \"APPENDIX_B\", \"subcategory\": 3}'"
            " WHEN 54 THEN '{\"category\": [\"APPENDIX_B\"], \"confidence\": 1}' END"
            " WHEN 7 THEN '{\"category\": \"APPENDIX_D\", \"subcategory\": \"topos\", \"confidence\": 0.88, \"reasoning\": \"map\"}'"
            " END".replace("SECTION", pick(f"(doc_id * 5 + {SLOT}) % {len(ALL_SECTIONS)}", ALL_SECTIONS)),
        },
    ),
    "correction_pairs": (
        "filings",
        {
            "report_id": "report_id",
            "doc_id": "CASE WHEN doc_id % 10 = 9 THEN doc_id + 1000000000 ELSE doc_id END",
            "seq1": "doc_id * 2",
            "section1": pick("doc_id % 12", [*ALL_SECTIONS, "BOGUS"]),
            "reason1": "'first look at ' || original_filename",
            "seq2": "doc_id * 2 + 1",
            "section2": pick("(doc_id * 7 + 3) % 12", [*ALL_SECTIONS, "BOGUS"]),
            "reason2": "'second look at ' || original_filename",
        },
    ),
    "requests": (
        "filings",
        {
            "report_id": "report_id",
            "doc_id": "doc_id",
            "target": pick("(doc_id * 3 + 1) % 13", [*ALL_SECTIONS, None, None]),
            "new_sort": "CASE WHEN doc_id % 4 = 1 THEN CAST(doc_id % 5 AS INT) END",
            "new_included": "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
        },
    ),
    "progress_events": (
        "events",
        {
            "report_id": "user_id",
            "event_id": "event_id",
            "ts": "CAST(ts AS TIMESTAMP)",
            "phase": "CASE event_type WHEN 'view' THEN 'classifying' WHEN 'click' THEN 'classified' "
            "WHEN 'signup' THEN 'processed' WHEN 'purchase' THEN 'validating' ELSE 'error' END",
            "filename": "'file_' || CAST(event_id AS STRING)",
            "value": "value",
        },
    ),
}
ACTION_KINDS = ["move", "exclude", "include", "undo", "manual", "search", "info", "assemble", "undo", "exclude", "bogus"]
ACTIONS_PROJECTION = {
    "report_id": "report_id",
    "seq": "doc_id",
    "action": pick(f"doc_id % {len(ACTION_KINDS)}", ACTION_KINDS),
    "doc_a": "doc_id",
    "doc_b": "doc_id - 3",
    "doc_c": "doc_id - 6",
    "target_section": pick("(doc_id * 3 + 2) % 12", [*ALL_SECTIONS, "NOWHERE"]),
    "reason": pick("doc_id % 4", ["routine", "duplicate page", None, "not needed"]),
    "query": pick("doc_id % 5", ["sanborn", "REPORT", "img", "", "plan"]),
}
# A message per filing: its command, and for some a second one that includes it or names eight more.
MESSAGES_PROJECTION = {
    "report_id": "report_id",
    "seq": "seq",
    "actions_json": "'[{\"action\": \"' || action || '\", \"params\": {\"doc_ids\": [' || CAST(doc_a AS STRING) || ', ' || CAST(doc_b AS STRING)"
    " || ', ' || CAST(doc_c AS STRING) || '], \"target_section\": \"' || target_section || '\"'"
    " || CASE WHEN reason IS NULL THEN '' ELSE ', \"reason\": \"' || reason || '\"' END || '}}'"
    " || CASE seq % 4 WHEN 2 THEN ', {\"action\": \"include\", \"params\": {\"doc_ids\": [' || CAST(doc_a AS STRING) || ']}}'"
    " WHEN 3 THEN ', {\"action\": \"exclude\", \"params\": {\"doc_ids\": [1, 2, 3, 4, 5, 6, 7, 8]}}' ELSE '' END || ']'",
}
REPORT_AGGS = {
    "n_docs": "count(*)",
    "raw_size": "CAST(sum(file_size) AS BIGINT)",
}
# Some reports have no filings yet.
EMPTY_REPORTS = ("report_id % 4 = 1", 1_000_000)
REPORT_COLUMNS = {
    "report_id": "report_id",
    "name": "CASE WHEN report_id % 2 = 0 THEN 'New Report ' ELSE 'Phase I ESA: Site/' END || CAST(report_id AS STRING)",
    "address": "CASE WHEN report_id % 3 = 2 THEN CAST(report_id AS STRING) || ' Main Street' END",
    "project_number": "CASE report_id % 4 WHEN 0 THEN CAST(6380000 + report_id AS STRING) WHEN 1 THEN '' "
    "WHEN 2 THEN 'P#' || CAST(report_id AS STRING) END",
    "has_reliance_letter": "report_id % 3 <> 1",
    "status": pick("report_id % 3", ["todo", "in_progress", "done"]),
    "assembled_filename": "CASE WHEN report_id % 5 < 3 THEN 'r' || CAST(report_id AS STRING) || '_assembled.pdf' END",
    "assembled_size": "CASE WHEN report_id % 5 < 3 THEN raw_size END",
    "compressed_size": "CASE WHEN report_id % 5 < 3 THEN CAST(floor(raw_size * (35 + report_id % 80) / 100) AS BIGINT) END",
    "pipeline_start": f"TIMESTAMP '2024-03-01 00:00:00' + {MINUTES} * report_id",
    "pipeline_end": f"CASE WHEN report_id % 4 <> 3 THEN TIMESTAMP '2024-03-01 00:00:00' + {MINUTES} * (report_id * 3 + 1) END",
    "created_at": f"TIMESTAMP '2024-02-01 00:00:00' + {MINUTES} * ((report_id * 37) % 1009)",
}


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


class Corpus:
    """The derived tables of one data folder, built on first use. With ``spread``, filings too are dealt out by id where
    the folder is a single split: worth a shuffle for queries that do much per filing."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: bool = False):
        self.spark, self.sf_dir, self.spread = spark, sf_dir, spread

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        source, columns = PROJECTIONS[name]
        if source == "documents" and self.spread:
            base = self.documents
        else:
            base = self.given(source) if source in ("documents", "events") else getattr(self, source)
        return _project(base, columns)

    @cached_property
    def filing_base(self) -> DataFrame:
        return self._derived("filing_base")

    @cached_property
    def filings(self) -> DataFrame:
        named = once(self._derived("filings"), {"original_filename": F.col("original_filename")})
        return named.withColumn("ext", suffix(F.col("original_filename")))

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._derived("verdicts")

    @cached_property
    def requests(self) -> DataFrame:
        return self._derived("requests")

    @cached_property
    def progress_events(self) -> DataFrame:
        return self._derived("progress_events")

    @cached_property
    def documents(self) -> DataFrame:
        """The given texts, spread evenly: adaptive execution makes as many tasks as their bytes need, so neither one file
        nor a few uneven ones hold up what is done per text."""
        return self.given("documents").hint("rebalance")

    @cached_property
    def doc_texts(self) -> DataFrame:
        return _project(self.documents, PROJECTIONS["doc_texts"][1])

    @cached_property
    def doc_pages(self) -> DataFrame:
        """Texts cut into pages of ``PAGE_CHARS`` characters; every fifth kind is a scan that has OCR text only. Each page
        carries the number of its document's pages and the length of its trimmed text."""
        pages = F.regexp_extract_all("full_text", F.lit(f"(?s).{{1,{PAGE_CHARS}}}"), F.lit(0))
        scan = F.col("doc_id") % 5 == 2
        cut = once(self.doc_texts.select("doc_id", "full_text"), {"chunks": pages})
        split = cut.select("doc_id", F.size("chunks").alias("n_pages"), F.posexplode("chunks").alias("page_no", "chunk"))
        return split.select(
            "doc_id",
            "page_no",
            "n_pages",
            F.when(scan, 0).otherwise(F.length(metrics.blank_trim(F.col("chunk")))).alias("n_trimmed"),
            F.when(scan, F.lit("")).otherwise(F.col("chunk")).alias("txt"),
            F.when(scan, F.col("chunk")).alias("ocr_txt"),
            (F.length("chunk").cast("long") * 512).alias("n_bytes"),
        )

    @cached_property
    def corrections(self) -> DataFrame:
        pairs = self._derived("correction_pairs")
        one = [
            pairs.selectExpr("report_id", "doc_id", f"seq{k} AS seq", f"section{k} AS suggested_section", f"reason{k} AS reason")
            for k in (1, 2)
        ]
        return one[0].unionByName(one[1])

    @cached_property
    def actions(self) -> DataFrame:
        flat = _project(self.filings, ACTIONS_PROJECTION)
        return flat.select(
            "report_id",
            "seq",
            "action",
            F.struct(
                F.array("doc_a", "doc_b", "doc_c").alias("doc_ids"), "target_section", "reason", "query"
            ).alias("params"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return _project(_project(self.filings, ACTIONS_PROJECTION), MESSAGES_PROJECTION)

    @cached_property
    def reports(self) -> DataFrame:
        sums = self.filings.groupBy("report_id").agg(*[F.expr(f"{e} AS {c}") for c, e in REPORT_AGGS.items()])
        which, offset = EMPTY_REPORTS
        none = F.lit(0).cast("long")
        empty = self.filings.filter(which).select((F.col("report_id") + offset).alias("report_id")).distinct()
        sums = sums.unionByName(empty.withColumns({c: none for c in REPORT_AGGS}))
        return _project(sums, REPORT_COLUMNS)

    @cached_property
    def recommendations(self) -> DataFrame:
        """Supporting reports are recommended out; shaky placements are recommended elsewhere."""
        out = self.filings.filter("category = 'REPORTS_AFTER_E'").selectExpr(
            "report_id", "doc_id", "'exclude' AS kind", "CAST(NULL AS STRING) AS suggested", "'routine monitoring' AS reason"
        )
        move = self.filings.filter("confidence < 0.7").selectExpr(
            "report_id", "doc_id", "'reclassify' AS kind", "'APPENDIX_E' AS suggested", "'low confidence' AS reason"
        )
        return out.unionByName(move)
